"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and size S takes every document floor(T/S) times, and once
more with probability frac(T/S). Which documents are taken once more is decided by
the cube method: inclusion probabilities walk through the null-space of the balancing
equations (how many documents, how many tokens) until they reach 0 or 1. The walk
runs in groups of bounded size; each leaves at most two documents undecided, which
are dealt to fewer groups and walk on, until one group per source is left. The
landing problem of that group is a dozen documents, settled by the ends that miss
the totals least.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.llm.common import SPACE
from eigenframe.plans.durable import stored
from eigenframe.plans.ranges import dense_index
from eigenframe.roles import unique_name

EPS = 1e-9


def size_of(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.size(F.array_remove(F.split(text.cast("string"), SPACE), "")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Sources in code-point order, NULL last, take ``weights`` in turn and split
    ``share`` times all sizes by weight. A target above ``most`` times its source's
    size stops there, and the excess is split again by weight among the others, until
    none is above. One aggregate per round; each round stops a source or is the last.
    """
    placed = dense_index(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    rows = stored(placed.select("source", "source_size", weight.alias("weight")), "sources")
    whole = float(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = most * F.col("source_size")
    rate, before = 0.0, -1
    while True:
        full = cap <= rate * F.col("weight")
        row = rows.agg(
            F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.sum(full.cast("long")).alias("n")
        ).first()
        if row["n"] == before or not row["open"]:
            break
        before, rate = row["n"], (whole - (row["used"] or 0.0)) / row["open"]
    if not (row and row["open"]):
        return rows.withColumn("target", cap.cast("double"))
    return rows.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(rate))))


def flight(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Walk ``p`` to 0 and 1, keeping sum(p) and sum(p * x); at most two entries stay between.

    Three open entries always have a direction that changes neither sum: the cross
    product of (1, 1, 1) and their sizes. A seeded draw picks the way along it, with
    chances that keep each expectation.
    """
    p = p.astype(float).copy()
    rng = np.random.RandomState(zlib.crc32(np.ascontiguousarray(x, dtype="<f8").tobytes()))
    draws = rng.random_sample(len(p) + 8)
    waiting = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))][::-1]
    open_: list[int] = []
    step = 0
    while True:
        while len(open_) < 3 and waiting:
            open_.append(waiting.pop())
        if len(open_) < 3:
            break
        i, j, k = open_
        u = (x[k] - x[j], x[i] - x[k], x[j] - x[i])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up, down = np.inf, np.inf
        for at, d in zip(open_, u):
            if d > 0:
                up, down = min(up, (1 - p[at]) / d), min(down, p[at] / d)
            elif d < 0:
                up, down = min(up, p[at] / -d), min(down, (1 - p[at]) / -d)
        move = up if draws[step % len(draws)] * (up + down) < down else -down
        step += 1
        for at, d in zip(open_, u):
            p[at] += move * d
            if p[at] < EPS or p[at] > 1 - EPS:
                p[at] = float(p[at] > 0.5)
        open_ = [at for at in open_ if 0 < p[at] < 1]
    return p


def settle(p: np.ndarray, x: np.ndarray, held: int = 12) -> np.ndarray:
    """All of ``p`` to 0 and 1: the walk, then the landing problem.

    ``held`` entries of all sizes sit out the walk. With the two it leaves open they
    give a few thousand ends, of which the one that misses the sums least is taken.
    """
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    by_size = open_[np.argsort(x[open_], kind="stable")]
    aside = by_size[np.unique(np.linspace(0, len(by_size) - 1, held).astype(int))] if len(by_size) else by_size
    walk = p.copy()
    walk[aside] = 0.0
    out = flight(walk, x)
    out[aside] = p[aside]
    left = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    if len(left):
        ends = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = ends - out[left]
        miss = np.abs(off @ x[left]) + 0.02 * x.mean() * np.abs(off.sum(axis=1))
        out[left] = ends[int(np.argmin(miss))]
    return np.round(out)


def cube(units: DataFrame, group_rows: int = 1024) -> DataFrame:
    """``units`` with column ``p`` walked to 0 or 1 for each row, balanced on ``x`` within each ``source``.

    Column ``uid`` (long) orders a group; any other columns are carried along.
    """
    names, at = units.columns, units.columns.index("p")

    def walk(last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.select(names)
            table = table.take(pa.array(np.argsort(table.column("uid").to_numpy(), kind="stable")))
            p, x = table.column("p").to_numpy(), table.column("x").to_numpy()
            return table.set_column(at, "p", pa.array(settle(p, x) if last else flight(p, x)))

        return run

    open_, parts = units, []
    most = units.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while True:
        groups = max(1, -(-int(most) // group_rows))
        group = F.pmod(F.xxhash64("uid", F.lit(int(most))), F.lit(groups))
        walked = open_.withColumn("_g", group).groupBy("source", "_g").applyInArrow(walk(groups == 1), units.schema)
        if groups == 1:
            parts.append(walked)
            break
        walked = stored(walked, "walked")
        between = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(walked.filter(~between))
        open_, most = walked.filter(between), 2 * groups
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _row_key() -> Column:
    """The same for rows with the same id, source and text."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in ("doc_id", "source", "text")])


def decide(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, group_rows: int = 1024) -> DataFrame:
    """How often the mix takes each row of ``docs``: ``copies``, from 0 to ``most``.

    One row per row, with doc_id, source, k (a hash of id, source and text), i (a number
    among equal rows), n (how many equal rows), size, source_size, target and copies.
    The sum of size * copies of each source comes within about one document of its
    target, and so does the number of rows; a source without a word takes nothing. A
    NULL source is a source of its own; a NULL text has size 0; repeated rows are
    decided one by one. Reruns agree. Other columns are ignored.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), _row_key().alias("k"), size_of(F.col("text")).alias("size"))
    classes = stored(sized.groupBy("doc_id", "source", "k", "size").agg(F.count("*").alias("n")), "sizes")
    sums = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stored(with_targets(sums, weights, share, most).drop("weight"), "targets").withColumnRenamed("source", "_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = classes.join(sources, classes["source"].eqNullSafe(sources["_s"])).drop("_s")
    each = each.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    base = F.floor(rate + EPS).cast("double")
    each = each.withColumns({"base": base, "p": F.greatest(rate - base, F.lit(0.0)), "x": F.col("size").cast("double"), "uid": F.xxhash64("k", "i")})
    walked = cube(stored(each, "units"), group_rows)
    copies = (F.col("base") + F.col("p")).cast("long").alias("copies")
    return walked.select("doc_id", "source", "k", "i", "n", "size", "source_size", "target", copies)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``decide`` says, with its own columns."""
    decided = decide(docs, **options)
    key, total, many, place, times = (unique_name(c, docs.columns) for c in ("mix_key", "mix_total", "mix_rows", "mix_place", "mix_times"))
    once = decided.groupBy("k").agg(F.sum("copies").alias(total), F.max("n").alias(many)).withColumnRenamed("k", key)
    once = stored(once, "copies")
    # A row per document: merged at every size, since nothing bounds it for a broadcast.
    rows = docs.withColumn(key, _row_key()).join(once.hint("merge"), key)
    single = rows.filter(F.col(many) == 1).withColumn(times, F.col(total))
    repeated = dense_index(rows.filter(F.col(many) > 1), ["doc_id"], [key], place)
    share = F.floor(F.col(total) / F.col(many))
    repeated = repeated.withColumn(times, share + (F.col(place) < F.col(total) - share * F.col(many)).cast("long")).drop(place)
    if once.filter(F.col(many) > 1).limit(1).count():
        single = single.unionByName(repeated)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(unique_name("mix_time", docs.columns))
    return single.filter(F.col(times) > 0).select("*", again).select(*[F.col(f"`{c}`") for c in docs.columns])
