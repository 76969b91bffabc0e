"""Exact quantiles whose memory does not grow with the number of distinct values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.plans.ranges import GROUP_ROWS, running_total

DISTINCT_LIMIT = 200_000  # distinct values one aggregation buffer may hold
_ACCURACY = 10_000
_PASSES = 8


def few_distinct(df: DataFrame, cols: Sequence[str], limit: int = DISTINCT_LIMIT) -> list[bool]:
    """For each column, whether its distinct values fit one aggregation buffer."""
    row = df.agg(*[F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    return [v <= 0.8 * limit for v in row]


def _ranks(q: float, n: int, how: str) -> tuple[int, int, float]:
    """Zero-based ranks to mix and the weight of the upper one."""
    if how == "linear":
        h = q * (n - 1)
        lo = math.floor(h)
        return lo, min(lo + 1, n - 1), h - lo
    return max(math.ceil(q * n) - 1, 0), max(math.ceil(q * n) - 1, 0), 0.0


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    how: str = "linear",
    limit: int = DISTINCT_LIMIT,
    distinct: Mapping[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns, NULLs skipped.

    ``how="linear"`` interpolates; ``how="lower"`` is the empirical quantile
    (smallest x with F(x) >= q). Each column goes its own way: few distinct values
    (``distinct``, if the caller has counted them) take one aggregate. With many, the
    wanted ranks are bracketed by approximate quantiles, and the brackets shrink
    pass by pass until what is left inside them is small. No shuffle of rows.
    """
    typed = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    names = [f"c{i}" for i in range(len(cols))]
    fits = few_distinct(typed, names, limit) if distinct is None else [distinct.get(c, 0) <= limit for c in cols]
    small = [(c, n) for c, n, f in zip(cols, names, fits) if f]
    large = [(c, n) for c, n, f in zip(cols, names, fits) if not f]
    found = _by_aggregate(typed, small, probs, how) if small else {}
    found |= _by_brackets(typed, *zip(*large), probs, how, limit) if large else {}
    return {c: found[c] for c in cols}


def _by_aggregate(typed, columns, probs, how):
    if how == "linear":
        aggs = [F.percentile(n, F.array(*[F.lit(float(q)) for q in probs])).alias(n) for _, n in columns]
        row = typed.agg(*aggs).first()
        return {c: list(row[n]) if row[n] is not None else [None] * len(probs) for c, n in columns}
    aggs = [
        F.expr(f"percentile_disc({float(q)}) within group (order by {n})").alias(f"{n}_{j}")
        for _, n in columns
        for j, q in enumerate(probs)
    ]
    row = typed.agg(*aggs).first()
    return {c: [row[f"{n}_{j}"] for j in range(len(probs))] for c, n in columns}


def _by_brackets(typed, cols, names, probs, how, limit):
    counts = typed.agg(*[F.count(n).alias(n) for n in names]).first()
    # A bracket holds the one rank, or the two neighbours, that a quantile mixes: column, first rank, last rank.
    todo: dict[tuple[str, int, int], dict] = {}
    for n in names:
        if counts[n]:
            for q in probs:
                first, last, _w = _ranks(q, counts[n], how)
                todo[(n, first, last)] = {"below": 0, "inside": counts[n], "lo": float("-inf"), "hi": float("inf")}
    done: dict[tuple[str, int], float] = {}
    for _ in range(_PASSES):
        wide = {k: b for k, b in todo.items() if b["inside"] > limit}
        if not wide:
            break
        guesses = []
        for i, ((n, first, _l), b) in enumerate(wide.items()):
            at = (first - b["below"] + 0.5) / b["inside"]
            around = [max(0.0, at - 3 / _ACCURACY), min(1.0, at + 3 / _ACCURACY)]
            held = F.when(F.col(n).between(b["lo"], b["hi"]), F.col(n))
            guesses.append(F.percentile_approx(held, around, _ACCURACY).alias(f"g{i}"))
        row = typed.agg(*guesses).first()
        checks = []
        for i, (n, _f, _l) in enumerate(wide):
            lo, hi = row[f"g{i}"]
            checks += [
                F.count_if(F.col(n) < lo).alias(f"b{i}"),
                F.count_if(F.col(n).between(lo, hi)).alias(f"i{i}"),
            ]
        seen = typed.agg(*checks).first()
        for i, (k, b) in enumerate(wide.items()):
            n, first, last = k
            lo, hi = row[f"g{i}"]
            below, inside = seen[f"b{i}"], seen[f"i{i}"]
            if below <= first and last < below + inside:
                if lo == hi:
                    done.update({(n, first): lo, (n, last): lo})
                    todo.pop(k)
                b.update(below=below, inside=inside, lo=lo, hi=hi)
            elif last < below:
                b.update(inside=below - b["below"], hi=math.nextafter(lo, -math.inf))
            elif first >= below + inside:
                end = b["below"] + b["inside"]
                b.update(below=below + inside, inside=end - below - inside, lo=math.nextafter(hi, math.inf))
            else:  # the two ranks lie on both sides of an edge: from here on each has its own bracket
                todo.pop(k)
                todo.update({(n, r, r): dict(b) for r in (first, last)})
    if todo:
        done.update(_select_inside(typed, todo))
    out = {}
    for c, n in zip(cols, names):
        vals: list[float | None] = []
        for q in probs:
            if not counts[n]:
                vals.append(None)
                continue
            lo, hi, w = _ranks(q, counts[n], how)
            vals.append(done[(n, lo)] + (done[(n, hi)] - done[(n, lo)]) * w)
        out[c] = vals
    return out


def _select_inside(typed: DataFrame, left: dict) -> dict[tuple[str, int], float]:
    """Count the few values left in each bracket and step to the wanted ranks."""
    entries = []
    for i, ((n, _f, _l), b) in enumerate(left.items()):
        hit = F.col(n).between(b["lo"], b["hi"])
        entries.append(F.when(hit, F.struct(F.lit(i).alias("b"), F.col(n).alias("x"))))
    per_value = (
        typed.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy(F.col("e.b").alias("b"), F.col("e.x").alias("x"))
        .count()
    )
    upto = Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranks = lambda at: F.element_at(F.array(*[F.lit(k[at] - b["below"]).cast("long") for k, b in left.items()]), F.col("b") + 1)
    start = F.col("end") - F.col("count")
    within = lambda r: (F.col("end") > r) & (start <= r)
    rows = (
        per_value.withColumn("end", F.sum("count").over(upto))
        .withColumns({"first": within(ranks(1)), "last": within(ranks(2))})
        .filter(F.col("first") | F.col("last"))
        .select("b", "x", "first", "last")
        .collect()
    )
    keys, out = list(left), {}
    for r in rows:
        n, first, last = keys[r["b"]]
        out |= ({(n, first): r["x"]} if r["first"] else {}) | ({(n, last): r["x"]} if r["last"] else {})
    return out


def grouped_quantile(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    q: float = 0.5,
    limit: int = DISTINCT_LIMIT,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Exact interpolated quantile of every column in every group.

    With many distinct values the buffer of a hot group would not fit a task, so
    values are counted first and the ranks come from a running total that splits
    hot groups into ranges.
    """
    if all(few_distinct(df, cols, limit)):
        return df.groupBy(*by).agg(*[F.percentile(F.col(c), F.lit(float(q))).alias(c) for c in cols])
    entries = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("x")) for c in cols])
    counted = (
        df.select(*by, F.explode(entries).alias("e"))
        .select(*by, F.col("e.col").alias("_col"), F.col("e.x").alias("_x"))
        .filter("_x is not null")
        .groupBy(*by, "_col", "_x")
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_total(counted, F.col("_n"), ["_x"], [*by, "_col"], "_start", group_rows)
    totals = counted.groupBy(*by, "_col").agg(F.sum("_n").alias("_total"))
    same = [ranked[c].eqNullSafe(totals[c]) for c in (*by, "_col")]
    h = (F.col("_total") - 1) * F.lit(float(q))
    lo, hi = F.floor(h), F.least(F.floor(h) + 1, F.col("_total") - 1)
    covers = lambda r: (F.col("_start") <= r) & (F.col("_start") + F.col("_n") > r)
    picked = ranked.join(totals, same, "inner").select(
        *[ranked[c] for c in (*by, "_col")],
        F.when(covers(lo), F.col("_x")).alias("_lo"),
        F.when(covers(hi), F.col("_x")).alias("_hi"),
        (h - lo).alias("_w"),
    )
    per = picked.filter("_lo is not null or _hi is not null").groupBy(*by, "_col").agg(
        F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_w").alias("_w")
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    wide = per.groupBy(*by).agg(*[F.max(F.when(F.col("_col") == c, value)).alias(c) for c in cols])
    keys = df.select(*by).distinct()
    cond = [keys[c].eqNullSafe(wide[c]) for c in by]
    return keys.join(wide, cond, "left").select(*[keys[c] for c in by], *[wide[c] for c in cols])
