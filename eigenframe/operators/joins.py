"""Joins data preparation needs beyond ``DataFrame.join``."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.plans.durable import stored
from eigenframe.plans.intervals import NONE, RANGE_ENDS, disjoint, sweep
from eigenframe.plans.ranges import GROUP_ROWS, count_upto, dense_index, fill_along
from eigenframe.roles import unique_name

SMALL_PERIODS = 4096  # periods cut on the driver and broadcast; more give the same result in ranges


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], **kw):
    """Row i with row i, both in their own order; extra rows go."""
    a = dense_index(left, left_order, name="_pos", **kw)
    b = dense_index(right, right_order, name="_pos", **kw)
    return a.join(b, "_pos").drop("_pos")


def align_left(primary: DataFrame, factors: DataFrame, on: str) -> DataFrame:
    """Factor values on the dates of the primary series; dates without one get NULL."""
    return primary.join(factors, on, "left")


def interval_join(
    df: DataFrame, at: str, periods: DataFrame, start: str, end: str, order_by: Sequence[str], group_rows: int = GROUP_ROWS, range_ends: int = RANGE_ENDS
) -> DataFrame:
    """Each row with the first period (in ``order_by`` order, then by all its columns) holding ``start <= at < end``.

    A NULL end is open; rows no period covers get NULLs, and so do rows without a time;
    repeated rows stay. Periods are cut into disjoint segments, so a row meets one at most.
    Few periods are cut on the driver and broadcast, and rows never move. Of more, only the first
    with each start and end can win; these are cut range by range. Few segments are
    broadcast again; of more, rows and segments are sorted together, also in ranges: a
    row takes the last segment before it, which the range before hands on if need be.
    A time that a third of the rows share is spread over ranges like any other.
    """
    extra = list(periods.columns)
    spans = periods.select(
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("p"),
        F.col(start).cast("timestamp").cast("double").alias("a"),
        F.coalesce(F.col(end).cast("timestamp").cast("double"), F.lit(float("inf"))).alias("b"),
    ).filter("a < b")
    order = [f"p.`{c}`" for c in dict.fromkeys([*order_by, *extra])]
    if spans.limit(SMALL_PERIODS + 1).count() > SMALL_PERIODS:
        spans = stored(_first_of_each(spans, order, extra), "spans")
    if spans.limit(SMALL_PERIODS + 1).count() <= SMALL_PERIODS:
        return _by_segments(df, at, spans.orderBy(*order).collect(), spans, extra)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"), F.col(at).cast("timestamp").cast("double").alias("t"))
    named = _named_segments(spans, order, group_rows, range_ends)
    most = max(0, 2 * SMALL_PERIODS)
    if 0 < named.limit(most + 1).count() <= most:
        listed = named.orderBy("start").collect()
        return _at_segments(df, at, [r["start"] for r in listed], [r["p"] for r in listed], spans, extra)
    matched = _by_ranges(rows, named, group_rows)
    return matched.select(*[F.col("r")[c].alias(c) for c in df.columns], *[F.col("p")[c].alias(c) for c in extra])


def _by_segments(df: DataFrame, at: str, few: list, spans: DataFrame, extra: list[str]) -> DataFrame:
    numbers = np.array([(r["a"], r["b"], i) for i, r in enumerate(few)], dtype=float).reshape(-1, 3)
    cuts, first = sweep(np.iinfo(np.int64).max, numbers[:, 0], numbers[:, 1], numbers[:, 2].astype(np.int64))
    return _at_segments(df, at, cuts, [few[k]["p"] if k != NONE else None for k in first], spans, extra)


def _first_of_each(spans: DataFrame, order: list[str], extra: list[str]) -> DataFrame:
    """Of the periods with the same start and end, the first."""
    names = [f"_o{i}" for i in range(len(order))]
    first = spans.groupBy("a", "b").agg(F.min(F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)])).alias("_f"))
    own = [F.col("_f")[names[order.index(f"p.`{c}`")]].alias(c) for c in extra]
    return first.select(F.struct(*own).alias("p"), "a", "b")


def _at_segments(df: DataFrame, at: str, cuts: list[float], first: list, spans: DataFrame, extra: list[str]) -> DataFrame:
    """Each row with the period of the last of the (rising) cuts before it."""
    segments = [(i + 1, p) for i, p in enumerate(first) if p is not None]
    t, seg, period = (unique_name(c, [*df.columns, *extra]) for c in ("t", "seg", "period"))
    table = df.sparkSession.createDataFrame(segments, f"`{seg}` int, `{period}` {spans.schema['p'].dataType.simpleString()}")
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<double>")
    keyed = df.withColumn(t, F.col(at).cast("timestamp").cast("double")).withColumn(seg, count_upto(bounds, len(cuts), F.col(t)))
    out = keyed.join(F.broadcast(table), seg, "left")
    return out.select(*[keyed[f"`{c}`"] for c in df.columns], *[F.col(period)[c].alias(c) for c in extra])


def _named_segments(spans: DataFrame, order: list[str], group_rows: int, range_ends: int) -> DataFrame:
    """(start, _n, p) of the segments; the period of a gap is NULL."""
    listed = spans.select("p", "a", "b", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    numbered = stored(dense_index(listed, [f"_o{i}" for i in range(len(order))], name="number", group_rows=group_rows).select("number", "p", "a", "b"), "periods")
    segments = disjoint(numbered.select("number", "a", "b"), range_ends)
    return segments.join(numbered.select(F.col("number").alias("_n"), "p"), F.col("number") == F.col("_n"), "left")


def _by_ranges(rows: DataFrame, named: DataFrame, group_rows: int) -> DataFrame:
    # A gap is a segment of its own, whose period is NULL.
    marks = named.select(F.lit(None).cast(rows.schema["r"].dataType).alias("r"), F.col("start").alias("t"), F.lit(0).alias("kind"), F.struct("p").alias("s"))
    asked = rows.select("r", "t", F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["s"].dataType).alias("s"))
    # Rows of one time are told apart by their hash and by where they were read, so that they spread.
    spread = marks.union(asked).withColumn("h", F.xxhash64("r")).withColumn("w", F.spark_partition_id())
    filled = fill_along(spread, ["s"], ["t", "kind", "h", "w"], group_rows=group_rows)
    return filled.filter("kind = 1").select("r", F.col("s.p").alias("p"))


def rows_without(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The complement of a set of keys."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*keys).distinct(), keys, "left_anti")
