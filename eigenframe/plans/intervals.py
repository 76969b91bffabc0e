"""Overlapping periods cut into disjoint segments, each with the first period that covers it.

The ends of all periods are cut into ranges of bounded size along the time axis. A
period is worked on in the two ranges where its ends lie; ranges in between, which it
covers whole, need only the first of all such periods. That is a minimum over spans of
ranges: each span is two blocks of a power of two, minima are taken per block in one
aggregate, and handed down from block to block on the driver (ranges times their
logarithm numbers, whatever the number of periods). A sweep with a heap in each range
then gives the segments that begin there.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.plans.durable import discard, stored
from eigenframe.plans.ranges import with_range

RANGE_ENDS = 200_000  # ends of periods swept in one task
NONE = -1  # no period covers this segment


def _covering(blocks: list, ranges: int) -> np.ndarray:
    """The first period that covers each range whole, from minima of (level, first range of the block)."""
    none = np.iinfo(np.int64).max
    levels = max(1, math.ceil(math.log2(max(ranges, 2)))) + 1
    best = np.full((levels, ranges), none)
    for level, at, number in blocks:
        best[level, at] = min(best[level, at], number)
    for level in range(levels - 1, 0, -1):
        half = 1 << (level - 1)
        best[level - 1] = np.minimum(best[level - 1], best[level])
        best[level - 1, half:] = np.minimum(best[level - 1, half:], best[level, : ranges - half])
    return best[0]


def sweep(first: int, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[list[float], list[int]]:
    """(begin, first period or ``NONE``) after each end of a range.

    ``start`` is -inf for periods that began before the range, ``end`` inf for those that
    go on beyond it; ``first`` covers the whole range.
    """
    times = np.unique(np.concatenate([start[np.isfinite(start)], end[np.isfinite(end)]])).tolist()
    order = np.argsort(start, kind="stable")
    begins, ends, numbers = start[order].tolist(), end[order].tolist(), number[order].tolist()
    active: list[tuple[int, float]] = []
    at, out = 0, []
    for t in times:
        while at < len(begins) and begins[at] <= t:
            heapq.heappush(active, (numbers[at], ends[at]))
            at += 1
        while active and active[0][1] <= t:
            heapq.heappop(active)
        best = min(first, active[0][0]) if active else first
        out.append(NONE if best == np.iinfo(np.int64).max else best)
    return times, out


def disjoint(periods: DataFrame, range_ends: int = RANGE_ENDS) -> DataFrame:
    """(start, number) of segments that follow each other, from periods (number, a, b).

    ``number`` is unique, and the smallest wins; ``a < b``; ``b`` may be infinite.
    Before the first segment there is no period; ``NONE`` marks gaps.
    """
    spark: SparkSession = periods.sparkSession
    ends = periods.select("number", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))).alias("_e"))
    ends = ends.select("number", "_e.side", "_e.t").filter(F.col("t") < float("inf"))
    placed = with_range(ends, ["t", "side", "number"], range_ends)
    own = placed.groupBy("number").agg(
        F.min(F.when(F.col("side") == 0, F.col("_rng"))).alias("i"), F.max(F.when(F.col("side") == 1, F.col("_rng"))).alias("j")
    )
    both = stored(periods.join(own, "number"), "periods")
    ranges = int(both.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1  # an open period has no j
    between = both.select("number", (F.col("i") + 1).alias("l"), (F.coalesce("j", F.lit(ranges)) - 1).alias("r")).filter("l <= r")
    level = F.floor(F.log2(F.col("r") - F.col("l") + 1)).cast("int")
    spans = between.withColumn("level", level).withColumn("at", F.explode(F.array(F.col("l"), F.expr("r - shiftleft(1, level) + 1"))))
    blocks = spans.groupBy("level", "at").agg(F.min("number").alias("number")).collect()
    covering = _covering([(r["level"], r["at"], r["number"]) for r in blocks], ranges)

    inside = both.withColumn("rng", F.explode(F.array_distinct(F.array_compact(F.array("i", "j")))))
    inside = inside.select(
        "rng", F.when(F.col("rng") == F.col("i"), F.col("a")).otherwise(F.lit(float("-inf"))).alias("a"),
        F.when(F.col("rng") == F.col("j"), F.col("b")).otherwise(F.lit(float("inf"))).alias("b"), "number",
    )

    def run(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        r = key[0].as_py()
        columns = [table.column(c).to_numpy() for c in ("a", "b", "number")]
        times, numbers = sweep(int(covering[r]), *columns)
        return pa.table({"start": pa.array(times, pa.float64()), "rng": pa.array([r] * len(times), pa.int32()), "number": pa.array(numbers, pa.int64())})

    swept = inside.groupBy("rng").applyInArrow(run, "start double, rng int, number long")
    # Ends of one time may lie in several ranges: the last of them has seen all.
    out = stored(swept.groupBy("start").agg(F.max_by("number", "rng").alias("number")), "segments")
    discard(both)
    return out

