"""Order-aware work without one giant window.

A window over an unpartitioned table, or over a group that holds a third of
it, runs in one task. Everything here first measures the largest group. If it
fits one task, an ordinary window is used. If not, rows are cut into ranges of
the *whole* sort key (group columns, order columns, tie breakers), each range is
worked on alone, and what earlier ranges contribute travels in a side table with
at most one row per range. The bounds come from a sample, but they only decide
where ranges are cut: results never depend on them.
"""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP_ROWS = 4_000_000  # rows one window group may hold in a task
MAX_RANGES = 4096
FEW_CUTS = 60  # entries compared one by one in generated code
_SAMPLE_PER_RANGE = 32
_TS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def largest_group(df: DataFrame, by: Sequence[str] = ()) -> int:
    """Rows of the biggest group; counts are combined before the shuffle."""
    if not by:
        return df.count()
    row = df.groupBy(*by).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def with_range(df: DataFrame, keys: Sequence[str], rows_per_range: int, name: str = "_rng") -> DataFrame:
    """Add a range number that never falls as ``keys`` rise."""
    total = df.count()
    ranges = min(MAX_RANGES, max(1, math.ceil(total / max(1, rows_per_range))))
    if ranges == 1:
        return df.withColumn(name, F.lit(0))
    bounds = _bounds(df, keys, total, ranges)
    if not bounds:
        return df.withColumn(name, F.lit(0))
    schema = T.ArrayType(T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys]))
    table = F.from_json(F.lit("[" + ",".join(bounds) + "]"), schema, _TS)
    return df.withColumn(name, _count_keys(table, len(bounds), keys))


def _count_keys(table: Column, size: int, keys: Sequence[str]) -> Column:
    """As :func:`count_upto` for the columns ``keys``; few entries are compared by the first column where that decides."""
    exact = count_upto(table, size, F.struct(*[F.col(k) for k in keys]))
    if size > FEW_CUTS:
        return exact
    first = [F.element_at(table, i + 1)[keys[0]] for i in range(size)]
    x = F.col(keys[0])
    tie = reduce(Column.__or__, [x.isNull(), *[F.coalesce(c == x, F.lit(False)) for c in first]])
    below = reduce(Column.__add__, [F.coalesce((c < x).cast("int"), F.lit(1)) for c in first])  # a NULL comes before all
    return F.when(tie, exact).otherwise(below)


def count_upto(table: Column, size: int, key: Column) -> Column:
    """How many entries of a sorted constant array are <= key, by binary search."""
    steps = [1 << i for i in range(int(math.log2(max(size, 1))), -1, -1)]

    # The key travels with the count: an expression that a lambda took from outside may be inlined into it twice.
    def probe(acc: Column, step: Column) -> Column:
        ahead = acc["n"] + step
        n = F.when((ahead <= size) & (F.try_element_at(table, ahead) <= acc["k"]), ahead).otherwise(acc["n"])
        return F.struct(n.alias("n"), acc["k"].alias("k"))

    start = F.struct(F.lit(0).alias("n"), key.alias("k"))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), start, probe, lambda acc: acc["n"])


def _bounds(df: DataFrame, keys: Sequence[str], total: int, ranges: int) -> list[str]:
    """Every n-th key of a sorted sample of a size that depends on ``ranges`` alone."""
    wanted = ranges * _SAMPLE_PER_RANGE
    picked = df.select(*keys)
    if wanted < total:
        picked = picked.sample(fraction=wanted / total, seed=7)
    rows = picked.orderBy(*keys).select(F.to_json(F.struct(*keys), _TS).alias("k")).limit(4 * wanted).collect()
    every = max(1, len(rows) // ranges)
    cuts = [r["k"] for r in rows[every::every]][: ranges - 1]
    return list(dict.fromkeys(json.dumps(json.loads(c)) if "NaN" not in c else c for c in cuts))


def running_total(
    df: DataFrame,
    weight: Column,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "_before",
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """Sum of ``weight`` over all earlier rows of the group (0 for the first).

    ``order_by`` must order a group without ties. ``at_most`` is a bound on the
    rows of a group, if the caller knows one; else they are counted.
    """
    by = list(partition_by)
    if (largest_group(df, by) if at_most is None else at_most) <= group_rows:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    # A pure count needs no row for its weight, so ties in order_by are harmless.
    keyed = with_range(df.withColumn("_w", weight), [*by, *order_by], group_rows // 4 or 1)
    local = Window.partitionBy("_rng", *by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumn(name, F.coalesce(F.sum("_w").over(local), F.lit(0)))
    carry = _carried(keyed.groupBy("_rng", *by).agg(F.sum("_w").alias("_sum")), by)
    return (
        _attach(out, carry, by)
        .withColumn(name, F.col(name) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_rng", "_w", "_carry")
    )


def _carried(per_range: DataFrame, by: Sequence[str]) -> DataFrame:
    """What earlier ranges add, for the one group per range that began before it."""
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        per_range.withColumn("_carry", F.sum("_sum").over(earlier)).filter("_carry is not null").drop("_sum")
    )


def _attach(df: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on range and group; ``carry`` has at most one row per range."""
    side = carry.select(*[F.col(c).alias(f"_k_{c}") for c in ("_rng", *by)], "_carry")
    cond = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in ("_rng", *by)]
    return df.join(F.broadcast(side), cond, "left").drop(*[f"_k_{c}" for c in ("_rng", *by)])


def dense_index(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str = "_pos",
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """0, 1, 2 … in order within each group."""
    return running_total(df, F.lit(1).cast("long"), order_by, partition_by, name, group_rows, at_most)


def cuts_before(
    df: DataFrame, order_by: Sequence[str], positions: Sequence[int], rows: int, group_rows: int = GROUP_ROWS
) -> Column:
    """How many of the (rising, 0-based) positions a row is at or past.

    Only sort keys are sorted, to look up those at the positions (of many rows, the keys
    of the ranges that hold one); the result is an expression, so the rows themselves
    never move. ``order_by`` must identify rows.
    """
    inside = [p for p in positions if p < rows]
    if not inside:
        return F.lit(0)
    if len(inside) > MAX_RANGES:
        raise ValueError(f"at most {MAX_RANGES} cuts")
    if rows <= group_rows:
        placed = dense_index(df.select(*order_by), order_by, at_most=rows, group_rows=group_rows)
        keys = placed.filter(F.col("_pos").isin(*inside))
    else:
        keys = _at_positions(df.select(*order_by), order_by, inside, rows, group_rows)
    found = [r["k"] for r in sorted(keys.select("_pos", F.to_json(F.struct(*order_by), _TS).alias("k")).collect(), key=lambda r: r["_pos"])]
    schema = T.ArrayType(T.StructType([T.StructField(c, df.schema[c].dataType) for c in order_by]))
    return _count_keys(F.from_json(F.lit("[" + ",".join(found) + "]"), schema, _TS), len(found), order_by)


def _at_positions(keys: DataFrame, order_by: Sequence[str], positions: Sequence[int], rows: int, group_rows: int) -> DataFrame:
    """The keys at the positions, with ``_pos``: ranges are counted, and only those with a position in them are sorted."""
    keyed = with_range(keys, order_by, min(group_rows, max(1, group_rows // 16, -(-rows // FEW_CUTS))))
    counts = keyed.groupBy("_rng").count().orderBy("_rng").collect()
    before, wanted = 0, []
    for r in counts:
        wanted += [(r["_rng"], p - before + 1, p) for p in positions if before <= p < before + r["count"]]
        before += r["count"]
    near = keyed.filter(F.col("_rng").isin(*{rng for rng, _, _ in wanted}))
    numbered = near.withColumn("_at", F.row_number().over(Window.partitionBy("_rng").orderBy(*order_by)))
    side = keys.sparkSession.createDataFrame(wanted, "_rng int, _at int, _pos long")
    return numbered.join(F.broadcast(side), ["_rng", "_at"]).drop("_rng", "_at")


_HASH_ROWS = 100_000  # rows around the wanted edges that are looked at one by one


def hash_cuts(df: DataFrame, mix: Column, order_by: Sequence[str], positions: Sequence[int], rows: int = _HASH_ROWS) -> Column:
    """How many of the (rising, 0-based) positions a row is at or past, in the order of ``mix``, then ``order_by``.

    ``mix`` is a 64-bit hash. Rows are counted by its leading bits, 16 more at a time, until
    few rows are left around the positions; those alone are sorted. ``order_by`` must
    identify rows.
    """
    keyed = df.select(mix.alias("_mix"), *order_by)
    # Leading bits, in the order of signed numbers.
    lead = lambda bits: F.expr(f"shiftrightunsigned(_mix ^ (-9223372036854775807L - 1), {64 - bits})")
    inside: dict[int, tuple[int, list[int]]] = {0: (0, list(positions))}  # leading bits: rows before them, positions among them
    bits, left = 0, rows + 1
    while inside and left > rows and bits < 48:
        parent = lead(bits) if bits else F.lit(0).cast("long")
        bits += 16
        counts = keyed.filter(parent.isin(*inside)).groupBy(parent.alias("p"), lead(bits).alias("b")).count().orderBy("b").collect()
        before, found, left = {p: start for p, (start, _) in inside.items()}, {}, 0
        for r in counts:  # 65,536 for each position at most
            start = before[r["p"]]
            before[r["p"]] = start + r["count"]
            if hits := [x for x in inside[r["p"]][1] if start <= x < before[r["p"]]]:
                found[r["b"]] = (start, hits)
                left += r["count"]
        inside = found
    if not inside:
        return F.lit(0)
    near = keyed.filter(lead(bits).isin(*inside)).withColumn("_part", lead(bits))
    w = Window.partitionBy("_part").orderBy("_mix", *order_by)
    wanted = F.create_map(*[x for k, (start, hits) in inside.items() for x in (F.lit(k).cast("long"), F.lit([h - start for h in hits]).cast("array<int>"))])
    numbered = near.withColumn("_at", F.row_number().over(w) - 1).filter(F.array_contains(wanted[F.col("_part")], F.col("_at")))
    found_keys = [r["k"] for r in numbered.orderBy("_mix", *order_by).select(F.to_json(F.struct("_mix", *order_by), _TS).alias("k")).collect()]
    schema = T.ArrayType(T.StructType([T.StructField("_mix", T.LongType()), *[T.StructField(c, df.schema[c].dataType) for c in order_by]]))
    table = F.from_json(F.lit("[" + ",".join(found_keys) + "]"), schema, _TS)
    exact = count_upto(table, len(found_keys), F.struct(mix.alias("_mix"), *order_by))
    # Leading bits settle nearly all rows; those that share them with an edge are compared with the edges.
    bits = min(16, 8 + len(found_keys).bit_length())
    edges = [json.loads(k)["_mix"] + (1 << 63) >> 64 - bits for k in found_keys]
    upto = [bisect.bisect(edges, b) for b in range(1 << bits)]
    for b in edges:
        upto[b] = None
    at = F.shiftrightunsigned(mix.bitwiseXOR(F.expr("-9223372036854775807L - 1")), 64 - bits)
    return F.coalesce(F.get(F.from_json(F.lit(json.dumps(upto)), "array<int>"), at.cast("int")), exact)


@dataclass(frozen=True)
class Sliding:
    """A frame, the window to use on it, and how to drop the helper rows afterwards."""

    frame: DataFrame
    window: WindowSpec
    finish: Callable[[DataFrame], DataFrame]


def sliding(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    group_rows: int = GROUP_ROWS,
) -> Sliding:
    """Make windows that look ``before`` rows back and ``after`` rows ahead affordable.

    A group too long for a task is cut into chunks of equal length; the rows next
    to a cut are copied to the neighbour, so every row sees its whole frame.
    """
    by = list(partition_by)
    if largest_group(df, by) <= group_rows:
        return Sliding(df, Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order_by), lambda d: d)
    size = max(group_rows, before, after)
    pos = dense_index(df, order_by, by, "_pos", group_rows)
    chunk, off = F.floor(F.col("_pos") / size), F.col("_pos") % size
    copies = [chunk]
    if before:
        copies.append(F.when(off >= size - before, chunk + 1))
    if after:
        copies.append(F.when((off < after) & (chunk > 0), chunk - 1))
    spread = pos.withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))

    def finish(d: DataFrame) -> DataFrame:
        return d.filter(F.col("_chunk") == chunk).drop("_chunk", "_pos")

    return Sliding(spread, Window.partitionBy(*by, "_chunk").orderBy("_pos"), finish)


def fill_along(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    backward: bool = False,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Replace NULLs by the nearest earlier (or later) value of the group."""
    # Backward is forward in reversed order: a frame that grows is cheap, one that shrinks is not.
    by = list(partition_by)
    keys = [F.col(c).desc() if backward else F.col(c).asc() for c in order_by]
    growing = (Window.unboundedPreceding, 0)
    if largest_group(df, by) <= group_rows:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys).rowsBetween(*growing)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    keyed = with_range(df, [*by, *order_by], group_rows // 4 or 1)
    local = Window.partitionBy("_rng", *by).orderBy(*keys).rowsBetween(*growing)
    edge = F.min_by if backward else F.max_by
    seen = keyed.groupBy("_rng", *by).agg(
        *[edge(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order_by))).alias(f"_e_{c}") for c in cols]
    )
    rng = F.col("_rng").desc() if backward else F.col("_rng").asc()
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    carry = seen.select(
        "_rng",
        *by,
        F.struct(*[F.last(f"_e_{c}", ignorenulls=True).over(across).alias(c) for c in cols]).alias("_carry"),
        F.count("*").over(across).alias("_others"),
    ).filter("_others > 0")
    filled = _attach(keyed, carry.drop("_others"), by)
    return filled.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(local), F.col("_carry")[c]) for c in cols}
    ).drop("_rng", "_carry")
