"""Cross moments as a relation, and the small dense objects made from it.

The Gram matrix of the augmented row ``[1, x_1 - s_1, …, x_m - s_m]`` holds the
row count, the sums and the products of a table. As rows ``(key…, i, j, v)`` with
``i <= j`` it can be summed, subtracted and joined like any table, which is what
cross-validation needs. The shift ``s`` is near the mean (taken from a small
preview), so one scan is enough and nothing cancels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQL_WIDTH = 14  # up to this many columns: plain sums; beyond it: NumPy per batch
MAX_WIDTH = 4096  # an m×m matrix is formed on the driver
_PREVIEW = 2000
_FAR = 1e6  # squared distance of the rough centre, in variances, from which sums are made again
_BLOCK = 4096  # rows multiplied at once inside a task
_HELD_CELLS = 1 << 24  # cells of the groups' matrices a task keeps before it gives them on
_FAN = 64  # partial rows one merge adds up
_CHUNK = 4 << 20  # cells worked on at once inside a task


def feature_array(df: DataFrame, features: str | Sequence[str]) -> Column:
    """The row as ``array<double>``, whether stored wide or as one array column."""
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[F.col(f"`{c}`").cast("double") for c in features])


def pieces(batches: Iterator[pa.RecordBatch], cells: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of bounded size, when a row takes ``cells`` numbers."""
    step = max(1, (most or _CHUNK) // max(1, cells))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def width_of(df: DataFrame, features: str | Sequence[str]) -> int:
    if not isinstance(features, str):
        return len(features)
    row = df.agg(F.min(F.size(features)).alias("lo"), F.max(F.size(features)).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no rows to fit")
    if row["lo"] != row["hi"]:
        raise ValueError(f"rows differ in length: {row['lo']} to {row['hi']}")
    return int(row["hi"])


def first_width(df: DataFrame, features: str | Sequence[str], most: int) -> int:
    """The width of the first row, if it is above ``most``: the scan that packs such rows checks them all. Else ``width_of``."""
    if isinstance(features, str):
        row = df.select(F.size(features).alias("n")).first()
        if row is not None and (row["n"] or 0) > most:
            return int(row["n"])
    return width_of(df, features)


def preview_shift(df: DataFrame, values: Column, width: int) -> list[float]:
    """A rough centre from the first rows read; any finite value would be correct."""
    head = df.select(values.alias("v")).limit(_PREVIEW)
    per = head.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    got = {r["i"]: r["x"] for r in per.collect()}
    return [float(got.get(i) or 0.0) for i in range(width)]


def column_means(df: DataFrame, values: Column, width: int) -> list[float]:
    """The mean of each place of an array column over all rows: one row of sums per task and place."""

    def partial(batches):
        n, total = np.zeros(width), np.zeros(width)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            known = np.isfinite(x)
            n, total = n + known.sum(axis=0), total + np.where(known, x, 0.0).sum(axis=0)
        yield pa.record_batch({"i": pa.array(np.arange(width), pa.int32()), "n": pa.array(n), "s": pa.array(total)})

    sums = df.select(values.alias("v")).mapInArrow(partial, "i int, n double, s double").groupBy("i").agg(F.sum("n"), F.sum("s"))
    got = {i: s / n for i, n, s in sums.collect() if n}
    return [float(got.get(i) or 0.0) for i in range(width)]


def gram(
    df: DataFrame,
    features: str | Sequence[str],
    shift: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(by…, i, j, v)``: the augmented Gram matrix of each group, upper half."""
    by = list(by)
    if not isinstance(features, str) and len(features) <= SQL_WIDTH:
        return _gram_sql(df, features, shift, by)
    return _gram_arrow(df, features, shift, by)


def _gram_sql(df, features, shift, by):
    x = [F.lit(1.0)] + [F.col(f"`{c}`").cast("double") - F.lit(float(s)) for c, s in zip(features, shift)]
    base = df.select(*by, *[c.alias(f"x{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = [
        F.sum(F.col(f"x{j}") if i == 0 else F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs
    ]
    wide = base.groupBy(*by).agg(*sums)
    cells = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{i}_{j}").alias("v")) for i, j in pairs]
    )
    return wide.select(*by, F.inline(cells))


def _gram_arrow(df, features, shift, by):
    m = len(shift)
    if m > MAX_WIDTH:
        raise ValueError(f"{m} variables: a square matrix is kept up to {MAX_WIDTH}; use method='svd'")
    s = np.asarray(shift, dtype=float)
    keys = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.select(keys.alias("key"), feature_array(df, features).alias("x"))

    def given_on(held):
        for key, g in held.items():
            i = np.arange(m + 1)
            yield pa.record_batch(
                {
                    "key": pa.array([key] * (m + 1), pa.string()),
                    "i": pa.array(i, pa.int32()),
                    "r": pa.array([g[k, k:] for k in i], pa.list_(pa.float64())),
                }
            )

    def partial(batches):
        held: dict[str, np.ndarray] = {}
        for batch in pieces(batches, m):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) - s
            codes = batch.column(0).dictionary_encode()
            which = codes.indices.to_numpy()
            for c, key in enumerate(codes.dictionary.to_pylist()):
                part = x[which == c] if len(codes.dictionary) > 1 else x
                z = np.hstack([np.ones((len(part), 1)), part])
                g = z.T @ z
                held[key] = g if key not in held else held[key] + g
                if len(held) * (m + 1) ** 2 > _HELD_CELLS:  # many groups: never more than this in a task
                    yield from given_on(held)
                    held = {}
        yield from given_on(held)

    parts = rows.mapInArrow(partial, "key string, i int, r array<double>")

    def add(key, table):
        total = np.sum(table.column("r").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), axis=0)
        first = {c: table.column(c).slice(0, 1) for c in ("key", "i", "task")}
        return pa.table(first | {"r": pa.array([total], pa.list_(pa.float64()))})

    if m > 128:
        # A tree: a merge adds up at most 64 partial rows, up to 262,144 tasks.
        parts = parts.withColumn("task", F.spark_partition_id().cast("long"))
        for span in (_FAN, _FAN**2, 1 << 40):
            group = F.floor(F.col("task") / span).alias("group")
            parts = parts.groupBy("key", "i", group).applyInArrow(
                lambda key, table: add(key, table), "key string, i int, task long, r array<double>"
            )
        cells = parts.select("key", "i", F.posexplode("r").alias("d", "v"))
    else:
        cells = (
            parts.select("key", "i", F.posexplode("r").alias("d", "v"))
            .groupBy("key", "i", "d")
            .agg(F.sum("v").alias("v"))
        )
    out = cells.select("key", "i", (F.col("i") + F.col("d")).alias("j"), "v")
    if not by:
        return out.drop("key")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    parsed = F.from_json("key", schema)
    return out.select(*[parsed[c].alias(c) for c in by], "i", "j", "v")


@dataclass
class Moments:
    """Count, mean and centred products of a table."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray  # sum of (x - mean)(x - mean)'

    @property
    def cov(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    @property
    def sd(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cov), 0.0))


def moments_from(cells, shift: Sequence[float]) -> Moments:
    """Assemble ``(i, j, v)`` triples of one group."""
    m = len(shift)
    g = np.zeros((m + 1, m + 1))
    for i, j, v in cells:
        g[i, j] = g[j, i] = v
    n = g[0, 0]
    if not n:
        return Moments(0.0, np.asarray(shift, float), np.zeros((m, m)))
    d = g[0, 1:] / n
    return Moments(float(n), np.asarray(shift, float) + d, g[1:, 1:] - n * np.outer(d, d))


def moments(df: DataFrame, features: str | Sequence[str], shift: Sequence[float] | None = None) -> Moments:
    """One scan; what reaches the driver is the m×m matrix.

    Should the rough centre lie so far from the mean that digits were lost, the
    table is read once more about the mean.
    """
    m = width_of(df, features)
    if m > MAX_WIDTH:
        raise ValueError(f"{m} variables exceed the {MAX_WIDTH} for which a square matrix is kept")
    shift = preview_shift(df, feature_array(df, features), m) if shift is None else shift
    for _ in range(2):
        rows = gram(df, features, shift).toPandas()
        out = moments_from(rows[["i", "j", "v"]].itertuples(index=False, name=None), shift)
        off = out.mean - np.asarray(shift, float)
        spread = np.diag(out.scatter) / max(out.n, 1)
        if not np.any(off**2 > _FAR * np.abs(spread) + (1e-9 * out.mean) ** 2):
            break
        shift = out.mean.tolist()
    return out


def tall_skinny_r(df: DataFrame, features: str | Sequence[str], center: Sequence[float], divisor: Sequence[float]):
    """The R factor of the centred and scaled table: QR per task, then QR of stacked factors.

    Benson, Gleich & Demmel (2013). Used when squaring the table would lose the
    small directions. Every merge handles a bounded number of m×m factors.
    """
    m, c, d = len(center), np.asarray(center, float), np.asarray(divisor, float)
    rows = df.select(feature_array(df, features).alias("x"))
    schema = "task long, row int, r array<double>"

    def factor(batches):
        r = np.zeros((0, m))
        for batch in batches:
            x = (batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) - c) / d
            for at in range(0, len(x), _BLOCK):
                r = np.linalg.qr(np.vstack([r, x[at : at + _BLOCK]]), mode="r")
        if len(r):
            yield _r_batch(r, 0)

    def merge(key, table):
        stacked = np.array(table.column("r").to_pylist())
        return pa.Table.from_batches([_r_batch(np.linalg.qr(stacked, mode="r"), int(key[0].as_py()))])

    parts = rows.mapInArrow(factor, schema).withColumn("task", F.spark_partition_id().cast("long"))
    for fan in (64, 64, 1 << 40):  # a merge never stacks more than 64 factors up to 262,144 tasks
        parts = parts.groupBy(F.floor(F.col("task") / fan).alias("group")).applyInArrow(merge, schema)
    return np.array([r["r"] for r in parts.orderBy("row").collect()])


def _r_batch(r: np.ndarray, task: int) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "task": pa.array([task] * len(r), pa.int64()),
            "row": pa.array(np.arange(len(r)), pa.int32()),
            "r": pa.array(list(r), pa.list_(pa.float64())),
        }
    )
