"""Group aggregates, column statistics and densities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.functions.parsing import finite, is_blank, trimmed
from eigenframe.operators.rowstage import robust_stats
from eigenframe.plans.dense import FLAT
from eigenframe.plans.quantiles import grouped_quantile, quantiles


def aggregate_rows(
    df: DataFrame,
    by: str,
    how: str,
    numeric: Sequence[str],
    text: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per value of ``by``: numbers by mean, median, sum or first, text kept if unanimous.

    Gaps are skipped; a group of nothing but gaps stays empty. A blank key fails
    the job, since a blank is not a group.
    """
    key = F.when(is_blank(F.col(by)), F.raise_error(F.lit(f"blank value in group column {by}")).cast(df.schema[by].dataType)).otherwise(F.col(by))
    rows = df.withColumn(by, key)
    said = {c: F.when(~is_blank(F.col(c)), trimmed(F.col(c))) for c in text}
    kept = [F.when(F.min(v) == F.max(v), F.max(v)).alias(c) for c, v in said.items()]
    if how == "median":
        mid = grouped_quantile(rows, [by], list(numeric), 0.5)
        if not kept:
            return mid
        return rows.groupBy(by).agg(*kept).join(mid, by).select(by, *numeric, *text)
    if how == "first" and not order_by:
        raise ValueError("'first' needs order_by")
    fn = {
        "mean": F.avg,
        "sum": F.sum,
        "first": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order_by))),
    }
    if how not in fn:
        raise ValueError(f"unknown aggregate {how!r}")
    return rows.groupBy(by).agg(*[fn[how](c).alias(c) for c in numeric], *kept)


def aggregate_preview(df: DataFrame, by: str, text: Sequence[str] = ()) -> DataFrame:
    """Groups, rows, largest and smallest group, and text cells that would be cleared."""
    said = {c: F.when(~is_blank(F.col(c)), trimmed(F.col(c))) for c in text}
    split = [F.when(F.min(v) != F.max(v), 1).otherwise(0) for v in said.values()]
    per = df.groupBy(by).agg(F.count("*").alias("n"), sum(split, F.lit(0)).alias("split"))
    return per.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("rows"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        F.sum("split").alias("text_conflicts"),
    )


def _long(df: DataFrame, cols: Sequence[str], aggs: dict) -> DataFrame:
    """One aggregate over all columns, turned into one row per column."""
    wide = df.agg(*[F.struct(*[f(c).alias(n) for n, f in aggs.items()]).alias(f"s{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}.{n}").alias(n) for n in aggs]) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*items)))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, mean, sample and population variance, extremes; one row per column, one scan."""
    return _long(
        df.select(*[finite(F.col(c)).alias(c) for c in cols]),
        cols,
        {
            "n": F.count,
            "mean": F.avg,
            "sd": F.stddev_samp,
            "var_samp": F.var_samp,
            "var_pop": F.var_pop,
            "min": F.min,
            "max": F.max,
        },
    )


def robust_column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Empirical median and scaled MAD per column."""
    med, mad = robust_stats(df, list(cols), len(cols))
    rows = [(c, float(a), float(b)) for c, a, b in zip(cols, med, mad)]
    return df.sparkSession.createDataFrame(rows, "column string, median double, mad double")


def variance_ranking(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns by falling sample variance; ties by name."""
    stats = column_stats(df, cols).select("column", F.col("var_samp").alias("variance"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("variance"), "column")  # one row per column
    return stats.withColumn("rank", F.row_number().over(w))


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return column_stats(df, cols).filter(F.col("var_pop") < FLAT).select("column")


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, extremes, and the outermost values within 1.5 IQR; all rows are read."""
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    q = quantiles(clean, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        q1, mid, q3 = q[c]
        if q1 is None:
            continue
        reach = 1.5 * (q3 - q1)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(c).alias("min"),
                F.lit(q1).alias("q1"),
                F.lit(mid).alias("median"),
                F.lit(q3).alias("q3"),
                F.max(c).alias("max"),
                F.min(F.when(F.col(c) >= q1 - reach, F.col(c))).alias("lower_fence"),
                F.max(F.when(F.col(c) <= q3 + reach, F.col(c))).alias("upper_fence"),
            ).alias(f"s{i}")
        )
    out = clean.agg(*aggs)
    return (
        out.select(F.inline(F.array(*out.columns)))
        .withColumn("low_outliers", F.col("lower_fence") > F.col("min"))
        .withColumn("high_outliers", F.col("upper_fence") < F.col("max"))
    )


def density_grid(
    df: DataFrame, x: str, y: str, bandwidth: str | float = "scott", size: int = 50
) -> DataFrame:
    """Gaussian kernel density on a size×size grid padded by three bandwidths.

    The kernel is a product, so each batch adds Ex'·Ey (size×size) to the sum of
    its task: rows are neither paired with grid cells nor moved.
    """
    pts = df.select(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).dropna()
    s = pts.agg(
        F.count("*").alias("n"),
        F.stddev_pop("x").alias("sx"),
        F.stddev_pop("y").alias("sy"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
    ).first()
    n = s["n"]
    if not n:
        raise ValueError("no finite points")
    if isinstance(bandwidth, str):
        rule = {"scott": n ** (-1 / 6), "silverman": 0.9 * n ** (-1 / 5)}
        h = rule[bandwidth] * math.sqrt(s["sx"] * s["sy"])
    else:
        h = float(bandwidth)
    if h <= 0:
        raise ValueError("the bandwidth is zero: the points do not vary")
    gx = s["x0"] - 3 * h + np.arange(size) * (s["x1"] - s["x0"] + 6 * h) / size
    gy = s["y0"] - 3 * h + np.arange(size) * (s["y1"] - s["y0"] + 6 * h) / size

    def partial(batches):
        total = np.zeros((size, size))
        for b in batches:
            px, py = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in range(0, len(px), 8192):
                ex = np.exp(-0.5 * ((px[at : at + 8192, None] - gx) / h) ** 2)
                ey = np.exp(-0.5 * ((py[at : at + 8192, None] - gy) / h) ** 2)
                total += ey.T @ ex
        i, j = np.indices(total.shape)
        yield pa.record_batch(
            {
                "i": pa.array(i.ravel(), pa.int32()),
                "j": pa.array(j.ravel(), pa.int32()),
                "v": pa.array(total.ravel()),
            }
        )

    cells = pts.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    at = lambda g, c: F.element_at(F.array(*[F.lit(float(v)) for v in g]), F.col(c) + 1)
    return cells.select(
        "i", "j", at(gx, "j").alias("x"), at(gy, "i").alias("y"), (F.col("v") / (2 * math.pi * h * h * n)).alias("density")
    )

