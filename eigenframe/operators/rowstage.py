"""Row-wise and column-wise preprocessing of model variables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.functions.stats import array_sum, let
from eigenframe.plans.dense import FLAT, floor_at_one, smoothing_matrix
from eigenframe.plans.gram import feature_array
from eigenframe.plans.quantiles import quantiles

MAD_SCALE = 1.4826  # makes the median absolute deviation estimate a normal's spread
Features = str | Sequence[str]


@dataclass(frozen=True)
class RowStage:
    """Corrections that look at one row only, so they cannot leak between rows."""

    snv: bool = False
    vector_norm: bool = False
    sg_window: int = 0
    sg_order: int = 0
    sg_deriv: int = 0

    @property
    def active(self) -> bool:
        return self.snv or self.vector_norm or self.sg_window > 0

    @property
    def linear(self) -> bool:
        """A fixed linear map of the row, so model coefficients can absorb it."""
        return not (self.snv or self.vector_norm)

    def matrix(self, m: int) -> np.ndarray:
        return smoothing_matrix(m, self.sg_window, self.sg_order, self.sg_deriv) if self.sg_window else np.eye(m)

    def as_dict(self) -> dict:
        return asdict(self)


def snv(df: DataFrame, features: Features, name: str = "snv") -> DataFrame:
    """Standard normal variate: row minus its mean, over its sample deviation (flat rows only centred)."""

    def scaled(z: Column) -> Column:
        sd = F.sqrt(array_sum(F.transform(z, lambda v: v * v)) / F.greatest(F.size(z) - 1, F.lit(1)))
        return let(F.when(sd < FLAT, F.lit(1.0)).otherwise(sd), lambda by: F.transform(z, lambda v: v / by))

    def centred(x: Column) -> Column:
        return let(array_sum(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m))

    return df.withColumn(name, let(feature_array(df, features), lambda x: let(centred(x), scaled)))


def vector_norm(df: DataFrame, features: Features, name: str = "unit") -> DataFrame:
    """Row over its Euclidean length, unless that is almost zero."""

    def scaled(x: Column) -> Column:
        length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
        return let(F.when(length > FLAT, length).otherwise(F.lit(1.0)), lambda by: F.transform(x, lambda v: v / by))

    return df.withColumn(name, let(feature_array(df, features), scaled))


def savgol(
    df: DataFrame, features: Features, window: int, order: int, deriv: int = 0, name: str = "smooth"
) -> DataFrame:
    """Savitzky–Golay along the row: one banded matrix product per Arrow batch."""
    smoothing_matrix(window, window, order, deriv)  # argument check before the job starts

    rows = df.withColumn(name, feature_array(df, features))
    names, at = list(rows.columns), rows.columns.index(name)

    def smooth(batches):
        for b in batches:
            x = b.column(at)
            lengths = np.diff(x.offsets.to_numpy())
            if x.null_count or len(set(lengths)) > 1:
                raise ValueError("smoothing needs complete rows of equal length")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), -1)
            if not np.isfinite(x).all():
                raise ValueError("smoothing needs complete rows")
            y = x @ smoothing_matrix(x.shape[1], window, order, deriv).T if len(x) else x
            offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            done = pa.ListArray.from_arrays(offsets, pa.array(y.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([done if i == at else c for i, c in enumerate(b.columns)], names=names)

    return rows.mapInArrow(smooth, rows.schema)


def apply_row_stage(df: DataFrame, features: Features, stage: RowStage, name: str = "_row") -> DataFrame:
    """SNV or vector norm (SNV wins), then smoothing, into one array column."""
    out = df.withColumn(name, feature_array(df, features))
    if stage.snv:
        out = snv(out, name, name)
    elif stage.vector_norm:
        out = vector_norm(out, name, name)
    if stage.sg_window:
        out = savgol(out, name, stage.sg_window, stage.sg_order, stage.sg_deriv, name)
    return out


def preview_row_stage(df: DataFrame, features: Features, stage: RowStage, order_col: str, n: int = 10) -> DataFrame:
    return apply_row_stage(df.orderBy(order_col).limit(n), features, stage, "preview")


@dataclass(frozen=True)
class ColumnStage:
    """The affine view of every scaling: (x - center) / divisor."""

    features: tuple[str, ...]
    center: tuple[float, ...]
    divisor: tuple[float, ...]


def element_columns(df: DataFrame, features: Features, m: int) -> DataFrame:
    if isinstance(features, str):
        return df.select(*[F.element_at(features, i + 1).cast("double").alias(f"f{i}") for i in range(m)])
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])


def robust_stats(df: DataFrame, features: Features, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Empirical median and 1.4826·MAD of every column, gaps skipped."""
    flat = element_columns(df, features, m)
    med = [q[0] or 0.0 for q in quantiles(flat, flat.columns, [0.5], how="lower").values()]
    dev = flat.select(*[F.abs(F.col(f"f{i}") - F.lit(float(c))).alias(f"f{i}") for i, c in enumerate(med)])
    mad = [MAD_SCALE * (q[0] or 0.0) for q in quantiles(dev, dev.columns, [0.5], how="lower").values()]
    return np.array(med), floor_at_one(np.array(mad))


def fit_columns(df: DataFrame, cols: Sequence[str], scaling: str = "standard") -> ColumnStage:
    """``none``, ``center``, ``standard``, ``scale`` (no centring) or ``robust``; gaps are skipped."""
    m = len(cols)
    if scaling == "robust":
        center, divisor = robust_stats(df, cols, m)
    else:
        row = df.agg(
            *[F.avg(f"`{c}`").alias(f"a{i}") for i, c in enumerate(cols)],
            *[F.stddev_samp(f"`{c}`").alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        mean = np.array([row[f"a{i}"] or 0.0 for i in range(m)])
        sd = np.array([row[f"s{i}"] or 0.0 for i in range(m)])
        center, divisor = stage_numbers(mean, sd, scaling)
    return ColumnStage(tuple(cols), tuple(map(float, center)), tuple(map(float, divisor)))


def stage_numbers(mean: np.ndarray, sd: np.ndarray, scaling: str) -> tuple[np.ndarray, np.ndarray]:
    zero, one = np.zeros(len(mean)), np.ones(len(mean))
    table = {
        "none": (zero, one),
        "center": (mean, one),
        "standard": (mean, floor_at_one(sd)),
        "scale": (zero, floor_at_one(sd)),
    }
    if scaling not in table:
        raise ValueError(f"unknown scaling {scaling!r}")
    return table[scaling]


def apply_columns(df: DataFrame, stage: ColumnStage) -> DataFrame:
    return df.withColumns(
        {
            c: (F.col(f"`{c}`") - F.lit(a)) / F.lit(b)
            for c, a, b in zip(stage.features, stage.center, stage.divisor)
        }
    )


def invert_columns(df: DataFrame, stage: ColumnStage) -> DataFrame:
    """Undo the column stage; a row stage loses information and has no inverse."""
    return df.withColumns(
        {
            c: F.col(f"`{c}`") * F.lit(b) + F.lit(a)
            for c, a, b in zip(stage.features, stage.center, stage.divisor)
        }
    )
