"""Applying models: narrow plans that read the same on tables and on streams."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.functions.parsing import finite
from eigenframe.operators.pca import PCAModel
from eigenframe.operators.rowstage import apply_row_stage
from eigenframe.plans.gram import feature_array, pieces

_CHUNK = 1 << 18  # cells of rows predicted at once inside a task: 2 MB, which a core's caches hold
EXPRESSION_CELLS = 400  # width × k up to which scores stay generated Java code


def align(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """The model's variables by name and in its order; other columns go, absent ones are an error."""
    absent = [c for c in model.features if c not in df.columns]
    if absent:
        raise ValueError(f"columns the model needs are absent: {', '.join(absent)}")
    return df.select(*[c for c in keep if c not in model.features], *model.features)


def _linear(terms: list[Column], weights: np.ndarray, start: float = 0.0) -> Column:
    out = F.lit(float(start))
    for t, w in zip(terms, weights):
        out = out + t * F.lit(float(w))
    return out


def score(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``pc1…pck``, ``t2`` (Σ t²/λ) and ``q`` (squared residual) for every row.

    ``keep`` names the columns to carry along; the scan reads those and the
    model's variables only. A row with a gap (a NULL or non-finite cell, or a NULL
    array) has NULL scores, whatever the size of the model.
    """
    aligned = align(df, model, keep)
    if model.width * model.k <= EXPRESSION_CELLS and not model.row_stage.active and not isinstance(model.source, str):
        return _score_expressions(aligned, model, keep)
    return _score_batches(aligned, model, keep)


def _score_expressions(df: DataFrame, model: PCAModel, keep: Sequence[str]) -> DataFrame:
    z = [
        ((finite(F.col(f"`{c}`")) - F.lit(float(a))) / F.lit(float(b))).alias(f"_z{i}")
        for i, (c, a, b) in enumerate(zip(model.features, model.center, model.divisor))
    ]
    staged = df.select(*keep, *z)
    zs = [F.col(f"_z{i}") for i in range(model.width)]
    pcs = [_linear(zs, model.loadings[:, j]).alias(f"pc{j + 1}") for j in range(model.k)]
    staged = staged.select(*keep, *zs, *pcs)
    ts = [F.col(f"pc{j + 1}") for j in range(model.k)]
    q = sum(((z - _linear(ts, model.loadings[i])) ** 2 for i, z in enumerate(zs)), F.lit(0.0))
    return staged.select(*keep, *ts, _t2(ts, model).alias("t2"), q.alias("q"))


def _t2(ts: list[Column], model: PCAModel) -> Column:
    return sum((t * t / F.lit(float(lam)) for t, lam in zip(ts, model.eigenvalues) if lam > 0), F.lit(0.0))


def _score_batches(df: DataFrame, model: PCAModel, keep: Sequence[str]) -> DataFrame:
    rows = _array_rows(df, model, keep)
    c, d, p, m, k = model.center, model.divisor, model.loadings, model.width, model.k
    lam = np.where(model.eigenvalues > 0, model.eigenvalues, np.inf)
    extra = [T.StructField(f"pc{j + 1}", T.DoubleType()) for j in range(k)]
    extra += [T.StructField("t2", T.DoubleType()), T.StructField("q", T.DoubleType())]
    schema = T.StructType(rows.select(*keep).schema.fields + extra)

    def project(batches):
        for b in pieces(batches, m):
            x, gap = _cells_and_gaps(b.column(len(keep)), m)
            z = (x - c) / d
            t = z @ p
            cols = [b.column(i) for i in range(len(keep))] + [pa.array(t[:, j], mask=gap) for j in range(k)]
            cols += [pa.array((t**2 / lam).sum(axis=1), mask=gap), pa.array(((z - t @ p.T) ** 2).sum(axis=1), mask=gap)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return rows.mapInArrow(project, schema)


def reconstruct(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """Rows rebuilt from their scores, in the units of the data (row stages are not undone)."""
    scored = score(df, model, keep)
    ts = [F.col(f"pc{j + 1}") for j in range(model.k)]
    back = [
        (_linear(ts, model.loadings[i]) * F.lit(float(model.divisor[i])) + F.lit(float(model.center[i]))).alias(v)
        for i, v in enumerate(model.variables)
    ]
    return scored.select(*keep, *back)


def predict(df: DataFrame, model: PCAModel, keep: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """One dot product with original-scale coefficients when they exist, else via the scores."""
    reg = model.regression
    if reg is None:
        raise ValueError("the model carries no regression")
    if reg.beta_valid and not isinstance(model.source, str):
        xs = [F.col(f"`{c}`").cast("double") for c in model.features]
        return align(df, model, keep).select(*keep, _linear(xs, np.array(reg.beta), reg.beta0).alias(name))
    if model.row_stage.active or isinstance(model.source, str):
        return _predict_batches(align(df, model, keep), model, keep, name)
    ts = [F.col(f"pc{j + 1}") for j in range(reg.k)]
    return score(df, model, keep).select(*keep, _linear(ts, np.array(reg.gamma), reg.intercept).alias(name))


def _predict_batches(df: DataFrame, model: PCAModel, keep: Sequence[str], name: str) -> DataFrame:
    """The regression on the scores as one weight per variable: one product per row, no scores on the way."""
    reg, c, m = model.regression, model.center, model.width
    w = model.loadings[:, : reg.k] @ np.array(reg.gamma) / model.divisor
    rows = _array_rows(df, model, keep)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField(name, T.DoubleType())])

    def project(batches):
        for b in pieces(batches, m, _CHUNK):
            x, gap = _cells_and_gaps(b.column(len(keep)), m)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array((x - c) @ w + reg.intercept, mask=gap)], names=[f.name for f in schema.fields])

    return rows.mapInArrow(project, schema)


def _array_rows(df: DataFrame, model: PCAModel, keep: Sequence[str]) -> DataFrame:
    """The columns to keep, then the variables as one array."""
    rows = apply_row_stage(df, model.source, model.row_stage, "_x") if model.row_stage.active else df.withColumn(
        "_x", feature_array(df, model.source)
    )
    return rows.select(*keep, "_x")


def _cells_and_gaps(lists: pa.Array, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of an array column, 0 in rows with a NULL or non-finite cell, and which rows those are."""
    if lists.null_count:
        x = np.full((len(lists), m), np.nan)
        x[lists.is_valid().to_numpy(zero_copy_only=False)] = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
    else:
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
    gap = ~np.isfinite(x).all(axis=1)
    return np.where(gap[:, None], 0.0, x) if gap.any() else x, gap


# --- diagnostics on scored rows -----------------------------------------------------


def with_fit_diagnostics(scored: DataFrame, model: PCAModel) -> DataFrame:
    """``t2_fit`` about the training mean with a regularised covariance, its root, and the outlier flag."""
    cov, mean = model.score_cov, model.score_mean
    ridge = 1e-3 if model.k > model.n // 2 else 1e-4
    try:
        inv = np.linalg.inv(cov + ridge * np.eye(model.k))
    except np.linalg.LinAlgError:
        inv = np.linalg.inv(cov + 11 * ridge * np.eye(model.k))
    d = [F.col(f"pc{j + 1}") - F.lit(float(mean[j])) for j in range(model.k)]
    t2 = sum((d[a] * _linear(d, inv[a]) for a in range(model.k)), F.lit(0.0))
    limit = model.limits.get("t2_999", 0.0)
    return (
        scored.withColumn("t2_fit", t2)
        .withColumn("mahalanobis", F.sqrt(F.greatest(F.col("t2_fit"), F.lit(0.0))))
        .withColumn("outlier", (F.col("t2_fit") > F.lit(limit)) if limit > 0 else F.lit(False))
    )


def outside(model_limits: dict[str, float], level: str = "95") -> Column:
    """T² or Q above its limit; a limit of 0 means there is none."""
    flags = [
        F.col(c) > F.lit(float(model_limits[f"{c}_{level}"])) for c in ("t2", "q") if model_limits[f"{c}_{level}"] > 0
    ]
    return flags[0] | flags[1] if len(flags) == 2 else flags[0] if flags else F.lit(False)


def with_outside(scored: DataFrame, model: PCAModel) -> DataFrame:
    return scored.withColumn("outside", outside(model.limits))


def outside_counts(flagged: DataFrame, model: PCAModel) -> DataFrame:
    above = lambda c: (
        F.count_if(F.col(c) > F.lit(model.limits[f"{c}_95"])) if model.limits[f"{c}_95"] > 0 else F.lit(0).cast("long")
    )
    return flagged.agg(
        F.count("*").alias("n"),
        above("t2").alias("above_t2"),
        above("q").alias("above_q"),
        F.count_if("outside").alias("outside"),
    )


def double_outliers(scored: DataFrame, model: PCAModel, level: str = "95") -> DataFrame:
    """Rows above both limits."""
    return scored.filter(
        (F.col("t2") > F.lit(model.limits[f"t2_{level}"])) & (F.col("q") > F.lit(model.limits[f"q_{level}"]))
    )


def regression_metrics(
    df: DataFrame, pred: str = "predicted", y: str = "measured", by: Sequence[str] = ()
) -> DataFrame:
    """n, RMSE, bias, SEP, MAE and R² in one aggregate; rows without a response are skipped."""
    e = F.col(pred) - F.col(y)
    seen = df.filter(F.col(pred).isNotNull() & F.col(y).isNotNull()).withColumn("_e", e)
    n = F.count("*")
    return seen.groupBy(*by).agg(
        n.alias("n"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg("_e").alias("bias"),
        F.coalesce(F.stddev_samp("_e"), F.lit(0.0)).alias("sep"),
        F.avg(F.abs("_e")).alias("mae"),
        F.when(F.var_pop(y) > 0, 1 - F.avg(F.col("_e") * F.col("_e")) / F.var_pop(y)).otherwise(0.0).alias("r2"),
    )


def prediction_error(df: DataFrame, pred: str, y: str, flag: str = "outside") -> DataFrame:
    """The error split into rows inside, outside, and all together."""
    labelled = df.withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col(flag), "outside").otherwise("inside"))))
    return regression_metrics(labelled, pred, y, ["part"]).select(
        "part", "n", F.col("rmse").alias("rmsep"), "bias", "sep", "r2"
    )


def farthest(df: DataFrame, x: str, y: str, n: int) -> DataFrame:
    """The n distinct points farthest from the origin."""
    return (
        df.select(x, y).dropDuplicates([x, y])
        .withColumn("distance", F.hypot(x, y))
        .orderBy(F.desc("distance"), x, y)
        .limit(n)
    )


def top_contributors(df: DataFrame, id_col: str, score_col: str, n: int = 20) -> DataFrame:
    return (
        df.select(id_col, F.abs(score_col).alias("contribution"))
        .orderBy(F.desc("contribution"), id_col)
        .limit(n)
    )
