"""Principal components from one aggregated Gram matrix."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.operators.rowstage import Features, RowStage, apply_row_stage, robust_stats, stage_numbers
from eigenframe.plans.dense import fix_signs, nipals, q_limit_of_sums, t2_limit, top_eigen
from eigenframe.plans.durable import discard, durable
from eigenframe.plans.gram import MAX_WIDTH, feature_array, first_width, moments, tall_skinny_r
from eigenframe.plans.products import MISSING, Problem, Rows, Spectrum, leading, rest_sums

ILL_CONDITIONED = 1e-10
_DUAL_BLOCK = 256


@dataclass(frozen=True)
class Regression:
    """A response attached to a model: coefficients per score, and per variable when possible."""

    response: str
    k: int
    gamma: tuple[float, ...]
    intercept: float
    beta: tuple[float, ...] = ()
    beta0: float = 0.0
    beta_valid: bool = False
    rmsec: float = 0.0
    r2c: float = 0.0


@dataclass(frozen=True)
class PCAModel:
    """Everything needed to score rows; size depends on the variables only."""

    method: str
    features: tuple[str, ...]  # one name if the variables live in an array column
    width: int
    k: int
    n: int
    scaling: str
    center: np.ndarray
    divisor: np.ndarray
    loadings: np.ndarray  # width × k
    eigenvalues: np.ndarray  # k
    all_eigenvalues: np.ndarray
    ratio: np.ndarray
    row_stage: RowStage = field(default_factory=RowStage)
    score_mean: np.ndarray | None = None
    score_cov: np.ndarray | None = None
    variable_sd: np.ndarray | None = None  # of the preprocessed variables
    variable_score_cov: np.ndarray | None = None
    limits: dict[str, float] = field(default_factory=dict)
    regression: Regression | None = None
    history: tuple | None = None  # of a fit to rows with gaps

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.ratio)

    @property
    def labels(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.k)]

    @property
    def source(self) -> Features:
        """The features argument to read rows with."""
        return self.features[0] if len(self.features) == 1 and self.width > 1 else list(self.features)

    @property
    def variables(self) -> list[str]:
        return list(self.features) if len(self.features) == self.width else [f"v{i}" for i in range(self.width)]

    def with_regression(self, regression: Regression) -> PCAModel:
        return replace(self, regression=regression)


def fit_pca(
    df: DataFrame,
    features: Features,
    k: int,
    method: str = "svd",
    scaling: str = "standard",
    row_stage: RowStage | None = None,
    solver: str = "auto",
    missing: str = "error",
) -> PCAModel:
    """Fit components; ``missing`` says what to do about gaps first.

    ``error`` fails on a gap, ``drop``, ``mean``, ``median`` and ``zero`` remove or
    fill them, ``native`` fits around them (see :mod:`eigenframe.operators.gappy`).

    ``method="svd"`` gives the full spectrum. ``method="nipals"`` extracts one
    component at a time and spreads what is left evenly over the rest.
    """
    stage = row_stage or RowStage()
    names = (features,) if isinstance(features, str) else tuple(features)
    if missing == "native":
        from eigenframe.operators.gappy import fit_pca_missing

        if stage.active:
            raise ValueError("row stages need complete rows")
        return fit_pca_missing(df, features, k, scaling)
    if missing != "error":
        from eigenframe.operators.missing import impute

        if isinstance(features, str):
            raise ValueError("gaps inside an array column: only 'error' or 'native'")
        df = impute(df, list(features), missing)
    rows = apply_row_stage(df, features, stage).select("_row") if stage.active else df
    source = "_row" if stage.active else features
    m = first_width(df, features, MAX_WIDTH)
    if m < 1 or k < 1:
        raise ValueError("need at least one variable and one component")
    if m > MAX_WIDTH:
        if scaling == "robust" or method != "svd":
            raise ValueError(f"more than {MAX_WIDTH} variables: only the svd method with plain scaling")
        return _fit_very_wide(rows, source, names, m, k, scaling, stage)
    checked = _complete(rows, source)
    mom = moments(checked, source)
    _check_size(mom.n, m, k)
    if scaling == "robust":
        center, divisor = robust_stats(checked, source, m)
    else:
        center, divisor = stage_numbers(mom.mean, mom.sd, scaling)
    n = int(mom.n)
    offset = (mom.mean - center) / divisor
    cov = mom.cov / np.outer(divisor, divisor)
    # Products about the chosen centre: the mean differs from it under "robust", "scale" and "none".
    around = cov + np.outer(offset, offset) * n / (n - 1)
    if method == "nipals":
        lam, p, rest = nipals(around * (n - 1), offset * n, n, min(k, n, m))
        left = m - len(lam)
        tail = np.full(left, rest / (n - 1) / left) if left else np.zeros(0)
        full = np.concatenate([lam, tail])
    elif method == "svd":
        full, v = top_eigen(around)
        small = full[min(n - 1, m) - 1] < ILL_CONDITIONED * full[0]
        if solver == "tsqr" or (solver == "auto" and small and full[0] > 0):
            r = tall_skinny_r(checked, source, center, divisor)
            _u, s, vt = np.linalg.svd(r, full_matrices=False)
            full, v = np.zeros(m), np.zeros((m, m))
            full[: len(s)], v[:, : len(s)] = s**2 / (n - 1), fix_signs(vt.T)
        full = full[: min(n, m)]
        k = min(k, len(full))
        lam, p = full[:k], v[:, :k]
    else:
        raise ValueError(f"unknown method {method!r}")
    return _model(
        df.sparkSession, method, names, m, n, scaling, center, divisor, stage, lam, fix_signs(p), full,
        p_mean=offset, cov=cov,
    )


def _model(spark, method, names, m, n, scaling, center, divisor, stage, lam, p, full, p_mean, cov, rest=None) -> PCAModel:
    """``rest``: sums of the eigenvalues past k, their squares and cubes, where ``full`` does not hold them all."""
    k, total = len(lam), float(np.sum(full))
    rest = rest or [float(np.sum(full[k:] ** i)) for i in (1, 2, 3)]
    limits = {f"t2_{int(a * 100)}": t2_limit(spark, a, n, k) for a in (0.95, 0.99)}
    limits |= {f"q_{int(a * 100)}": q_limit_of_sums(a, rest) for a in (0.95, 0.99)}
    limits["t2_999"] = t2_limit(spark, 0.999, n, k)
    return PCAModel(
        method=method,
        features=names,
        width=m,
        k=k,
        n=n,
        scaling=scaling,
        center=np.asarray(center, float),
        divisor=np.asarray(divisor, float),
        loadings=p,
        eigenvalues=lam,
        all_eigenvalues=full,
        ratio=lam / total if total > 0 else np.zeros(k),
        row_stage=stage,
        score_mean=p.T @ p_mean if p_mean is not None else None,
        score_cov=p.T @ cov @ p if cov is not None else None,
        variable_sd=np.sqrt(np.maximum(np.diag(cov), 0)) if cov is not None else None,
        variable_score_cov=cov @ p if cov is not None else None,
        limits=limits,
    )


def _check_size(n: float, m: int, k: int) -> None:
    if n < 2:
        raise ValueError(f"need at least 2 rows, found {int(n)}")
    if k > min(n, m):
        raise ValueError(f"{k} components exceed min(rows, variables) = {int(min(n, m))}")


def _complete(df: DataFrame, features: Features) -> DataFrame:
    """Fail inside the scan when a cell is missing, instead of scanning once more to check."""
    message = F.raise_error(F.lit(MISSING))
    if isinstance(features, str):
        values = F.col(features).cast("array<double>")
        # NULL if a cell is NULL, and NaN equals NaN: one loop of generated code instead of a lambda per cell.
        bad = F.array_contains(values, float("nan"))
        return df.withColumn(features, F.when(F.coalesce(bad, F.lit(True)), message.cast("array<double>")).otherwise(values))
    fixed = {}
    for c in features:
        v = F.col(f"`{c}`").cast("double")
        fixed[c] = F.coalesce(F.when(~F.isnan(v), v), message.cast("double"))
    return df.withColumns(fixed)


@dataclass(frozen=True)
class Whole:
    """All rows as one problem, with the means and standard deviations of the columns, and maybe its components."""

    shift: np.ndarray
    problem: Problem
    mean: np.ndarray
    sd: np.ndarray
    found: Spectrum | None = None


def wide_problem(shift: np.ndarray, parts: dict, m: int, k: int, scaling: str) -> Whole:
    n = sum(p[0] for p in parts.values())
    _check_size(n, m, k)
    mean_off = sum(p[1] for p in parts.values()) / n
    sd = np.sqrt(np.maximum(sum(p[2] for p in parts.values()) - n * mean_off**2, 0.0) / (n - 1))
    mean = shift + mean_off
    return Whole(shift, Problem(None, n, *map(np.asarray, stage_numbers(mean, sd, scaling))), mean, sd)


def _fit_very_wide(df, source, names, m, k, scaling, stage, rows: Rows | None = None, whole: Whole | None = None) -> PCAModel:
    """More variables than a square matrix allows: n×n products, or products of the rows with a few vectors.

    ``rows`` are those of ``df``, if the caller has packed them already; ``whole`` is what it has found of them.
    """
    x, own = feature_array(df, source), rows is None
    # Several scans follow: row stages are worked out once, and cells are checked as they are packed.
    rows = Rows(df, x, m).packed(k) if own else rows
    whole = whole or wide_problem(*rows.centred_sums(), m, k, scaling)
    shift, problem, mean, sd = whole.shift, whole.problem, whole.mean, whole.sd
    n, center, divisor = problem.n, problem.center, problem.divisor
    spark, offset = df.sparkSession, (mean - center) / divisor
    if n <= MAX_WIDTH:
        full, p = _dual(df, x, m, n, center, divisor, k)
        rest = None
    else:
        found = whole.found.first(k) if whole.found else leading(rows, shift, [problem], k)[0]
        total = float(np.sum((sd / divisor) ** 2 + offset**2 * n / (n - 1)))
        rest, p = rest_sums(rows, shift, problem, found, total), fix_signs(found.vectors)
        known = np.append(found.eigenvalues, found.found[k:])[: min(n, m)]
        left = min(n, m) - len(known)
        full = np.append(known, np.full(left, max(total - known.sum(), 0.0) / left)) if left else known
    lam = full[:k]
    if own:
        discard(rows.df)
    out = _model(spark, "svd", names, m, n, scaling, center, divisor, stage, lam, p, full, None, None, rest)
    mean_t = p.T @ offset
    spread = np.outer(offset, mean_t) * n / (n - 1)
    return replace(
        out, score_mean=mean_t, score_cov=np.diag(lam) - np.outer(mean_t, mean_t) * n / (n - 1), variable_sd=sd / divisor,
        variable_score_cov=p * lam - spread,
    )


def _dual(df, x, m, n, center, divisor, k):
    """Few rows: add up the n×n row products over blocks of columns, then map back."""
    c, d = np.asarray(center), np.asarray(divisor)
    blocks = -(-m // _DUAL_BLOCK)
    numbered = df.select(F.monotonically_increasing_id().alias("r"), x.alias("x"))
    numbered = durable(numbered)
    cut = numbered.select(
        "r",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(blocks - 1)),
                lambda b: F.slice("x", b * _DUAL_BLOCK + 1, _DUAL_BLOCK),
            )
        ).alias("b", "part"),
    )

    def block_of(key, t):
        b = int(key[0].as_py())
        t = t.sort_by("r")
        at = slice(b * _DUAL_BLOCK, min((b + 1) * _DUAL_BLOCK, m))
        return (np.array(t.column("part").to_pylist()) - c[at]) / d[at]

    def products(key, t):
        z = block_of(key, t)
        g = z @ z.T
        return pa.table({"i": np.arange(len(g), dtype=np.int32), "row": pa.array(list(g), pa.list_(pa.float64()))})

    rows = (
        cut.groupBy("b").applyInArrow(products, "i int, row array<double>")
        .select("i", F.posexplode("row").alias("j", "v"))
        .groupBy("i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    k_mat = np.zeros((n, n))
    k_mat[rows["i"], rows["j"]] = rows["v"]
    w, u = np.linalg.eigh(k_mat)
    w, u = np.maximum(w[::-1], 0.0), u[:, ::-1]
    back = u[:, :k] / np.sqrt(np.maximum(w[:k], 1e-300))

    def loadings(key, t):
        z = block_of(key, t)
        p = z.T @ back
        first = int(key[0].as_py()) * _DUAL_BLOCK
        i = np.arange(first, first + len(p), dtype=np.int32)
        return pa.table({"i": i, "p": pa.array(list(p), pa.list_(pa.float64()))})

    got = cut.groupBy("b").applyInArrow(loadings, "i int, p array<double>").orderBy("i").collect()
    p = np.array([r["p"] for r in got])
    return w / (n - 1), fix_signs(p)


# --- small tables read off a model -------------------------------------------------


def explained_variance(spark: SparkSession, model: PCAModel) -> DataFrame:
    rows = [
        (lab, float(e), float(r), float(c))
        for lab, e, r, c in zip(model.labels, model.eigenvalues, model.ratio, model.cumulative)
    ]
    return spark.createDataFrame(rows, "component string, eigenvalue double, ratio double, cumulative double")


def loadings_table(spark: SparkSession, model: PCAModel) -> DataFrame:
    rows = [
        (v, j + 1, float(model.loadings[i, j]))
        for i, v in enumerate(model.variables)
        for j in range(model.k)
    ]
    return spark.createDataFrame(rows, "variable string, component int, loading double")


def variable_correlations(spark: SparkSession, model: PCAModel) -> DataFrame:
    """Pearson of every preprocessed variable with every score, from the moments of the fit."""
    if model.variable_score_cov is None:
        raise ValueError("the model keeps no moments of its variables")
    scale = np.outer(model.variable_sd, np.sqrt(np.maximum(np.diag(model.score_cov), 0)))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(scale > 0, model.variable_score_cov / scale, 0.0)
    rows = [
        (v, j + 1, float(np.clip(r[i, j], -1, 1)))
        for i, v in enumerate(model.variables)
        for j in range(model.k)
    ]
    return spark.createDataFrame(rows, "variable string, component int, r double")
