"""Principal components of lagged windows (multichannel singular spectrum analysis)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.operators.pca import PCAModel, _complete
from eigenframe.operators.rowstage import ColumnStage, RowStage, apply_columns, fit_columns
from eigenframe.operators.scoring import score
from eigenframe.operators.windows import lag_columns, lag_embed
from eigenframe.plans.dense import top_eigen
from eigenframe.plans.gram import moments

WARN_BYTES = 2 * 1024**3


@dataclass(frozen=True)
class LaggedModel:
    stage: ColumnStage
    cols: tuple[str, ...]
    lags: int
    pca: PCAModel  # over the lagged columns, neither centred nor scaled again

    @property
    def k(self) -> int:
        return self.pca.k


def lagged_bytes(rows: int, cols: int, lags: int) -> dict:
    """What holding all windows would take; Spark streams them, so this only informs."""
    size = max(rows - lags + 1, 0) * cols * lags * 8 * 1.25
    return {"bytes": size, "large": size > WARN_BYTES}


def fit_lagged_pca(
    df: DataFrame,
    cols: Sequence[str],
    lags: int,
    order_by: Sequence[str],
    k: int | None = None,
    target_variance: float | None = None,
    partition_by: Sequence[str] = (),
    scaling: str = "standard",
    row_stage: RowStage | None = None,
) -> LaggedModel:
    """k by count, or the fewest components whose share reaches ``target_variance``.

    Series must have no gaps: a missing cell fails the fit.
    """
    if row_stage is not None and row_stage.active:
        raise ValueError("row stages do not apply to lagged windows")
    if (k is None) == (target_variance is None):
        raise ValueError("give k or target_variance")
    stage = fit_columns(_complete(df, cols), cols, scaling)
    names = lag_columns(cols, lags)
    windows = _complete(lag_embed(apply_columns(df, stage), cols, lags, order_by, partition_by), names)
    mom = moments(windows, names)
    if mom.n < 1:
        raise ValueError(f"no series is as long as {lags} lags")
    n = int(mom.n)
    raw = (mom.scatter + n * np.outer(mom.mean, mom.mean)) / max(n - 1, 1)
    full, v = top_eigen(raw)
    full = full[: min(n, len(names))]
    share = np.cumsum(full) / full.sum() if full.sum() > 0 else np.ones(len(full))
    if k is None:
        k = int(np.searchsorted(share, target_variance - 1e-12) + 1)
    k = min(k, len(full))
    m = len(names)
    pca = PCAModel(
        method="lagged",
        features=tuple(names),
        width=m,
        k=k,
        n=n,
        scaling="none",
        center=np.zeros(m),
        divisor=np.ones(m),
        loadings=v[:, :k],
        eigenvalues=full[:k],
        all_eigenvalues=full,
        ratio=full[:k] / full.sum() if full.sum() > 0 else np.zeros(k),
        limits={f"{a}_{b}": 0.0 for a in ("t2", "q") for b in ("95", "99")},
    )
    return LaggedModel(stage, tuple(cols), lags, pca)


def score_lagged(
    df: DataFrame, model: LaggedModel, order_by: Sequence[str], partition_by: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Scores of every full window, with the root mean squared reconstruction error of the window."""
    carried = list(dict.fromkeys([*partition_by, *order_by, *keep]))
    windows = lag_embed(apply_columns(df, model.stage), model.cols, model.lags, order_by, partition_by, keep=keep)
    scored = score(windows, model.pca, carried)
    return scored.withColumn("rms_error", F.sqrt(F.col("q") / model.pca.width)).drop("t2", "q")


def lagged_loadings(spark: SparkSession, model: LaggedModel) -> DataFrame:
    """``(component, lag, variable, loading)``, the table the summaries below read."""
    rows = [
        (j + 1, lag, c, float(model.pca.loadings[lag * len(model.cols) + i, j]))
        for j in range(model.k)
        for lag in range(model.lags)
        for i, c in enumerate(model.cols)
    ]
    return spark.createDataFrame(rows, "component int, lag int, variable string, loading double")


def variable_importance(loadings: DataFrame) -> DataFrame:
    """Root mean squared loading of a variable over its lags."""
    return loadings.groupBy("component", "variable").agg(
        F.sqrt(F.avg(F.col("loading") * F.col("loading"))).alias("importance")
    )


def lag_contribution(loadings: DataFrame) -> DataFrame:
    """Share of each lag in the squared loadings of a component."""
    per = loadings.groupBy("component", "lag").agg(F.sum(F.col("loading") * F.col("loading")).alias("ss"))
    total = loadings.groupBy("component").agg(F.sum(F.col("loading") * F.col("loading")).alias("total"))
    return per.join(total, "component").select(
        "component", "lag", F.coalesce(F.try_divide("ss", "total"), F.lit(0.0)).alias("share")
    )


def dominant_profile(loadings: DataFrame) -> DataFrame:
    """Loadings over the lags of the variable with the largest importance, per component."""
    top = variable_importance(loadings).groupBy("component").agg(
        F.min_by("variable", F.struct(-F.col("importance"), F.col("variable"))).alias("variable")
    )
    return loadings.join(top, ["component", "variable"])


def loading_at(loadings: DataFrame, variable: str, lag: int, component: int) -> DataFrame:
    return loadings.filter((F.col("variable") == variable) & (F.col("lag") == lag) & (F.col("component") == component))
