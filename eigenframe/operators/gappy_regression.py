"""Component regression on predictors with gaps.

Least squares over observed cells has no moments to subtract, so every fold has a NIPALS
fit of its own; the fits of all folds share their passes (:mod:`eigenframe.operators.gappy_folds`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.operators import gappy_folds
from eigenframe.operators.gappy import fit_pca_missing, score_missing
from eigenframe.operators.pca import PCAModel, Regression
from eigenframe.operators.regression import (
    _FOLD_SCHEMA,
    CV,
    PCRResult,
    _curve_from_folds,
    _fold_errors,
    _limit,
    _points,
    assign_folds,
    choose_k,
    curve_notes,
)
from eigenframe.plans.dense import nested_fits
from eigenframe.plans.gram import moments

def _fit(pool: DataFrame, labelled: DataFrame, features: Sequence[str], k: int, scaling: str):
    """Components of ``pool`` and the regression of the labelled rows on 0…k of them."""
    model = fit_pca_missing(pool, features, k, scaling)
    pcs = [f"pc{j + 1}" for j in range(model.k)]
    mom = moments(score_missing(labelled, model, ["_y"]), [*pcs, "_y"])
    m = model.k
    return model, nested_fits(mom.scatter[:m, :m], mom.scatter[:m, m], mom.mean[:m], mom.mean[m], m), mom


def _predictions(rows: DataFrame, model: PCAModel, gammas: Sequence[np.ndarray], keep: Sequence[str]) -> DataFrame:
    scored = score_missing(rows, model, keep)
    values = []
    for g in gammas:
        v = F.lit(float(g[0]))
        for j, w in enumerate(g[1:]):
            v = v + F.col(f"pc{j + 1}") * F.lit(float(w))
        values.append(v)
    return scored.select(*keep, F.array(*values).alias("predictions"))


def fit_pcr_missing(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    k: int | None = None,
    cv: CV | None = None,
    rule: str = "one-se",
    metric: str = "rmse",
    tolerance: float = 0.0,
    wold_r: float = 1.0,
    scaling: str = "standard",
    max_components: int | None = None,
) -> PCRResult:
    """As :func:`fit_pcr`, for rows with gaps; predict with :func:`predict_missing`."""
    if (k is None) == (cv is None):
        raise ValueError("give k or cv")
    if scaling in ("none", "scale"):
        raise ValueError("the regression needs centred variables")
    features = list(features)
    carry = list(dict.fromkeys([*(cv.order_by if cv else ()), *([cv.group_by] if cv and cv.group_by else [])]))
    target = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")).alias("_y")
    base = df.select(*dict.fromkeys([*carry, *features]), target)
    size = base.agg(F.count("_y").alias("lab"), F.count("*").alias("n")).first()
    labelled, n = int(size["lab"]), int(size["n"])
    if labelled < 3:
        raise ValueError(f"need at least 3 rows with a response, found {labelled}")
    limit = _limit(base, labelled, len(features), cv, max_components or k)
    curve = oof = None
    notes: dict = {}
    if cv is not None:
        preds = gappy_folds.cross_validate(base, assign_folds(base.filter("_y is not null"), cv), features, cv, limit, scaling)
        per_fold = _fold_errors(preds, limit).collect()  # folds × component counts
        curve = _curve_from_folds(df.sparkSession.createDataFrame(per_fold, _FOLD_SCHEMA))
        k = choose_k(_points(curve.orderBy("k").collect(), metric), rule, tolerance, wold_r)
        notes = curve_notes(curve, rule, metric, tolerance=tolerance, wold_r=wold_r) | {"rule": rule, "metric": metric}
        oof = preds.filter("repeat = 0").withColumn("predicted", F.element_at("predictions", k + 1)).select(
            *cv.order_by, "fold", "predicted", F.col("_y").alias("measured")
        )
    if k > limit:
        raise ValueError(f"{k} components: at most {limit}")
    model, gammas, mom = _fit(base, base.filter("_y is not null"), features, max(k, 1), scaling)
    k = min(k, len(gammas) - 1)
    g, m = gammas[k], model.k
    w = np.concatenate([-g[1:], np.zeros(m - k), [1.0]])
    sse, tss = float(w @ mom.scatter @ w), float(mom.scatter[m, m])
    reg = Regression(
        y, k, tuple(map(float, g[1:])), float(g[0]), rmsec=float(np.sqrt(max(sse, 0.0) / mom.n)),
        r2c=1 - sse / tss if tss > 0 else 0.0,
    )
    return PCRResult(replace(model, regression=reg), curve, k, notes, oof, limit, labelled, n - labelled)


def predict_missing(df: DataFrame, model: PCAModel, keep: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """Predictions for rows with or without gaps."""
    reg = model.regression
    gamma = np.concatenate([[reg.intercept], reg.gamma])
    return _predictions(df, model, [gamma], keep).select(*keep, F.element_at("predictions", 1).alias(name))
