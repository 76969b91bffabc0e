"""The everyday sequences: analyse a table, apply a saved model, regress a response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.operators.gappy import score_missing
from eigenframe.operators.gappy_regression import fit_pcr_missing, predict_missing
from eigenframe.operators.missing import drop_incomplete, guard_regression, impute
from eigenframe.operators.pca import PCAModel, fit_pca
from eigenframe.operators.regression import CV, PCRResult, fit_pcr
from eigenframe.operators.rows import exclude_columns, exclude_rows
from eigenframe.operators.rowstage import RowStage
from eigenframe.operators.scoring import predict, score, with_fit_diagnostics, with_outside
from eigenframe.roles import Roles


def _excluded(df: DataFrame, roles: Roles, rows: str, columns: Sequence[str], order_by: Sequence[str]):
    """Excluded rows go first, so they influence no statistic."""
    if rows:
        df = exclude_rows(df, rows, order_by)
    if columns:
        df, roles = exclude_columns(df, columns), roles.without(*columns)
    return df, roles


def analyze(
    df: DataFrame,
    roles: Roles,
    k: int,
    keep: Sequence[str] = (),
    method: str = "svd",
    scaling: str = "standard",
    missing: str = "error",
    row_stage: RowStage | None = None,
    rows_out: str = "",
    columns_out: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> tuple[PCAModel, DataFrame]:
    """Model and scored rows with T² at fit, Mahalanobis distance, Q, and flags."""
    df, roles = _excluded(df, roles, rows_out, columns_out, order_by)
    features = list(roles.features)
    if missing not in ("error", "native"):
        df = impute(df, features, missing)
    model = fit_pca(df, features, k, method, scaling, row_stage, missing="native" if missing == "native" else "error")
    carry = list(dict.fromkeys([*([roles.id_col] if roles.id_col else []), *keep]))
    scored = score_missing(df, model, carry) if missing == "native" else score(df, model, carry)
    return model, with_outside(with_fit_diagnostics(scored, model), model)


def apply_model(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """Scores, T², Q, the outside flag and, if the model has one, the prediction."""
    out = with_outside(score(df, model, keep), model)
    reg = model.regression
    if reg is None:
        return out
    value = F.lit(float(reg.intercept))
    for j, g in enumerate(reg.gamma):
        value = value + F.col(f"pc{j + 1}") * F.lit(float(g))
    return out.withColumn("predicted", value)


def regress(
    df: DataFrame,
    roles: Roles,
    response: str,
    cv: CV | None = None,
    k: int | None = None,
    missing: str = "error",
    rows_out: str = "",
    columns_out: Sequence[str] = (),
    order_by: Sequence[str] = (),
    **options,
) -> tuple[PCRResult, DataFrame]:
    """Cross-validated regression and the prediction of every row."""
    guard_regression(missing)
    df, roles = _excluded(df, roles, rows_out, columns_out, order_by)
    features = [c for c in roles.features if c != response]
    if missing == "drop":
        df = drop_incomplete(df, features)
    elif missing == "zero":
        df = impute(df, features, "zero")
    elif missing not in ("error", "native"):
        raise ValueError(f"unknown way with gaps: {missing!r}")
    carry = list(dict.fromkeys([*([roles.id_col] if roles.id_col else []), response]))
    if missing == "native":
        result = fit_pcr_missing(df, features, response, k=k, cv=cv, **options)
        return result, predict_missing(df, result.model, carry)
    result = fit_pcr(df, features, response, k=k, cv=cv, **options)
    return result, predict(df, result.model, carry)
