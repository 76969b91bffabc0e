"""Models as one-row tables, and the tables a scoring or regression run leaves behind."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from eigenframe.operators.gappy import _Component
from eigenframe.operators.pca import PCAModel, Regression
from eigenframe.operators.regression import PCRResult, coefficients
from eigenframe.operators.rowstage import RowStage

MODEL = (
    "method string, features array<string>, width int, k int, n long, scaling string, center array<double>, "
    "divisor array<double>, row_stage struct<snv:boolean,vector_norm:boolean,sg_window:int,sg_order:int,sg_deriv:int>, "
    "loadings array<array<double>>, eigenvalues array<double>, all_eigenvalues array<double>, ratio array<double>, "
    "cumulative array<double>, score_mean array<double>, score_cov array<array<double>>, limits map<string,double>, "
    "regression struct<response:string,k:int,gamma:array<double>,intercept:double,beta:array<double>,beta0:double,"
    "beta_valid:boolean,rmsec:double,r2c:double>, variable_sd array<double>, variable_score_cov array<array<double>>, "
    "gaps struct<columns:array<int>,starts:array<double>,flips:array<double>>"
)


def _vector(x) -> list[float] | None:
    return None if x is None else [float(v) for v in x]


def _matrix(x) -> list[list[float]] | None:
    return None if x is None else [_vector(r) for r in x]


def model_row(model: PCAModel) -> tuple:
    s, r = model.row_stage, model.regression
    return (
        model.method, list(model.features), model.width, model.k, model.n, model.scaling, _vector(model.center),
        _vector(model.divisor), (s.snv, s.vector_norm, s.sg_window, s.sg_order, s.sg_deriv), _matrix(model.loadings),
        _vector(model.eigenvalues), _vector(model.all_eigenvalues), _vector(model.ratio), _vector(model.cumulative),
        _vector(model.score_mean), _matrix(model.score_cov), {k: float(v) for k, v in model.limits.items()},
        None
        if r is None
        else (
            r.response, r.k, _vector(r.gamma), float(r.intercept), _vector(r.beta), float(r.beta0), r.beta_valid,
            float(r.rmsec), float(r.r2c),
        ),
        _vector(model.variable_sd), _matrix(model.variable_score_cov), _gaps(model),
    )


def _gaps(model: PCAModel) -> tuple | None:
    """Of a fit to rows with gaps: where each component starts, and its sign; its vector is in the loadings."""
    if model.history is None:
        return None
    done, flips = model.history
    return [int(c.column) for c in done], _vector([c.start for c in done]), _vector(flips)


def _history(gaps, p: np.ndarray) -> tuple | None:
    if gaps is None:
        return None
    flips = np.array(gaps["flips"], float)
    if not len(flips) == len(gaps["columns"]) == len(gaps["starts"]) == p.shape[1]:
        raise ValueError("starts and signs do not match the number of components")
    return [_Component(c, s, [p[:, j] * flips[j]]) for j, (c, s) in enumerate(zip(gaps["columns"], gaps["starts"]))], flips


def save_model(model: PCAModel, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
    spark.createDataFrame([model_row(model)], MODEL).coalesce(1).write.mode(mode).json(path)


def load_model(spark: SparkSession, path: str) -> PCAModel:
    """Read a model and check that its parts fit together."""
    rows = spark.read.schema(MODEL).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected one model in {path}, found {len(rows)}")
    return model_from_row(rows[0])


def model_from_row(r) -> PCAModel:
    need = ("method", "features", "width", "k", "center", "divisor", "loadings", "eigenvalues", "all_eigenvalues", "limits")
    absent = [c for c in need if r[c] is None]
    if absent:
        raise ValueError(f"the model lacks {', '.join(absent)}")
    p = np.array(r["loadings"], float).reshape(r["width"], -1)
    if p.shape[1] != r["k"] or len(r["center"]) != r["width"] or len(r["divisor"]) != r["width"]:
        raise ValueError("loadings, center and divisor do not match the number of variables and components")
    if len(r["eigenvalues"]) != r["k"] or len(r["features"]) not in (1, r["width"]):
        raise ValueError("eigenvalues or features do not match the number of components or variables")
    reg = r["regression"]
    if reg is not None:
        if len(reg["gamma"]) != reg["k"] or reg["k"] > r["k"]:
            raise ValueError("one regression coefficient per component is needed")
        if reg["beta_valid"] and len(reg["beta"] or ()) != r["width"]:
            raise ValueError("original-scale coefficients are claimed but not there")
    return PCAModel(
        method=r["method"],
        features=tuple(r["features"]),
        width=r["width"],
        k=r["k"],
        n=r["n"],
        scaling=r["scaling"],
        center=np.array(r["center"]),
        divisor=np.array(r["divisor"]),
        loadings=p,
        eigenvalues=np.array(r["eigenvalues"]),
        all_eigenvalues=np.array(r["all_eigenvalues"]),
        ratio=np.array(r["ratio"]),
        row_stage=RowStage(**r["row_stage"].asDict()),
        score_mean=None if r["score_mean"] is None else np.array(r["score_mean"]),
        score_cov=None if r["score_cov"] is None else np.array(r["score_cov"]),
        limits=dict(r["limits"]),
        variable_sd=None if r["variable_sd"] is None else np.array(r["variable_sd"]),
        variable_score_cov=None if r["variable_score_cov"] is None else np.array(r["variable_score_cov"]),
        history=_history(r["gaps"], p),
        regression=None
        if reg is None
        else Regression(
            reg["response"], reg["k"], tuple(reg["gamma"]), reg["intercept"], tuple(reg["beta"] or ()), reg["beta0"],
            reg["beta_valid"], reg["rmsec"], reg["r2c"],
        ),
    )


def write_scores(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scores, T², Q and predictions as they come; one file per task."""
    scored.write.mode(mode).parquet(path)


def write_regression(result: PCRResult, predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Three tables below ``path``: predictions, coefficients, curve."""
    spark = predictions.sparkSession
    predictions.write.mode(mode).option("header", "true").csv(f"{path}/predictions")
    if result.model.regression.beta_valid:
        coefficients(spark, result.model).coalesce(1).write.mode(mode).option("header", "true").csv(f"{path}/coefficients")
    if result.curve is not None:
        result.curve.orderBy("k").coalesce(1).write.mode(mode).option("header", "true").csv(f"{path}/curve")
