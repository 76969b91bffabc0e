"""Regression on predictors with gaps: all folds in the same passes, and models that are read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenframe.operators import gappy, gappy_folds
from eigenframe.operators import regression as reg
from eigenframe.operators.gappy_regression import fit_pcr_missing, predict_missing
from eigenframe.operators.pca import fit_pca, variable_correlations
from eigenframe.plans.dense import nested_fits
from eigenframe.plans.gram import moments
from eigenframe.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(8)
    t = rng.normal(size=(90, 2))
    x = t @ rng.normal(size=(2, 4)) + 0.05 * rng.normal(size=(90, 4)) + [1, 2, 3, 4]
    x[rng.random(x.shape) < 0.12] = np.nan
    y = t[:, 0] * 2 + 0.1 * rng.normal(size=90)
    rows = [(i, int(i % 10), *[None if np.isnan(v) else float(v) for v in r], None if i % 17 == 3 else float(b)) for i, (r, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, g int, a double, b double, c double, d double, y double").repartition(4).cache()


FEATURES = ["a", "b", "c", "d"]


def one_by_one(df, cv, limit, scaling):
    """A fit of its own for every fold."""
    base = df.withColumn("_y", F.col("y"))
    held, rest, out = reg.assign_folds(base.filter("_y is not null"), cv), base.filter("_y is null"), {}
    folds = sorted({(r["repeat"], r["fold"]) for r in held.collect()})
    for rep, fold in folds:
        if cv.scheme == "forward" and fold == 0:
            continue
        mine = held.filter(F.col("repeat") == rep)
        train = mine.filter(F.col("fold") < fold if cv.scheme == "forward" else F.col("fold") != fold)
        model = gappy.fit_pca_missing(train.select(*FEATURES).union(rest.select(*FEATURES)), FEATURES, limit, scaling)
        pcs = [f"pc{j + 1}" for j in range(model.k)]
        mom = moments(gappy.score_missing(train, model, ["_y"]), [*pcs, "_y"])
        g = nested_fits(mom.scatter[: model.k, : model.k], mom.scatter[: model.k, model.k], mom.mean[: model.k], mom.mean[model.k], model.k)
        for r in gappy.score_missing(mine.filter(F.col("fold") == fold), model, ["id"]).collect():
            out[rep, r["id"]] = [float(c[0] + sum(w * r[p] for w, p in zip(c[1:], pcs))) for c in g]
    return out


@pytest.mark.parametrize(("cv", "scaling"), [(reg.CV(2, order_by=("id",)), "standard"), (reg.CV(1, "forward", order_by=("id",)), "robust")])
def test_folds_equal_fits_of_their_own(gaps, cv, scaling):
    base = gaps.withColumn("_y", F.col("y"))
    got = gappy_folds.cross_validate(base, reg.assign_folds(base.filter("_y is not null"), cv), FEATURES, cv, 1, scaling)
    got = {(r["repeat"], r["id"]): r["predictions"] for r in got.collect() if cv.scheme != "forward" or r["fold"]}
    want = one_by_one(gaps, cv, 1, scaling)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


@pytest.mark.parametrize(("cv", "limit", "scaling"), [(reg.CV(2, order_by=("id",), shuffle=True), 1, "standard")])
def test_moments_give_what_passes_give(gaps, monkeypatch, cv, limit, scaling):
    base = gaps.withColumn("_y", F.col("y") + 1e4)
    held = reg.assign_folds(base.filter("_y is not null"), cv)
    asked = []
    monkeypatch.setattr(gappy_folds, "_summed", lambda *a, f=gappy_folds._summed: (asked.append(1), f(*a))[1])
    by_moments = gappy_folds.cross_validate(base, held, FEATURES, cv, limit, scaling).collect()
    assert not asked  # no pass over the rows for a step
    monkeypatch.setattr(gappy_folds, "MOMENT_CELLS", 0)
    by_passes = gappy_folds.cross_validate(base, held, FEATURES, cv, limit, scaling).collect()
    got, want = ({(r["repeat"], r["fold"], r["id"]): r["predictions"] for r in rows} for rows in (by_moments, by_passes))
    assert asked and got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_many_repeats_hold_each_row_out_once(gaps, monkeypatch):
    monkeypatch.setattr(gappy_folds, "AT_ONCE", 17)
    cv = reg.CV(10, order_by=("id",), shuffle=True, repeats=3, seed=2)
    out = fit_pcr_missing(gaps, FEATURES, "y", cv=cv, max_components=1, rule="min", scaling="center")
    labelled = gaps.filter("y is not null").count()
    assert {(r["n"], r["folds"]) for r in out.curve.collect()} == {(3 * labelled, 30)}
    assert out.out_of_fold.count() == out.out_of_fold.select("id").distinct().count() == labelled


def test_models_are_read_back(spark, gaps, tmp_path):
    fit = fit_pcr_missing(gaps, FEATURES, "y", k=1)
    save_model(fit.model, spark, str(tmp_path / "gaps"))
    back = load_model(spark, str(tmp_path / "gaps"))
    for score in (gappy.score_missing, predict_missing):
        a, b = (sorted(map(tuple, score(gaps, m, ["id"]).collect())) for m in (fit.model, back))
        assert np.allclose(np.array(a, float), np.array(b, float))
    whole = fit_pca(gaps.dropna(), FEATURES, 2)
    save_model(whole, spark, str(tmp_path / "whole"))
    again = load_model(spark, str(tmp_path / "whole"))
    a, b = (variable_correlations(spark, m).collect() for m in (whole, again))
    assert a == b
