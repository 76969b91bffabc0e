"""Models against NumPy computations from the published formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import eigenframe.operators.kernel as kernel
import eigenframe.operators.pca as pca
from eigenframe.operators import gappy, lagged, regression, rowstage, scoring
from eigenframe.operators.diagnostics import kaiser, max_components, score_correlations
from eigenframe.operators.profile import correlations
from eigenframe.operators.quality import header_spacing
from eigenframe.operators.transforms import best_lambda
from eigenframe.plans import dense
from eigenframe.sources.models import load_model, save_model
from eigenframe.streaming.monitor import score_stream, share_outside

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(42)
    base = rng.normal(size=(240, 3)) * [4.0, 2.0, 1.0]
    x = base @ rng.normal(size=(3, 5)) + 0.3 * rng.normal(size=(240, 5)) + [5, -2, 0, 100, 1]
    y = x @ [1.0, -0.5, 0.0, 0.2, 2.0] + rng.normal(size=240)
    y[::7] = np.nan
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)), y=y, g=[i % 17 for i in range(len(x))])
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    return df.withColumn("arr", F.array(*NAMES)).repartition(5)


def numpy_pca(x, scaling):
    center, div = {
        "center": (x.mean(0), np.ones(x.shape[1])),
        "standard": (x.mean(0), x.std(0, ddof=1)),
        "scale": (0, x.std(0, ddof=1)),
        "none": (0, np.ones(x.shape[1])),
    }[scaling]
    z = (x - center) / div
    _u, s, vt = np.linalg.svd(z, full_matrices=False)
    return z, s**2 / (len(x) - 1), dense.fix_signs(vt.T)


def scores_of(df, k, key="id"):
    p = df.toPandas().sort_values(key)
    return p[[f"pc{j + 1}" for j in range(k)]].to_numpy(), p


@pytest.mark.parametrize("scaling", ["center", "standard", "scale", "none"])
@pytest.mark.parametrize("features", [NAMES, "arr"])
def test_svd(frame, data, scaling, features):
    z, lam, v = numpy_pca(data[0], scaling)
    model = pca.fit_pca(frame, features, 3, scaling=scaling)
    assert np.allclose(model.all_eigenvalues, lam, rtol=1e-8)
    assert np.allclose(model.loadings, v[:, :3], atol=1e-7)
    got, p = scores_of(scoring.with_fit_diagnostics(scoring.score(frame, model, ["id"]), model), 3)
    t = z @ v[:, :3]
    assert np.allclose(got, t, atol=1e-6)
    assert np.allclose(p["q"], ((z - t @ v[:, :3].T) ** 2).sum(1), atol=1e-7)
    s = np.cov(t.T) + 1e-4 * np.eye(3)
    d = t - t.mean(0)
    assert np.allclose(p["t2_fit"], np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d), atol=1e-6)
    assert np.allclose(model.loadings.T @ model.loadings, np.eye(3), atol=1e-9)


def test_full_rank_rebuilds_the_data(frame, data):
    model = pca.fit_pca(frame, NAMES, 5)
    back = scoring.reconstruct(frame, model, ["id"]).toPandas().sort_values("id")[NAMES].to_numpy()
    assert np.allclose(back, data[0], atol=1e-8)


def test_robust(frame, data):
    x = data[0]
    med = np.quantile(x, 0.5, axis=0, method="inverted_cdf")
    mad = 1.4826 * np.quantile(np.abs(x - med), 0.5, axis=0, method="inverted_cdf")
    model = pca.fit_pca(frame, NAMES, 2, scaling="robust")
    z = (x - med) / mad
    assert np.allclose(model.center, med) and np.allclose(model.divisor, mad)
    assert np.allclose(model.all_eigenvalues, np.linalg.svd(z)[1] ** 2 / (len(x) - 1))


def test_nipals_is_svd_with_a_flat_tail(frame):
    a = pca.fit_pca(frame, NAMES, 2, scaling="center")
    b = pca.fit_pca(frame, NAMES, 2, scaling="center", method="nipals")
    assert np.allclose(a.loadings, b.loadings, atol=1e-5) and np.allclose(a.eigenvalues, b.eigenvalues, rtol=1e-6)
    assert np.allclose(b.all_eigenvalues[2:], a.all_eigenvalues[2:].mean())


def test_other_solvers(frame, monkeypatch):
    want = pca.fit_pca(frame, "arr", 3)
    tall = pca.fit_pca(frame, "arr", 3, solver="tsqr")
    assert np.allclose(tall.all_eigenvalues, want.all_eigenvalues) and np.allclose(tall.loadings, want.loadings)
    few = frame.filter("id < 4")
    dual_want = pca.fit_pca(few, "arr", 2)
    monkeypatch.setattr(pca, "MAX_WIDTH", 4)
    dual = pca.fit_pca(few, "arr", 2)
    assert np.allclose(dual.all_eigenvalues[:3], dual_want.all_eigenvalues[:3]) and np.allclose(dual.loadings, dual_want.loadings)
    rows = pca.fit_pca(frame, "arr", 3)
    assert np.allclose(rows.eigenvalues, want.eigenvalues) and np.allclose(rows.loadings, want.loadings, atol=1e-6)
    assert np.isclose(rows.all_eigenvalues.sum(), want.all_eigenvalues.sum())


def test_ill_conditioned_goes_to_qr(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1e6, 1.0, 1e-3]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q", "r"]))
    model = pca.fit_pca(df, ["p", "q", "r"], 3, scaling="center")
    want = np.linalg.svd(x - x.mean(0))[1] ** 2 / 199
    assert np.allclose(model.all_eigenvalues, want, rtol=1e-6)


def test_partitioning_does_not_matter(frame):
    a = pca.fit_pca(frame.repartition(1), "arr", 3)
    b = pca.fit_pca(frame.repartition(13), "arr", 3)
    assert np.allclose(a.loadings, b.loadings, atol=1e-10)


def test_bad_input(frame):
    with pytest.raises(ValueError):
        pca.fit_pca(frame, NAMES, 6)
    with pytest.raises(Exception, match="missing cell"):
        pca.fit_pca(frame, ["a", "y"], 1)
    with pytest.raises(ValueError):
        pca.fit_pca(frame.limit(1), NAMES, 1)


def test_row_stages(frame, data):
    x = data[0]
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    got = np.vstack(rowstage.snv(frame, "arr").orderBy("id").toPandas()["snv"])
    assert np.allclose(got, z)
    w = np.vstack(rowstage.savgol(frame, "arr", 3, 1).orderBy("id").toPandas()["smooth"])
    inner = (x[:, :-2] + x[:, 1:-1] + x[:, 2:]) / 3
    assert np.allclose(w[:, 1:-1], inner)


@pytest.mark.parametrize("deriv", [0, 1, 2])
def test_smoothing_keeps_polynomials(deriv):
    u = np.arange(15.0)
    poly = np.polynomial.Polynomial([1, -2, 0.5, 0.1])
    out = dense.smoothing_matrix(15, 7, 3, deriv) @ poly(u)
    assert np.allclose(out, poly.deriv(deriv)(u) if deriv else poly(u))
    with pytest.raises(ValueError):
        dense.smoothing_matrix(15, 4, 2)


def plain_nipals(x, k):
    """Row form with gaps, one matrix in memory."""
    w = (x - np.nanmean(x, 0)) / np.nanstd(x, 0, ddof=1)
    seen = ~np.isnan(w)
    lam, loads, scores = [], [], []
    for _ in range(k):
        c = np.nanvar(w, 0).argmax()
        t = np.where(seen[:, c], w[:, c], np.nanmean(w[:, c]))
        for _step in range(1000):
            p = np.nansum(w * t[:, None], 0) / (seen * t[:, None] ** 2).sum(0)
            p /= np.linalg.norm(p)
            den = (seen * p**2).sum(1)
            new = np.where(den > 1e-8, np.nansum(w * p, 1) / np.where(den > 1e-8, den, 1), t)
            gap, t = np.linalg.norm(new - t), new
            if gap < 1e-8:
                break
        loads.append(p), scores.append(t), lam.append(t @ t / (len(x) - 1))
        w = w - np.outer(t, p)
    return np.array(lam), np.array(loads).T, np.array(scores).T, w


def test_nipals_with_gaps(spark, data):
    x = data[0].copy()
    rng = np.random.default_rng(3)
    x[rng.random(x.shape) < 0.08] = np.nan
    x[5] = np.nan  # a row with nothing observed keeps the start value
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)))
    df = spark.createDataFrame(pdf)
    df = df.select("id", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in NAMES]).repartition(4)
    lam, p, t, rest = plain_nipals(x, 2)
    model = gappy.fit_pca_missing(df, NAMES, 2)
    signs = np.sign((model.loadings * p).sum(0))
    assert np.allclose(model.eigenvalues, lam, rtol=1e-6) and np.allclose(model.loadings, p * signs, atol=1e-6)
    assert np.allclose(model.all_eigenvalues[2:], np.nansum(rest**2) / (len(x) - 1) / 3, rtol=1e-6)
    got, pd_scores = scores_of(gappy.score_missing(df, model, ["id"]), 2)
    assert np.allclose(got, t * signs, atol=1e-5)
    assert np.allclose(model.score_cov, np.cov((t * signs).T), atol=1e-5)
    assert np.allclose(pd_scores["q"], np.nansum(rest**2, 1), atol=1e-5)


@pytest.mark.parametrize("landmarks", [None, 240])
@pytest.mark.parametrize("kind", ["rbf", "poly", "linear"])
def test_kernel(spark, frame, data, kind, landmarks):
    x = data[0]
    params = kernel.KernelParams(kind, 0.01, 2, 1.0)
    k = params.matrix(x, x)
    n = len(x)
    h = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(h @ k @ h)
    w, v = w[::-1], v[:, ::-1]
    model = kernel.fit_kernel_pca(frame, "arr", 3, params, "id", landmarks=landmarks)
    assert not model.approximate and np.allclose(model.eigenvalues, w[:3], rtol=1e-6)
    assert np.allclose(model.ratio, w[:3] / np.maximum(w, 0).sum(), rtol=1e-6)
    got, _ = scores_of(kernel.score_kernel(frame, model, ["id"]), 3)
    want = v[:, :3] * np.sqrt(w[:3])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5 * np.sqrt(w[0]))


def test_linear_kernel_is_pca(frame):
    a = pca.fit_pca(frame, "arr", 2, scaling="center")
    b = kernel.fit_kernel_pca(frame, "arr", 2, kernel.KernelParams("linear"), "id")
    assert np.allclose(a.eigenvalues, b.eigenvalues / 239)
    s, _ = scores_of(scoring.score(frame, a, ["id"]), 2)
    t, _ = scores_of(kernel.score_kernel(frame, b, ["id"]), 2)
    assert np.allclose(np.abs(s), np.abs(t), atol=1e-6)


def test_landmarks(frame, monkeypatch):
    exact = kernel.fit_kernel_pca(frame, "arr", 2, kernel.KernelParams("rbf", 0.01), "id")
    monkeypatch.setattr(kernel, "EXACT_ROWS", 239)
    with pytest.raises(ValueError):
        kernel.fit_kernel_pca(frame, "arr", 2, kernel.KernelParams("rbf", 0.01), "id")
    near = kernel.fit_kernel_pca(frame, "arr", 2, kernel.KernelParams("rbf", 0.01), "id", landmarks=200)
    assert near.approximate and np.allclose(near.eigenvalues, exact.eigenvalues, rtol=1e-2)
    assert kernel.score_kernel(frame, near, ["id"]).count() == 240


def test_gaps_fail_lagged_and_kernel_fits(frame):
    for value in (None, float("nan")):
        holed = frame.withColumn("a", F.when(F.col("id") == 100, F.lit(value)).otherwise(F.col("a")))
        for lags in (2, 16):
            with pytest.raises(Exception, match="missing cell"):
                lagged.fit_lagged_pca(holed, ["a"], lags, ["id"], k=1)
        with pytest.raises(Exception, match="missing cell"):
            kernel.fit_kernel_pca(holed, ["a", "b"], 1, id_col="id", landmarks=50)


def test_lagged(frame, data):
    x = data[0][:, :2]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    lags = 4
    w = np.hstack([z[lag : len(z) - lags + 1 + lag] for lag in range(lags)])
    _u, s, vt = np.linalg.svd(w, full_matrices=False)
    model = lagged.fit_lagged_pca(frame, ["a", "b"], lags, ["id"], k=3)
    assert np.allclose(model.pca.all_eigenvalues, s**2 / (len(w) - 1))
    got, p = scores_of(lagged.score_lagged(frame, model, ["id"]), 3)
    v = dense.fix_signs(vt.T)[:, :3]
    assert np.allclose(got, w @ v, atol=1e-6)
    assert np.allclose(p["rms_error"], np.sqrt(((w - w @ v @ v.T) ** 2).mean(1)), atol=1e-7)
    share = np.cumsum(s**2) / (s**2).sum()
    assert lagged.fit_lagged_pca(frame, ["a", "b"], lags, ["id"], target_variance=0.7).k == (share < 0.7).sum() + 1
    with pytest.raises(ValueError):
        lagged.fit_lagged_pca(frame, ["a"], 2, ["id"], k=1, row_stage=rowstage.RowStage(snv=True))
    one = lagged.fit_lagged_pca(frame, ["a"], 240, ["id"], k=1)
    assert one.pca.n == 1 and np.isclose(one.pca.all_eigenvalues[0], ((x[:, 0] - x[:, 0].mean()) ** 2).sum() / x[:, 0].var(ddof=1))


def refit_cv(x, y, fold, k_max, scaling, forward=False):
    lab = ~np.isnan(y)
    errors = {k: [] for k in range(k_max + 1)}
    for f in sorted(set(fold[lab])):
        if forward and f == 0:
            continue
        test = lab & (fold == f)
        train = lab & ((fold < f) if forward else (fold != f))
        pool = train | ~lab
        z = x[pool]
        if scaling == "robust":
            c = np.quantile(z, 0.5, axis=0, method="inverted_cdf")
            d = 1.4826 * np.quantile(np.abs(z - c), 0.5, axis=0, method="inverted_cdf")
        else:
            c, d = z.mean(0), z.std(0, ddof=1)
        v = np.linalg.svd((z - c) / d, full_matrices=False)[2].T
        for k in range(k_max + 1):
            a = np.column_stack([np.ones(train.sum()), (x[train] - c) / d @ v[:, :k]])
            g = np.linalg.lstsq(a, y[train], rcond=None)[0]
            pred = np.column_stack([np.ones(test.sum()), (x[test] - c) / d @ v[:, :k]]) @ g
            errors[k].append(pred - y[test])
    return [np.sqrt(np.mean(np.concatenate(errors[k]) ** 2)) for k in range(k_max + 1)]


@pytest.mark.parametrize("scaling", ["standard", "robust"])
@pytest.mark.parametrize("design", ["rows", "groups", "forward", "loo"])
def test_pcr_equals_refitting(spark, frame, data, design, scaling):
    if design == "loo" and scaling == "robust":
        pytest.skip("robust scaling refits fold by fold")
    x, y = data
    cv = {
        "rows": regression.CV(6, order_by=("id",)),
        "groups": regression.CV(4, group_by="g", order_by=("id",)),
        "forward": regression.CV(4, "forward", order_by=("id",)),
        "loo": regression.CV(0, order_by=("id",)),
    }[design]
    res = regression.fit_pcr(frame, NAMES, "y", cv=cv, scaling=scaling)
    folds = regression.assign_folds(frame.filter("y is not null"), cv).select("id", "fold").toPandas()
    fold = np.full(len(y), -1)
    fold[folds["id"]] = folds["fold"]
    want = refit_cv(x, y, fold, 5, scaling, design == "forward")
    got = res.curve.orderBy("k").toPandas()
    assert np.allclose(got["rmsecv"], want[: len(got)], rtol=1e-7)
    assert res.labelled + res.excluded == 240
    if design == "loo":
        assert got["folds"].iloc[0] == res.labelled


def test_pcr_array_and_coefficients(spark, frame, data):
    x, y = data
    a = regression.fit_pcr(frame, NAMES, "y", k=4)
    b = regression.fit_pcr(frame, "arr", "y", k=4)
    assert np.allclose(a.model.regression.beta, b.model.regression.beta)
    via_beta = scoring.predict(frame, a.model, ["id"]).toPandas().sort_values("id")["predicted"]
    via_scores = scoring.predict(frame, b.model, ["id"]).toPandas().sort_values("id")["predicted"]
    assert np.allclose(via_beta, via_scores)
    lab = ~np.isnan(y)
    assert np.isclose(a.model.regression.rmsec, np.sqrt(np.mean((via_beta.to_numpy() - y)[lab] ** 2)))
    full = regression.fit_pcr(frame, NAMES, "y", k=5).model.regression
    ols = np.linalg.lstsq(np.column_stack([np.ones(lab.sum()), x[lab]]), y[lab], rcond=None)[0]
    assert np.allclose([full.beta0, *full.beta], ols, rtol=1e-6)
    smooth = regression.fit_pcr(frame, "arr", "y", k=2, row_stage=rowstage.RowStage(sg_window=3, sg_order=1))
    direct = scoring.score(frame, smooth.model, ["id"]).toPandas().sort_values("id")
    reg = smooth.model.regression
    by_scores = reg.intercept + direct[["pc1", "pc2"]].to_numpy() @ reg.gamma
    assert np.allclose(by_scores, reg.beta0 + x @ reg.beta)
    snv = regression.fit_pcr(frame, "arr", "y", k=2, row_stage=rowstage.RowStage(snv=True))
    assert not snv.model.regression.beta_valid
    assert scoring.predict(frame, snv.model, ["id"]).count() == 240


def test_pcr_refuses(frame):
    with pytest.raises(ValueError):
        regression.fit_pcr(frame, NAMES, "y", k=1, scaling="scale")
    with pytest.raises(ValueError):
        regression.fit_pcr(frame.filter("y is null"), NAMES, "y", k=1)
    with pytest.raises(ValueError):
        regression.assign_folds(frame, regression.CV(500, order_by=("id",)))


def test_repeats_are_partitions(frame):
    cv = regression.CV(5, group_by="g", order_by=("id",), shuffle=True, repeats=3, seed=2)
    got = regression.assign_folds(frame, cv).toPandas()
    assert len(got) == 3 * 240 and (got.groupby(["repeat", "g"])["fold"].nunique() == 1).all()
    assert got.groupby("repeat")["fold"].nunique().tolist() == [5, 5, 5]


def test_choose_k():
    pts = [(0, 5.0, 0.3), (1, 3.0, 0.4), (2, 2.6, 0.5), (3, 2.5, 0.2), (4, 2.9, 0.1)]
    pick = lambda rule, **kw: regression.choose_k(pts, rule, **kw)
    assert (pick("min"), pick("one-se"), pick("tolerance", tolerance=0.6), pick("first-min"), pick("wold")) == (3, 2, 1, 3, 3)
    assert pick("wold", wold_r=0.5) == 1


@pytest.mark.parametrize("kind", ["box-cox", "yeo-johnson"])
def test_lambda(spark, kind):
    rng = np.random.default_rng(7)
    x = np.exp(rng.normal(size=800)) - (0 if kind == "box-cox" else 0.8)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))

    def like(lam):
        if kind == "box-cox":
            t, j = (np.log(x) if lam == 0 else (x**lam - 1) / lam), np.log(x).sum()
        else:
            up, dn = np.maximum(x, 0), np.maximum(-x, 0)
            t = np.where(x >= 0, ((up + 1) ** lam - 1) / lam, -((dn + 1) ** (2 - lam) - 1) / (2 - lam))
            j = (np.sign(x) * np.log1p(np.abs(x))).sum()
        return -0.5 * len(x) * np.log(t.var()) + (lam - 1) * j

    grid = np.linspace(-2, 2, 4001) + 1e-9
    best = max(grid, key=like)
    assert abs(best_lambda(df, "x", kind) - best) < 1.5e-3


def test_scalars(spark):
    assert np.isclose(dense.f_quantile(spark, 0.95, 2, 148), 3.0572, atol=1e-4)
    assert np.isclose(dense.t_two_sided(spark, 2.0, 10), 0.0733880, atol=1e-6)
    assert dense.t2_limit(spark, 0.95, 3, 3) == 0.0 and dense.q_limit(0.95, np.zeros(0)) == 0.0


def test_metadata_p_values(spark, frame):
    scored = frame.select("id", F.col("a").alias("pc1"), F.col("b").alias("pc2"), "c", (F.col("g") % 3).cast("string").alias("kind"))
    out = score_correlations(scored, ["pc1", "pc2"], ["c"], ["kind"]).toPandas()
    assert set(out["variable"]) == {"c", "kind_0", "kind_1", "kind_2"} and ((out["p"] >= 0) & (out["p"] <= 1)).all()
    first = out[out["component"] == "pc1"].sort_values("place")["r"].to_numpy()
    assert (np.diff(first) <= 0).all()


def test_wide_correlations(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 30))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 4] = 2.0
    cols = [f"v{i}" for i in range(30)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=cols))
    got = correlations(df, cols).toPandas()
    want = pd.DataFrame(x, columns=cols).corr().fillna(0.0)
    assert len(got) == 435
    assert all(abs(r.r - want.loc[r.x, r.y]) < 1e-9 for r in got.itertuples())


def test_save_and_load(spark, frame, tmp_path):
    model = regression.fit_pcr(frame, NAMES, "y", k=3).model
    save_model(model, spark, str(tmp_path / "m"))
    back = load_model(spark, str(tmp_path / "m"))
    a = scoring.score(frame, model, ["id"]).orderBy("id").toPandas()
    b = scoring.score(frame, back, ["id"]).orderBy("id").toPandas()
    assert np.allclose(a, b) and back.regression == model.regression and back.limits == model.limits


def test_stream_equals_batch(spark, frame, tmp_path):
    model = pca.fit_pca(frame, NAMES, 2)
    src = str(tmp_path / "in")
    timed = frame.withColumn("ts", F.timestamp_seconds(F.col("id") * 30 + 1_700_000_000)).drop("arr")
    timed.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(timed.schema).parquet(src)
    q = score_stream(stream, model, ["id", "ts"]).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    batch = score_stream(timed, model, ["id", "ts"]).orderBy("id").toPandas()
    got = spark.table("scored").orderBy("id").toPandas()
    pd.testing.assert_frame_equal(got, batch)
    q = share_outside(score_stream(stream, model, ["ts"]), "ts").writeStream.format("memory").queryName("share").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = share_outside(score_stream(timed, model, ["ts"]), "ts").orderBy("start").toPandas()
    pd.testing.assert_frame_equal(spark.table("share").orderBy("start").toPandas(), want)


def test_small_helpers(frame):
    assert max_components("svd", 10, 4) == 4 and max_components("kernel", 10, 4) == 10 and max_components("lagged", 10, 2, 4) == 7
    assert kaiser(pca.fit_pca(frame, NAMES, 2))["components"] >= 1
    assert header_spacing(["1100", "1102", "1104"]) == {"numeric": True, "uniform": True, "distinct_steps": 1}
    assert header_spacing(["1", "2", "4"])["uniform"] is False and header_spacing(["a", "b"])["numeric"] is False


def test_workflows(spark, frame, tmp_path):
    from eigenframe.roles import Roles
    from eigenframe.sources.models import write_regression, write_scores
    from eigenframe.workflows import analyze, apply_model, regress

    roles = Roles(tuple(NAMES), (), ("y",), "id")
    gaps = frame.withColumn("b", F.when(F.col("id") % 9 != 0, F.col("b")))
    for missing in ("drop", "mean", "median", "zero", "native"):
        model, scored = analyze(gaps, roles, 2, missing=missing)
        assert scored.count() == (240 if missing != "drop" else 213) == model.n
    _m, scored = analyze(frame, roles, 2, rows_out="1-40", columns_out=["e"], order_by=["id"])
    assert scored.count() == 200 and scored.agg(F.min("id")).first()[0] == 40 and _m.width == 4
    result, predicted = regress(frame, roles, "y", cv=CV6)
    flagged = apply_model(frame, result.model, ["id"])
    a = predicted.orderBy("id").toPandas()["predicted"]
    assert np.allclose(a, flagged.orderBy("id").toPandas()["predicted"])
    write_scores(flagged, str(tmp_path / "s"))
    write_regression(result, predicted, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 240
    for part, n in (("predictions", 240), ("coefficients", 6), ("curve", result.curve.count())):
        assert spark.read.option("header", "true").csv(str(tmp_path / "r" / part)).count() == n
    with pytest.raises(ValueError):
        regress(frame, roles, "y", k=1, missing="mean")


CV6 = regression.CV(6, order_by=("id",))


def test_a_far_centre_is_made_again(spark):
    from eigenframe.plans.gram import moments

    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2)) * [1.0, 1e-3] + [1e6, 5.0]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["p", "q"]))
    got = moments(df, ["p", "q"], shift=[0.0, 0.0])
    assert np.allclose(got.cov, np.cov(x.T), rtol=1e-9)


def test_gaps_and_skew_in_pairs(spark):
    from eigenframe.operators.profile import numeric_profile

    rng = np.random.default_rng(8)
    x = np.concatenate([[1e9] * 3, rng.gamma(2.0, size=997)])  # the first rows are not typical
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flat": 2.5})).coalesce(1)
    row = {r["column"]: r for r in numeric_profile(df, ["x", "flat"]).collect()}
    n, z = len(x), (x - x.mean()) / x.std()
    assert np.isclose(row["x"]["skewness"], (z**3).mean() * n**2 / ((n - 1) * (n - 2)))
    assert row["flat"]["sd"] == 0 and row["flat"]["skewness"] == 0 and row["flat"]["unique"] == 1


def test_regression_with_gaps(spark, data):
    from eigenframe.operators.gappy_regression import fit_pcr_missing, predict_missing

    x, y = data[0].copy(), data[1]
    rng = np.random.default_rng(6)
    x[rng.random(x.shape) < 0.06] = np.nan
    pdf = pd.DataFrame(x, columns=NAMES).assign(id=range(len(x)), y=y)
    null = F.lit(None).cast("double")
    df = spark.createDataFrame(pdf).select("id", *[F.nanvl(c, null).alias(c) for c in [*NAMES, "y"]])
    lab = ~np.isnan(y)
    _lam, _p, t, _rest = plain_nipals(x, 2)
    a = np.column_stack([np.ones(lab.sum()), t[lab]])
    want = np.column_stack([np.ones(len(t)), t]) @ np.linalg.lstsq(a, y[lab], rcond=None)[0]
    fit = fit_pcr_missing(df, NAMES, "y", k=2)
    got = predict_missing(df, fit.model, ["id"]).orderBy("id").toPandas()["predicted"]
    assert np.allclose(got, want, atol=1e-5)
    assert np.isclose(fit.model.regression.rmsec, np.sqrt(np.mean((want - y)[lab] ** 2)), rtol=1e-6)
    cv = fit_pcr_missing(df, NAMES, "y", cv=regression.CV(3, order_by=("id",)), max_components=2)
    assert cv.curve.count() == 3 and cv.out_of_fold.count() == lab.sum()
    errors = cv.curve.orderBy("k").toPandas()["rmsecv"]
    assert errors[2] < errors[0]
