"""Components and limits of tables too wide for a square matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenframe.operators import pca
from eigenframe.operators import regression as reg
from eigenframe.plans import products
from eigenframe.plans.dense import q_limit
from eigenframe.plans.products import Problem, Rows, leading, rest_sums


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, arr array<double>").repartition(parts)


def covariance(x, center, divisor):
    z = (x - center) / divisor
    return z.T @ z / (len(x) - 1)


def test_products_of_folds(spark):
    rng = np.random.default_rng(0)
    x, fold = rng.normal(size=(60, 9)) + 5, np.arange(60) % 3
    df = table(spark, x).withColumn("fold", F.col("id") % 3).withColumn("repeat", F.lit(0))
    rows = Rows(df, F.col("arr"), 9, folds=("repeat", "fold"))
    shift = x.mean(axis=0)
    sums = rows.sums(shift)
    assert sorted(sums) == [(0, 0), (0, 1), (0, 2)]
    assert all(n == 20 and np.allclose(a, (x[fold == f] - shift).sum(0)) and np.allclose(b, ((x[fold == f] - shift) ** 2).sum(0)) for (_, f), (n, a, b) in sums.items())
    problems = [Problem((0, f), 40, x[fold != f].mean(0) + 1, x[fold != f].std(0)) for f in range(3)] + [Problem(None, 60, shift, np.ones(9))]
    vectors = [rng.normal(size=(9, w)) for w in (2, 3, 1, 4)]
    got = rows.apply(shift, problems, vectors)
    for p, v, g in zip(problems, vectors, got):
        own = x if p.key is None else x[fold != p.key[1]]
        c = covariance(own, p.center, p.divisor)
        assert np.allclose(g, c @ v)
        assert np.allclose(rows.squares(shift, p, v), np.diag(v.T @ c @ v))


@pytest.mark.parametrize("rank", [3, 30])
def test_leading_components(spark, rank):
    rng = np.random.default_rng(rank)
    x = rng.normal(size=(150, rank)) @ (rng.normal(size=(rank, 40)) * np.geomspace(1, 0.05, rank)[:, None]) + 3
    rows, mean = Rows(table(spark, x), F.col("arr"), 40), x.mean(axis=0)
    p = Problem(None, 150, mean, np.ones(40))
    found = leading(rows, mean, [p], 5)[0]
    w, v = np.linalg.eigh(covariance(x, mean, 1.0))
    assert np.allclose(found.eigenvalues, np.maximum(w[::-1][:5], 0), atol=1e-8 * w[-1])
    known = min(rank, 5)
    assert np.allclose(np.abs((found.vectors[:, :known] * v[:, ::-1][:, :known]).sum(0)), 1, atol=1e-7)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(5), atol=1e-9)
    rest = rest_sums(rows, mean, p, found, float(w.sum()))
    assert np.allclose(rest, [(w[::-1][5:] ** i).sum() for i in (1, 2, 3)], rtol=0.15 if rank > 5 else 0, atol=1e-9)


def test_rest_is_estimated_well(spark):
    """A slowly falling spectrum, most of it outside of the basis."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 300)) * np.geomspace(3, 0.7, 300)
    rows, mean = Rows(table(spark, x), F.col("arr"), 300), x.mean(axis=0)
    p = Problem(None, 400, mean, np.ones(300))
    found = leading(rows, mean, [p], 2)[0]
    w = np.linalg.eigvalsh(covariance(x, mean, 1.0))[::-1]
    rest = rest_sums(rows, mean, p, found, float(w.sum()))
    assert not found.closed and np.allclose(found.eigenvalues, w[:2])
    assert np.allclose(rest, [(w[2:] ** i).sum() for i in (1, 2, 3)], rtol=0.05)


def test_row_count_does_not_change_limits(spark, monkeypatch):
    """The same rows through the square matrix, through row products and through vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4)) @ rng.normal(size=(4, 20)) * 10 + rng.normal(size=(30, 20)) * 0.1
    df = table(spark, x)
    want = pca.fit_pca(df, "arr", 4, scaling="center")
    monkeypatch.setattr(pca, "MAX_WIDTH", 19)
    vectors = pca.fit_pca(df, "arr", 4, scaling="center")
    assert np.allclose(vectors.loadings, want.loadings, atol=1e-7) and np.allclose(vectors.eigenvalues, want.eigenvalues)
    assert vectors.limits["q_95"] == pytest.approx(want.limits["q_95"], rel=0.1)
    assert np.allclose(vectors.variable_score_cov, want.variable_score_cov, atol=1e-6) and np.allclose(vectors.variable_sd, want.variable_sd)
    few = table(spark, x[:15])
    monkeypatch.setattr(pca, "MAX_WIDTH", 4096)
    want = pca.fit_pca(few, "arr", 4, scaling="none")
    monkeypatch.setattr(pca, "MAX_WIDTH", 19)
    dual = pca.fit_pca(few, "arr", 4, scaling="none")
    assert dual.limits["q_99"] == pytest.approx(want.limits["q_99"], rel=1e-6)
    assert np.allclose(dual.variable_score_cov, want.variable_score_cov, atol=1e-6)
    assert q_limit(0.95, want.all_eigenvalues[4:]) == pytest.approx(want.limits["q_95"])


def test_no_rows_of_a_fold(spark):
    assert products.tree_sum(spark.createDataFrame([], "part int, r array<double>"), ["part"]).count() == 0


@pytest.mark.parametrize("cv", [None, reg.CV(3, order_by=("id",)), reg.CV(4, "forward", order_by=("id",)), reg.CV(3, order_by=("id",), shuffle=True, repeats=2)])
def test_wide_regression_equals_the_square_one(spark, monkeypatch, cv):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12)) * np.geomspace(3, 0.5, 12) + 4
    y = x[:, 0] * 2 - x[:, 3] + rng.normal(size=60)
    rows = [(i, a.tolist(), None if i % 11 == 5 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, arr array<double>, y double").repartition(4)
    given = {"k": 3} if cv is None else {"cv": cv, "max_components": 4, "rule": "min"}
    want = reg.fit_pcr(df, "arr", "y", **given)
    for module in (pca, reg):
        monkeypatch.setattr(module, "MAX_WIDTH", 11)
    got = reg.fit_pcr(df, "arr", "y", **given)
    a, b = got.model.regression, want.model.regression
    assert a.k == b.k and np.allclose(a.beta, b.beta, atol=1e-6) and np.isclose(a.beta0, b.beta0, atol=1e-6)
    assert np.isclose(a.rmsec, b.rmsec) and np.isclose(a.r2c, b.r2c)
    if cv:
        c, d = (r.curve.orderBy("k").toPandas() for r in (got, want))
        assert np.allclose(c, d, atol=1e-6) and got.notes == want.notes
        e, f = (sorted(map(tuple, r.out_of_fold.collect())) for r in (got, want))
        assert [r[0] for r in e] == [r[0] for r in f] and np.allclose(np.array(e, float), np.array(f, float), atol=1e-6)


def test_wide_regression_on_few_directions(spark, monkeypatch):
    for module in (pca, reg):
        monkeypatch.setattr(module, "MAX_WIDTH", 5)
    rows = [(i, [float(i % 7)] * 4 + [float(i % 3)] * 4, float(2 * (i % 7) - (i % 3) + 1)) for i in range(42)]
    df = spark.createDataFrame(rows, "id long, arr array<double>, y double")
    out = reg.fit_pcr(df, "arr", "y", cv=reg.CV(3, order_by=("id",)), max_components=5, rule="min", scaling="center")
    assert out.model.regression.k == 2 and out.model.regression.r2c == pytest.approx(1) and out.curve.count() == 3
    with pytest.raises(ValueError, match="max_components"):
        reg.fit_pcr(df, "arr", "y", cv=reg.CV(3, order_by=("id",)))


def test_packed_rows_are_the_same_rows(spark):
    x = np.random.default_rng(8).normal(size=(70, 6)) + [0, 1e6, 0, 0, 0, -3]
    rows = Rows(table(spark, x), F.col("arr"), 6)
    packed = rows.packed()
    assert packed.df.schema["x"].dataType.simpleString() == "binary"
    (a, b), shift = (r.sums(np.ones(6)) for r in (rows, packed)), np.zeros(6)
    assert a.keys() == b.keys() and all(np.allclose(p, q) for k in a for p, q in zip(a[k], b[k]))
    shift, parts = packed.centred_sums()
    (n, off, square), = parts.values()
    assert n == 70 and np.allclose(shift + off / n, x.mean(axis=0)) and np.allclose((square - off**2 / n) / 69, x.var(axis=0, ddof=1))


def counted(spark, df):
    """``df`` with its arrays made by Python, and a counter of the rows made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def again(values):
        made.add(1)
        return values

    return df.withColumn("arr", again("arr")), made


def test_source_of_a_wide_fit_is_read_once(spark, monkeypatch):
    """Beside a few rows for the width and a rough centre, one scan packs, checks and adds up the rows."""
    monkeypatch.setattr(pca, "MAX_WIDTH", 19)
    x = np.random.default_rng(1).normal(size=(600, 20)) + 4
    monkeypatch.setattr(products, "PREVIEW", 10)
    df, made = counted(spark, table(spark, x))
    got = pca.fit_pca(df, "arr", 2, scaling="center")
    assert got.n == 600 and made.value < 2 * 600
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(got.eigenvalues, w[:2]) and np.allclose(got.center, x.mean(axis=0))


def test_packing_scan_makes_the_first_product(spark):
    rng = np.random.default_rng(2)
    x, fold = rng.normal(size=(90, 12)) * np.geomspace(4, 0.5, 12) + 6, np.arange(90) % 3
    df = table(spark, x).withColumn("fold", F.col("id") % 3).withColumn("repeat", F.lit(0))
    rows = Rows(df, F.col("arr"), 12, folds=("repeat", "fold")).packed(3, 3)
    shift, parts = rows.centred_sums()
    assert sum(p[0] for p in parts.values()) == 90 and sorted(parts) == [(0, 0), (0, 1), (0, 2)]
    for key in [None, (0, 0), (0, 2)]:
        own = x if key is None else x[fold != key[1]]
        p = Problem(key, len(own), own.mean(axis=0), own.std(axis=0))
        v, image = rows.first_product(shift, p)
        assert np.allclose(v.T @ v, np.eye(7)) and np.allclose(image, covariance(own, p.center, p.divisor) @ v)
        assert np.allclose(image, rows.apply(shift, [p], [v])[0])
    odd = Problem(None, 90, x.mean(axis=0), np.geomspace(1, 1e9, 12))
    assert rows.first_product(shift, odd) is None and rows.first_product(shift + 1, p) is None
    assert Rows(df, F.col("arr"), 12).packed(3, 10**9).start is None


def test_packing_scan_finds_gaps_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(pca, "MAX_WIDTH", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = [[float(i), 1.0, 2.0, float(i % 3)] for i in range(20)]
    for gap in ([1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], None):
        df = spark.createDataFrame([(v,) for v in [*whole, gap]], "arr array<double>")
        with pytest.raises(Exception, match="missing cell"):
            pca.fit_pca(df, "arr", 1)
    df = spark.createDataFrame([(v,) for v in [*whole, [1.0] * 5, None]], "arr array<double>")
    with pytest.raises(ValueError, match="rows differ in length: 4 to 5"):
        pca.fit_pca(df, "arr", 1)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_rough_centre_far_from_the_mean(spark, monkeypatch):
    monkeypatch.setattr(products, "PREVIEW", 2)
    x = np.random.default_rng(4).normal(size=(80, 6)) + 1e4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.concatenate([np.zeros((2, 6)), x]))], "id long, arr array<double>").coalesce(1)
    rows = Rows(df.filter("id <> 1"), F.col("arr"), 6).packed(2)
    monkeypatch.setattr(products, "FAR", 1e-4)
    shift, parts = rows.centred_sums()
    every = np.concatenate([np.zeros((1, 6)), x])
    p = Problem(None, 81, every.mean(axis=0), np.ones(6))
    assert np.allclose(shift, every.mean(axis=0)) and rows.first_product(shift, p) is None
    assert np.allclose(leading(rows, shift, [p], 2)[0].eigenvalues, np.linalg.eigvalsh(np.cov(every.T))[::-1][:2])


def test_wide_prediction_takes_one_product(spark, monkeypatch):
    """Predicted as through the scores, which are not made; rows with gaps have none."""
    for module in (pca, reg):
        monkeypatch.setattr(module, "MAX_WIDTH", 7)
    x = np.random.default_rng(6).normal(size=(60, 8)) + 2
    y = x[:, 0] - 2 * x[:, 5]
    df = spark.createDataFrame([(i, r.tolist(), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, arr array<double>, y double")
    model = reg.fit_pcr(df, "arr", "y", k=3, scaling="standard").model
    more = df.unionByName(spark.createDataFrame([(100, None, 1.0), (101, [None, *[1.0] * 7], 1.0), (102, [float("inf"), *[1.0] * 7], 1.0)], df.schema))
    out = reg.fitted(more, model, ["id"])
    assert "pc1" not in out._jdf.queryExecution().toString() and out.columns == ["id", "measured", "predicted", "residual"]
    got = {r["id"]: r["predicted"] for r in out.collect()}
    scores = ((x - model.center) / model.divisor) @ model.loadings
    want = scores @ np.array(model.regression.gamma) + model.regression.intercept
    assert np.allclose([got[i] for i in range(60)], want) and [got[i] for i in (100, 101, 102)] == [None] * 3


@pytest.mark.parametrize("repeats", [1, 2])
def test_final_fit_reads_what_the_folds_have_packed(spark, monkeypatch, repeats):
    for module in (pca, reg):
        monkeypatch.setattr(module, "MAX_WIDTH", 9)
    monkeypatch.setattr(products, "PREVIEW", 10)
    x = np.random.default_rng(9).normal(size=(2000, 10)) * np.geomspace(3, 0.5, 10) + 1
    y = x[:, 0] + x[:, 1] - x[:, 4]
    rows = [(i, r.tolist(), float(v) if i % 9 else None) for i, (r, v) in enumerate(zip(x, y))]
    df, made = counted(spark, spark.createDataFrame(rows, "id long, arr array<double>, y double").repartition(3))
    cv = reg.CV(4, order_by=("id",), shuffle=True, repeats=repeats)
    got = reg.fit_pcr(df, "arr", "y", cv=cv, max_components=3, rule="min")
    labelled = sum(1 for r in rows if r[2] is not None)
    assert made.value < repeats * labelled + 2000 - labelled + 1500  # the folds' rows, and a few for the width and a centre
    want = reg.fit_pcr(df, "arr", "y", k=got.selected).model
    assert got.model.n == 2000 and np.allclose(got.model.loadings, want.loadings, atol=1e-6)
    assert np.allclose(got.model.regression.beta, want.regression.beta, atol=1e-6) and np.isclose(got.model.regression.rmsec, want.regression.rmsec)
    assert np.allclose(list(got.model.limits.values()), list(want.limits.values()), rtol=0.2)


def test_pieces_are_bounded(monkeypatch):
    import pyarrow as pa

    from eigenframe.plans import gram

    monkeypatch.setattr(gram, "_CHUNK", 100)
    batch = pa.record_batch({"a": list(range(25))})
    got = list(gram.pieces([batch], 10))
    assert [p.num_rows for p in got] == [10, 10, 5] and [v for p in got for v in p.column(0).to_pylist()] == list(range(25))
    assert [p.num_rows for p in gram.pieces([batch.slice(0, 2)], 1000)] == [1, 1]
