"""Quality classifier, language ID and nearest neighbours."""

import math

import numpy as np
import pytest
from odd import no_documents, odd_documents, rows
from pyspark.sql import functions as F

from eigenframe.llm import langid, neighbours, quality
from eigenframe.llm.common import remainder, table
from eigenframe.plans.durable import stored

SF = "/root/testdata/sf0.01"


# -- quality ----------------------------------------------------------------


def test_statistics_are_finite():
    for _, text, *_ in rows():
        x = quality.statistics(text or "")
        assert len(x) == len(quality.STATISTICS) and all(map(math.isfinite, x))


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.RandomState(1)
    n, ones = rng.randint(1, 5, 40).astype(float), None
    ones = np.array([rng.binomial(int(k), min(1, i / 40)) for i, k in enumerate(n)]).astype(float)
    x, y = quality.isotonic(np.arange(40.0), n, ones)
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    share = ones / n  # min-max formula of isotonic regression
    want = [max(min((ones[i : j + 1].sum() / n[i : j + 1].sum()) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    edges = np.searchsorted(x, np.arange(40.0))
    assert len(set(np.round(want, 9))) == len(y) and set(np.round(want, 9)) == set(np.round(y, 9)) and len(edges) == len(share)


def test_equations_are_summed_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN", 3)
    rng, d = np.random.RandomState(2), len(quality.STATISTICS)
    x, n = rng.normal(size=(200, d)), rng.randint(1, 3, 200)
    ones = (x[:, 0] > 0) * n
    data = [(row.tolist(), int(i % 2), int(k), float(o)) for i, (row, k, o) in enumerate(zip(x, n, ones))]
    df = spark.createDataFrame(data, "x array<double>, fold int, n long, ones double").repartition(11)
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, 16)), np.zeros(16), np.zeros(17), (np.zeros(1), np.zeros(1)))
    got = quality._equations(df, model)
    phi = model.features(x)
    for fold in (0, 1):
        p, w, o = phi[fold::2], n[fold::2], ones[fold::2]
        assert np.allclose(got[fold], np.concatenate([(p * w[:, None]).T @ p, (p.T @ o)[:, None]], axis=1))


def test_features_approximate_a_gaussian_kernel():
    rng, d = np.random.RandomState(3), len(quality.STATISTICS)
    model = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, 20000)) / math.sqrt(d), rng.uniform(0, 2 * math.pi, 20000), np.zeros(1), ((), ()))
    x = rng.normal(size=(5, d))
    phi = model.features(x)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d))
    assert np.allclose(phi @ phi.T, want, atol=0.05)


def test_quality_on_held_out_labels(spark):
    measured = stored(quality.with_statistics(table(spark, SF, "documents")), "statistics")
    labels = table(spark, SF, "labels")
    model = quality.fit(measured, labels, remainder("doc_id", 5) != 0)
    held = quality.score_measured(measured, model).join(labels, "doc_id").filter(remainder("doc_id", 5) == 0).collect()
    assert len(held) > 50
    assert sum((r["score"] >= 0.3) == bool(r["quality"]) for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


@pytest.mark.parametrize("marks", [[], [(1, None)], [(1, 1), (2, 1)], [(1, 1), (1, 0), (1, 0), (2, 0), (None, 1), (-8, 1)]])
def test_quality_of_odd_documents(spark, marks):
    measured = stored(quality.with_statistics(odd_documents(spark)), "statistics")
    model = quality.fit(measured, spark.createDataFrame(marks, "doc_id long, quality int"), F.lit(True))
    got = [r["score"] for r in quality.score_measured(measured, model).collect()]
    assert len(got) == len(rows()) and all(0 <= s <= 1 for s in got)
    if not [m for m in marks if m[1] is not None]:
        assert set(got) == {0.5}
    same = odd_documents(spark).select(quality.score_text(F.col("text"), spark, model).alias("s"))
    assert np.allclose(sorted(r["s"] for r in same.collect()), sorted(got))


def test_quality_of_nothing(spark):
    measured = quality.with_statistics(no_documents(spark))
    model = quality.fit(measured, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert quality.score_measured(measured, model).collect() == []


# -- language ---------------------------------------------------------------


def test_grams_do_not_depend_on_neighbours():
    texts = [t or "" for _, t, *_ in rows()]
    together, starts, some = langid.hashed(texts)
    ends = np.append(starts[1:], together.shape[1])
    for text, a, b, s in zip(texts, starts, ends, some):
        alone, _, letter = langid.hashed([text])
        assert together[:, a:b].tolist() == alone.tolist()
        assert s == letter[0] == any(c.isalpha() for c in text)


def test_naive_bayes_by_hand(spark):
    data = [(1, "aaa ab", "x"), (2, "abab", "x"), (3, "zz zy", "y"), (4, None, "y"), (5, "bb", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert model.languages == ("x", "y") and np.allclose(np.exp(model.log_prior), [0.5, 0.5])
    got = langid.classify(["aab", "zyz", "", "12", None], model)
    assert got[0] == ["x", "y", "und", "und", "und"] and got[1][2:].tolist() == [0, 0, 0]
    assert (got[1][:2] > 0.5).all() and (got[1] <= 1).all()


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    held = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(remainder("doc_id", 4) == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = langid.identify(docs, langid.fit(docs, F.lit(True))).collect()
    want = sorted((str(d), any(c.isalpha() for c in t or "")) for d, t, *_ in rows())
    assert sorted((str(r["doc_id"]), r["lang_pred"] != "und") for r in got) == want
    untaught = langid.identify(docs, langid.fit(docs, F.lit(False))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"} and {r["score"] for r in untaught} == {0.0}
    assert langid.identify(no_documents(spark), langid.fit(no_documents(spark), F.lit(True))).collect() == []


def test_too_many_languages_is_an_error(spark):
    docs = spark.range(langid.MAX_LANGUAGES + 1).select(F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True))


# -- neighbours -------------------------------------------------------------


def plain_nearest(data, k):
    ok = [(i, v) for i, v in data if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for p, (q, a) in enumerate(ok):
        if q is None or q % 5:
            continue
        a = np.array(a, dtype=np.float64)
        found = []
        for o, (i, b) in enumerate(ok):
            if o != p and len(b) == len(a):
                b = np.array(b, dtype=np.float64)
                found.append((-(a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())), i is None, i or 0))
        out += [(q, r, None if none else i, round(-s, 9)) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"least_blocks": 1, "block_rows": 60, "chunk_rows": 7}])
def test_nearest(spark, options):
    rng = np.random.RandomState(4)
    centers = rng.normal(size=(6, 8))
    data = [(i, (centers[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(230)]
    data += [(300 + i, data[0][1]) for i in range(12)]  # ties
    data += [(400, None), (405, []), (410, [0.0] * 8), (415, [math.nan] * 8), (420, [None, *[1.0] * 7]), (425, [math.inf] * 8)]
    data += [(None, data[1][1]), (0, data[0][1]), (430, [1.0, 2.0]), (435, [2.0, 4.0]), (440, [3.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, rank int, score int")
    got = neighbours.nearest(df, F.col("vec_id") % 5 == 0, **options).collect()
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got), key=str)
    want = plain_nearest(data, 5)
    assert len(got) == len(want)
    assert len(set(got) & set(want)) >= 0.97 * len(want)
    assert [g for g in got if g[0] >= 300 or g[0] == 0] == [w for w in want if w[0] >= 300 or w[0] == 0]


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(empty, F.col("vec_id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(alone, F.col("vec_id") % 5 == 0).collect() == []


def test_search_of_far_vectors_still_ends():
    v = np.eye(4)
    found = neighbours.Block(v, 16, 1).search(-v[:2], np.array([-1, -1]), 9, neighbours.Windows())
    assert [sorted(at.tolist()) for at, _ in found] == [[0, 1, 2, 3]] * 2

