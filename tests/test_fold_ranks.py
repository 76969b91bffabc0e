"""Order statistics and cut points that are found by counting."""

import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eigenframe.operators import diagnostics
from eigenframe.operators import regression as reg
from eigenframe.plans import fold_ranks
from eigenframe.plans.products import Rows
from eigenframe.plans.ranges import hash_cuts

DOUBLES = st.lists(st.floats(allow_nan=False), min_size=1, max_size=30)


@given(DOUBLES)
def test_integers_in_the_order_of_doubles(values):
    x = np.array(values) + 0.0
    i = fold_ranks.ordered(x)
    assert (np.argsort(i, kind="stable") == np.argsort(x, kind="stable")).all() and (fold_ranks.unordered(i) == x).all()


@pytest.mark.parametrize("cells", [8_000_000, 2000])
def test_values_at_ranks(spark, monkeypatch, cells):
    monkeypatch.setattr(fold_ranks, "HELD_CELLS", cells)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 3)) * [1, 1e-9, 1e12], 1) * [1, 1e-9, 1]
    x[:40, 2] = -0.0
    fold = rng.integers(0, 7, 90)
    df = spark.createDataFrame([(r.tolist(), 0, int(f)) for r, f in zip(x, fold)], "x array<double>, repeat int, fold int").repartition(4)
    rows = Rows(df, F.col("x"), 3, folds=("repeat", "fold"))
    keys, sizes = [(0, f) for f in range(7)], [int((fold != f).sum()) for f in range(7)]
    median, spread = fold_ranks.robust_scales(rows, keys, sizes)
    for f in range(7):
        own = np.sort(x[fold != f], axis=0)
        at = -(-len(own) // 2) - 1
        assert (median[f] == own[at]).all()
        assert (spread[f] == np.sort(np.abs(own - own[at]), axis=0)[at]).all()


@pytest.mark.parametrize("rows", [100_000, 30, 0])
def test_hash_cuts(spark, rows):
    df = spark.range(2000).select("id", (F.col("id") % 17).alias("k"))
    mix = F.when(F.col("k") == 0, F.lit(-5).cast("long")).otherwise(F.xxhash64("id"))  # many rows share one hash
    order = [r["id"] for r in df.withColumn("m", mix).orderBy("m", "id").collect()]
    positions = [1, 400, 401, 999, 1024, 1100, 1999]
    got = {r["id"]: r["c"] for r in df.select("id", hash_cuts(df, mix, ["id"], positions, rows).alias("c")).collect()}
    assert [got[i] for i in order] == [sum(p <= at for p in positions) for at in range(2000)]


def test_shuffled_folds_do_not_sort_rows(spark):
    df = spark.range(1000).select("id", F.lit("x").alias("payload"))
    out = reg.assign_folds(df, reg.CV(7, order_by=("id",), shuffle=True, repeats=3, seed=5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    sizes = out.groupBy("repeat", "fold").count().collect()
    assert len(sizes) == 21 and {r["count"] for r in sizes} == {142, 143}
    assert out.groupBy("id", "repeat").count().filter("count <> 1").count() == 0
    both = out.filter("repeat < 2").groupBy("id").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).filter("a = b").count()
    assert both < 300  # repeats differ


def test_robust_scaling_with_many_groups_left_out(spark):
    rng = random.Random(2)
    rows = [(i, f"g{i % 70}", rng.gauss(0, 1), rng.gauss(5, 100) if i % 9 else None, rng.gauss(1, 2)) for i in range(280)]
    df = spark.createDataFrame(rows, "id long, g string, y double, a double, b double").fillna({"a": 3.0})
    cv = reg.CV(0, group_by="g", order_by=("id",))
    out = reg.fit_pcr(df, ["a", "b"], "y", cv=cv, scaling="robust", max_components=2, rule="min")
    assert out.curve.count() == 3 and {r["folds"] for r in out.curve.collect()} == {70}
    x, y, g = np.array([(r[3] if r[3] is not None else 3.0, r[4]) for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    sq = 0.0
    for f in np.unique(g):
        own = x[g != f]
        at = -(-len(own) // 2) - 1
        med = np.sort(own, axis=0)[at]
        mad = 1.4826 * np.sort(np.abs(own - med), axis=0)[at]
        z = np.column_stack([np.ones(len(own)), (own - med) / mad])
        beta = np.linalg.lstsq(z, y[g != f], rcond=None)[0]
        mine = g == f
        sq += ((np.column_stack([np.ones(mine.sum()), (x[mine] - med) / mad]) @ beta - y[mine]) ** 2).sum()
    assert out.curve.filter("k = 2").first()["rmsecv"] == pytest.approx((sq / len(y)) ** 0.5, rel=1e-8)


@pytest.mark.parametrize("group_rows", [4_000_000, 40])
def test_ranks_of_many_columns(spark, group_rows):
    import pandas as pd

    rng = random.Random(3)
    rows = [(float(rng.randrange(6)), rng.choice([None, 1.0, 2.0, 2.0, -0.0, 0.0]), rng.gauss(0, 1), 7.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    sets = [["a", "c", "d"], ["b", "a"], ["c"]]
    got = diagnostics._ranks_of(df, sets, 300, group_rows).collect()
    whole = pd.DataFrame(rows, columns=list("abcd"))
    for k, some in enumerate(sets):
        want = whole[some].dropna().rank()
        mine = pd.DataFrame([r["ranks"] for r in got if r["set"] == k], columns=some)
        assert np.allclose(np.sort(mine.to_numpy(), axis=0), np.sort(want.to_numpy(), axis=0))
        assert np.isclose(np.nan_to_num(mine.corr()).sum(), np.nan_to_num(want.corr()).sum())


@pytest.mark.parametrize("near", [2_000_000, 5])
def test_scales_of_many_groups_left_out_share_their_scans(spark, monkeypatch, near):
    monkeypatch.setattr(fold_ranks, "NEAR", near)
    asked, count = [], fold_ranks._counts
    monkeypatch.setattr(fold_ranks, "_counts", lambda rows, keys, *more: (asked.append(len(keys)), count(rows, keys, *more))[1])
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, 900), rng.normal(size=900), -rng.integers(0, 2, 900) * 1e9]) + 0.0
    fold, repeat = rng.integers(-1, 30, 900), np.zeros(900, dtype=int)
    cells = [(r.tolist(), int(a) if f >= 0 else None, int(f) if f >= 0 else None) for r, a, f in zip(x, repeat, fold)]
    df = spark.createDataFrame(cells, "x array<double>, repeat int, fold int").repartition(4)
    rows = Rows(df, F.col("x"), 3, folds=("repeat", "fold"))
    keys = sorted({(int(a), int(f)) for a, f in zip(repeat, fold) if f >= 0})
    learns = [(fold == -1) | ((repeat == a) & (fold != f)) for a, f in keys]
    median, spread = fold_ranks.robust_scales(rows, keys, [int(own.sum()) for own in learns], left_out=True)
    for i, chosen in enumerate(learns):
        own = np.sort(x[chosen], axis=0)
        at = -(-len(own) // 2) - 1
        assert (median[i] == own[at]).all()
        assert (spread[i] == np.sort(np.abs(own - own[at]), axis=0)[at]).all()
    assert max(asked) == (2 if near > 5 else len(keys))


def test_ranks_sort_no_column_of_few_values(spark):
    rows = [(float(i % 3), float(i % 7), None if i % 5 == 0 else float(i * 37 % 400)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(4)
    plan = diagnostics._ranks_of(df, [["a", "b"]], 400, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    mixed = diagnostics._ranks_of(df, [["a", "c"]], 400, 40)
    order = [x for _, _, x in rows if x is not None]
    assert sorted(r["ranks"][1] for r in mixed.collect()) == [float(i + 1) for i in range(len(order))]


def test_edges_of_shuffled_folds_are_compared_with_few_rows(spark):
    df = spark.range(3000)
    cut = hash_cuts(df, F.xxhash64("id"), ["id"], [1000, 2000])
    plan = df.select(cut.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(" in plan  # a look-up by leading bits comes before the comparison of whole keys
    assert [r["count"] for r in df.select(cut.alias("c")).groupBy("c").count().orderBy("c").collect()] == [1000] * 3
