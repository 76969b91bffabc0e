"""Groups too long for a task: the split plans must give what one window gives."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eigenframe.plans import ranges
from eigenframe.operators import joins, profile, rows, windows
from eigenframe.operators.missing import fill
from eigenframe.plans import quantiles as qn
from eigenframe.plans.ranges import count_upto, dense_index, running_total, with_range


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(5)
    data = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else f"s{i % 40}"
        data.append((i, s, rnd.randrange(400), rnd.choice([None, None, round(rnd.gauss(0, 5), 3)]), rnd.choice("abc")))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id long, s string, t int, v double, lab string").repartition(7)


def same(a, b, keys):
    x = a.toPandas().sort_values(keys).reset_index(drop=True)
    y = b.toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(x[sorted(x.columns)], y[sorted(y.columns)], check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("by", [[], ["s"]])
def test_dense_index(series, by):
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t", "id")
    want = series.withColumn("_pos", F.row_number().over(w) - 1)
    same(dense_index(series, ["t", "id"], by, group_rows=60), want, ["id"])
    same(dense_index(series.orderBy("id"), ["t", "id"], by, group_rows=7), want, ["id"])


def test_ranges_split_a_hot_group(series):
    got = with_range(series, ["s", "t", "id"], 50).filter("s = 'hot'").groupBy("_rng").count().toPandas()
    assert len(got) > 5 and got["count"].max() < 400


@pytest.mark.parametrize("by", [[], ["s"]])
def test_running_total(series, by):
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = series.withColumn("_before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    same(running_total(series, F.col("t"), ["t", "id"], by, group_rows=60), want, ["id"])


def test_count_upto(spark):
    df = spark.range(-3, 30).select(F.col("id").cast("double").alias("x"))
    table = F.array(*[F.lit(float(v)) for v in (0, 2, 2, 9, 20)])
    got = df.select("x", count_upto(table, 5, F.col("x")).alias("n")).collect()
    assert all(r["n"] == sum(v <= r["x"] for v in (0, 2, 2, 9, 20)) for r in got)


@pytest.mark.parametrize("strategy", ["forward", "backward"])
@pytest.mark.parametrize("by", [[], ["s"]])
def test_fill(series, strategy, by):
    kw = dict(order_by=["t", "id"], partition_by=by)
    same(fill(series, strategy, ["v"], group_rows=40, **kw), fill(series, strategy, ["v"], **kw), ["id"])


@pytest.mark.parametrize("by", [[], ["s"]])
def test_lag_embed(series, by):
    df = series.withColumn("v", F.coalesce("v", F.lit(0.0)))
    for mode in ("first", "last", "majority"):
        args = (df, ["v", "t"], 6, ["t", "id"], by, "lab", mode)
        same(windows.lag_embed(*args, group_rows=9), windows.lag_embed(*args), ["id"])


@pytest.mark.parametrize("by", [[], ["s"]])
def test_rolling_returns_autocorrelation(series, by):
    df = series.withColumn("v", F.coalesce("v", F.lit(1.5)))
    for stat in ("mean", "sd", "volatility", "ratio"):
        args = (df, "v", 5, stat, ["t", "id"], by)
        same(windows.rolling(*args, group_rows=11), windows.rolling(*args), ["id"])
    same(windows.returns(df, "v", ["t", "id"], by, group_rows=11), windows.returns(df, "v", ["t", "id"], by), ["id"])
    a = windows.autocorrelation(df, "v", 4, ["t", "id"], by, group_rows=11)
    same(a, windows.autocorrelation(df, "v", 4, ["t", "id"], by), [*by, "lag"])


@pytest.mark.parametrize("by", [[], ["s"]])
def test_average_rank(series, by):
    got = windows.average_rank(series, "t", "r", by, group_rows=30).toPandas()
    grouped = got.groupby("s")["t"] if by else got["t"]
    assert np.allclose(got["r"], grouped.rank(method="average"))


def test_exclude_and_number(series):
    assert rows.exclude_rows(series, "1,5-9", ["t", "id"], group_rows=20).count() == 3000 - 6
    with pytest.raises(ValueError):
        rows.exclude_rows(series, "3001", ["t", "id"])
    got = rows.number_rows(series, ["t", "id"], 10, -2, "nr", group_rows=20).toPandas().sort_values(["t", "id"])
    assert list(got["nr"]) == [10 - 2 * i for i in range(3000)]


def test_missing_pattern(spark):
    df = spark.range(500).select(
        "id",
        F.when(F.col("id") % 7 != 2, 1.0).alias("even"),
        F.when(~F.col("id").isin(3, 9, 15, 22), 1.0).alias("odd"),
        F.when(F.col("id") >= 4, 1.0).alias("top"),
        F.when(F.col("id") < 490, 1.0).alias("bottom"),
        F.lit(1.0).alias("none"),
    )
    got = profile.missing_pattern(df, df.columns[1:], ["id"], group_rows=30).collect()
    want = {"even": "systematic", "odd": "random", "top": "top", "bottom": "bottom", "none": "none"}
    assert {r["column"]: r["pattern"] for r in got} == want


@pytest.mark.parametrize("how", ["linear", "lower"])
def test_quantiles_by_brackets(spark, how):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 0.25), [np.nan] * 5])
    y = rng.exponential(size=len(x))
    pdf = pd.DataFrame({"x": x, "y": y})
    df = spark.createDataFrame(pdf).select(F.nanvl("x", F.lit(None).cast("double")).alias("x"), "y")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = qn.quantiles(df, ["x", "y"], probs, how, limit=20)
    method = "linear" if how == "linear" else "inverted_cdf"
    for c in ("x", "y"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs, method=method))
        assert np.allclose(got[c], qn.quantiles(df, ["x", "y"], probs, how)[c])


def test_grouped_quantile(series):
    got = qn.grouped_quantile(series, ["s"], ["v", "t"], limit=5, group_rows=20).toPandas().set_index("s").sort_index()
    want = series.toPandas().groupby("s")[["v", "t"]].median().sort_index()
    assert np.allclose(got["v"], want["v"], equal_nan=True) and np.allclose(got["t"], want["t"])


def timed(rnd, n, span, hot=None):
    """Periods of all kinds: nested, equal, touching, open, empty, without a begin; NULL keys."""
    out = []
    for p in range(n):
        a = rnd.choice([hot, rnd.randrange(span)]) if hot is not None else rnd.randrange(span)
        b = rnd.choice([None, a + rnd.randrange(-1, 6), a + rnd.randrange(1, span), a + 1])
        out.append((rnd.choice([None, p % 13]), p, rnd.choice([None, a, a, a, a, a, a, a]), b))
    return out


@pytest.mark.parametrize(("n", "span", "hot"), [(9, 40, None), (300, 60, None), (300, 5000, 7), (40, 3, 1), (0, 5, None)])
@pytest.mark.parametrize(("group_rows", "range_ends"), [(4_000_000, 200_000), (16, 9)])
def test_interval_join(spark, monkeypatch, n, span, hot, group_rows, range_ends):
    rnd = random.Random(n + span)
    periods = timed(rnd, n, span, hot)
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    per = spark.createDataFrame(periods, "k int, p int, a int, b int").withColumns({"a": day("a"), "b": day("b")}).repartition(3)
    times = [rnd.choice([None, hot if hot is not None else 3, rnd.randrange(-2, span + 2)]) for _ in range(400)]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(times)], "id int, d int").repartition(5)
    df = df.withColumns({"t": day("d"), "r": F.lit(1), "s": F.lit("x"), "kind": F.lit(2)})

    def first(t):
        hits = [(k is not None, k or 0, p) for k, p, a, b in periods if t is not None and a is not None and a <= t and (b is None or t < b)]
        return min(hits)[2] if hits else None

    want = sorted(str((i // 2, t, first(t))) for i, t in enumerate(times))
    for most in (4096, -1):
        monkeypatch.setattr(joins, "SMALL_PERIODS", most)
        out = joins.interval_join(df, "t", per, "a", "b", ["k"], group_rows=group_rows, range_ends=range_ends)
        assert out.columns == [*df.columns, *per.columns]
        got = out.select("id", "d", "p").collect()
        assert sorted(str(tuple(r)) for r in got) == want


def test_missing_pattern_reads_its_rows_once(spark, monkeypatch):
    kept, keep = [], profile.stored
    monkeypatch.setattr(profile, "stored", lambda df, name: (kept.append(name), keep(df, name))[1])
    df = spark.range(50).select("id", F.when(F.col("id") % 5 != 2, 1.0).alias("a"))
    got = profile.missing_pattern(df, ["a"], ["id"], group_rows=10).collect()
    assert [(r["column"], r["pattern"]) for r in got] == [("a", "systematic")] and kept == ["gaps", "placed"]


def test_periods_with_the_same_ends_are_cut_once(spark, monkeypatch):
    seen, named = [], joins._named_segments
    monkeypatch.setattr(joins, "_named_segments", lambda spans, *more: (seen.append(spans.count()), named(spans, *more))[1])
    monkeypatch.setattr(joins, "SMALL_PERIODS", 10)
    per = spark.range(600).select((600 - F.col("id")).alias("k"), F.timestamp_seconds(F.col("id") % 15).alias("a"), F.timestamp_seconds(F.col("id") % 15 + 3).alias("b"))
    df = spark.range(25).select(F.timestamp_seconds("id").alias("t"), "id")
    got = {r["id"]: r["k"] for r in joins.interval_join(df, "t", per, "a", "b", ["k"]).collect()}
    rows = [(600 - i, i % 15) for i in range(600)]
    assert got == {t: min((k for k, a in rows if a <= t < a + 3), default=None) for t in range(25)}
    assert seen == [15]


def test_cuts_sort_only_ranges_that_hold_one(spark, monkeypatch):
    monkeypatch.setattr(ranges, "dense_index", None)  # numbering all rows is not needed
    keys = [(None if i % 50 == 0 else i % 13, i) for i in range(700)]
    df = spark.createDataFrame(keys, "a int, b int").repartition(6)
    positions = [0, 1, 99, 100, 101, 350, 699, 800]
    cut = ranges.cuts_before(df, ["a", "b"], positions, 700, group_rows=320)
    got = {(r["a"], r["b"]): r["c"] for r in df.select("a", "b", cut.alias("c")).collect()}
    order = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert [got[k] for k in order] == [sum(p <= at for p in positions) for at in range(700)]
