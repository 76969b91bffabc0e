"""Folds, curves, selection, and regression on components."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import regression as reg
from eigenframe.operators import scoring
from eigenframe.operators.gappy_regression import fit_pcr_missing

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@check(
    "folds_contiguous",
    """SELECT o_orderkey, CAST((r * 7 - 1) // n AS INTEGER) AS fold FROM
       (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return reg.assign_folds(df, reg.CV(7, order_by=("o_orderdate", "o_orderkey"))).select("o_orderkey", "fold")


_CODES = """c AS (SELECT o_custkey, row_number() OVER (ORDER BY min((o_orderdate, o_orderkey))) - 1 AS code FROM orders GROUP BY 1)"""


@check("group_codes", f"WITH {_CODES} SELECT o_custkey, code FROM c")
def _(spark, sf):
    return reg.group_codes(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@check(
    "folds_grouped",
    f"""WITH {_CODES} SELECT o_orderkey, CAST(((code + 1) * 5 - 1) // (SELECT count(*) FROM c) AS INTEGER) AS fold FROM orders JOIN c USING (o_custkey)""",
)
def _(spark, sf):
    cv = reg.CV(5, group_by="o_custkey", order_by=("o_orderdate", "o_orderkey"))
    return reg.assign_folds(table(spark, sf, "orders"), cv).select("o_orderkey", "fold")


@check("folds_leave_group_out", f"WITH {_CODES} SELECT o_orderkey, CAST(code AS INTEGER) AS fold FROM orders JOIN c USING (o_custkey)")
def _(spark, sf):
    cv = reg.CV(0, group_by="o_custkey", order_by=("o_orderdate", "o_orderkey"))
    return reg.assign_folds(table(spark, sf, "orders"), cv).select("o_orderkey", "fold")


@check("folds_shuffled")
def _(spark, sf):
    cv = reg.CV(5, group_by="o_custkey", order_by=("o_orderdate", "o_orderkey"), shuffle=True, repeats=2, seed=3)
    return reg.assign_folds(table(spark, sf, "orders"), cv).select("o_orderkey", "repeat", "fold")


@check(
    "forward_chaining",
    """SELECT o_orderkey, CAST((r * 6 - 1) // n AS INTEGER) AS fold FROM
       (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)""",
)
def _(spark, sf):
    cv = reg.CV(5, "forward", order_by=("o_orderdate", "o_orderkey"))
    return reg.assign_folds(table(spark, sf, "orders"), cv).select("o_orderkey", "fold")


@check(
    "regression_metrics",
    """SELECT l_returnflag, count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(e), 4) + 0.0 AS bias, round(stddev_samp(e), 4) AS sep,
       round(avg(abs(e)), 4) AS mae, round(1 - avg(e * e) / var_pop(y), 8) AS r2
       FROM (SELECT l_returnflag, l_extendedprice AS y, 2000 * l_quantity - l_extendedprice AS e FROM lineitem) GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("predicted", 2000 * F.col("l_quantity"))
    out = scoring.regression_metrics(df, "predicted", "l_extendedprice", ["l_returnflag"])
    return _r(_r(out, 4, "rmse", "bias", "sep", "mae"), 8, "r2")


_PRED = """p AS (SELECT l_linenumber AS fold, CAST(k.range AS INTEGER) AS k, l_extendedprice AS y,
    53000 + (l_quantity - 25.5) * k.range * 300 * CASE WHEN k.range > 3 THEN -1 ELSE 1 END AS yhat FROM lineitem, range(6) k)"""
_CURVE = f"""{_PRED}, f AS (SELECT fold, k, sqrt(avg(pow(yhat - y, 2))) AS rmse, avg(abs(yhat - y)) AS mae FROM p GROUP BY 1, 2),
  s AS (SELECT k, avg(rmse) AS rmse_mean, stddev_samp(rmse) / sqrt(count(*)) AS rmse_se, stddev_samp(mae) / sqrt(count(*)) AS mae_se FROM f GROUP BY 1),
  t AS (SELECT k, count(*) AS n, sqrt(avg(pow(yhat - y, 2))) AS rmsecv, avg(yhat - y) AS bias, stddev_samp(yhat - y) AS sep, avg(abs(yhat - y)) AS mae,
    1 - avg(pow(yhat - y, 2)) / var_pop(y) AS q2 FROM p GROUP BY 1),
  c AS (SELECT * FROM t JOIN s USING (k))"""


def _predictions(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    slope = F.col("k") * 300 * F.when(F.col("k") > 3, -1).otherwise(1)
    return df.select(
        F.lit(0).alias("repeat"), F.col("l_linenumber").alias("fold"), "k",
        (53000 + (F.col("l_quantity") - 25.5) * slope).alias("predicted"), F.col("l_extendedprice").alias("measured"),
    )


@check(
    "cv_curve",
    f"""WITH {_CURVE} SELECT k, n, round(rmsecv, 3) AS rmsecv, round(bias, 3) AS bias, round(sep, 3) AS sep, round(mae, 3) AS mae, round(q2, 7) AS q2,
        round(rmse_mean, 3) AS rmse_mean, round(rmse_se, 3) AS rmse_se, round(mae_se, 3) AS mae_se FROM c""",
)
def _(spark, sf):
    out = reg.cv_curve(_predictions(spark, sf)).drop("folds")
    return _r(_r(out, 3, "rmsecv", "bias", "sep", "mae", "rmse_mean", "rmse_se", "mae_se"), 7, "q2")


@check(
    "choose_k",
    f"""WITH {_CURVE}, b AS (SELECT min(rmsecv) AS low, arg_min(k, (rmsecv, k)) AS lowest, arg_min(rmse_se, (rmsecv, k)) AS se FROM c),
        n AS (SELECT k, rmsecv, rmse_se, lead(rmsecv) OVER (ORDER BY k) AS nxt FROM c), m AS (SELECT max(k) AS last FROM c)
        SELECT 'min' AS rule, lowest AS k FROM b
        UNION ALL SELECT 'one-se', min(k) FROM c, b WHERE rmsecv <= low + se
        UNION ALL SELECT 'tolerance', min(k) FROM c, b WHERE rmsecv <= low
        UNION ALL SELECT 'first-min', coalesce(min(k) FILTER (nxt > rmsecv + rmse_se), max(last)) FROM n, m
        UNION ALL SELECT 'wold', coalesce(min(k) FILTER (pow(nxt / rmsecv, 2) > 1), max(last)) FROM n, m""",
)
def _(spark, sf):
    return reg.choose_from_curve(reg.cv_curve(_predictions(spark, sf)))


@check(
    "curve_notes",
    f"""WITH {_CURVE}, x AS (SELECT count(*) - 1 AS last FROM c)
        SELECT arg_min(k, (rmsecv, k)) AS lowest_error, (SELECT rmsecv FROM c, x WHERE k = last) < (SELECT rmsecv FROM c, x WHERE k = last - 1)
          - (SELECT rmse_se FROM c, x WHERE k = last) AS still_falling, arg_min(k, (mae, k)) AS selected_by_other_metric FROM c""",
)
def _(spark, sf):
    n = reg.curve_notes(reg.cv_curve(_predictions(spark, sf)), "min", "rmse")
    return spark.createDataFrame(
        [(n["lowest_error"], n["still_falling"], n["selected_by_other_metric"])],
        "lowest_error int, still_falling boolean, selected_by_other_metric int",
    )


_LAB = "CASE WHEN l_linenumber % 6 <> 0 THEN l_extendedprice + 900 * l_quantity END"


def _items(spark, sf):
    y = F.when(F.col("l_linenumber") % 6 != 0, F.col("l_extendedprice") + 900 * F.col("l_quantity"))
    return table(spark, sf, "lineitem").withColumn("y", y)


@check("labelled_split", f"SELECT count({_LAB}) AS labelled, count(*) - count({_LAB}) AS excluded FROM lineitem")
def _(spark, sf):
    return reg.labelled_split(_items(spark, sf), "y")


@check(
    "pcr_one_variable",
    f"""WITH y AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, {_LAB} AS y FROM lineitem),
        b AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM y)
        SELECT l_orderkey, l_linenumber, l_partkey, y AS measured, round(i + s * x, 3) AS predicted, round(i + s * x - y, 3) + 0.0 AS residual
        FROM y, b WHERE y IS NOT NULL""",
)
def _(spark, sf):
    df = _items(spark, sf)
    model = reg.fit_pcr(df, ["l_quantity"], "y", k=1).model
    return _r(reg.fitted(df, model, KEY), 3, "predicted", "residual")


@check(
    "pcr_quality",
    f"""SELECT round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / regr_count(y, x)), 3) AS rmsec, round(regr_r2(y, x), 8) AS r2c
        FROM (SELECT l_quantity AS x, {_LAB} AS y FROM lineitem)""",
)
def _(spark, sf):
    r = reg.fit_pcr(_items(spark, sf), ["l_quantity"], "y", k=1).model.regression
    return spark.createDataFrame([(round(r.rmsec, 3), round(r.r2c, 8))], "rmsec double, r2c double")


_OCV = """o AS (SELECT o_orderkey, o_totalprice AS y, o_custkey::DOUBLE AS x, (r * 4 - 1) // n AS fold FROM
    (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders))"""


@check(
    "pcr_cv_one_variable",
    f"""WITH {_OCV}, f AS (SELECT DISTINCT fold FROM o),
        b AS (SELECT f.fold, avg(y) AS m, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f JOIN o ON o.fold <> f.fold GROUP BY 1),
        p AS (SELECT o.fold, 0 AS k, m AS yhat, y FROM o JOIN b USING (fold) UNION ALL SELECT o.fold, 1, i + s * x, y FROM o JOIN b USING (fold))
        SELECT k, count(*) AS n, round(sqrt(avg(pow(yhat - y, 2))), 3) AS rmsecv, round(avg(yhat - y), 3) + 0.0 AS bias,
          round(avg(abs(yhat - y)), 3) AS mae FROM p GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("x", F.col("o_custkey").cast("double"))
    out = reg.fit_pcr(df, ["x"], "o_totalprice", cv=reg.CV(4, order_by=("o_orderdate", "o_orderkey"))).curve
    return _r(out, 3, "rmsecv", "bias", "mae").select("k", "n", "rmsecv", "bias", "mae")


@check(
    "pcr_forward_one_variable",
    f"""WITH {_OCV}, b AS (SELECT f.range AS fold, avg(y) AS m, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM range(1, 4) f JOIN o ON o.fold < f.range GROUP BY 1),
        p AS (SELECT o.fold, 0 AS k, m AS yhat, y FROM o JOIN b USING (fold) UNION ALL SELECT o.fold, 1, i + s * x, y FROM o JOIN b USING (fold))
        SELECT k, count(*) AS n, round(sqrt(avg(pow(yhat - y, 2))), 3) AS rmsecv, round(avg(yhat - y), 3) + 0.0 AS bias,
          round(avg(abs(yhat - y)), 3) AS mae FROM p GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("x", F.col("o_custkey").cast("double"))
    cv = reg.CV(3, "forward", order_by=("o_orderdate", "o_orderkey"))
    out = reg.fit_pcr(df, ["x"], "o_totalprice", cv=cv).curve
    return _r(out, 3, "rmsecv", "bias", "mae").select("k", "n", "rmsecv", "bias", "mae")


_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@check("pcr_cv")
def _(spark, sf):
    cv = reg.CV(10, order_by=_ORDER)
    return reg.fit_pcr(_items(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_suppkey"], "y", cv=cv).curve


@check("pcr_cv_grouped_repeats")
def _(spark, sf):
    cv = reg.CV(5, group_by="l_suppkey", order_by=_ORDER, shuffle=True, repeats=2, seed=1)
    return reg.fit_pcr(_items(spark, sf), ["l_quantity", "l_discount", "l_tax"], "y", cv=cv).out_of_fold


@check("pcr_wide_rows")
def _(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("y", F.element_at("embedding", 1) * 3 + F.element_at("embedding", 9) + F.col("label"))
    return reg.fit_pcr(df, "embedding", "y", cv=reg.CV(5, order_by=("vec_id",)), max_components=12).curve


# 5,000 predictors of two kinds: two components are the plane of both, so the fit is that of two variables.
@check(
    "pcr_very_wide",
    """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS y, o_custkey / 1000.0 AS a, o_orderkey % 1009 / 100.0 AS b FROM orders),
       m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c, covar_pop(a, y) AS ya,
         covar_pop(b, y) AS yb FROM o),
       f AS (SELECT *, (ya * vb - yb * c) / (va * vb - c * c) AS pa, (yb * va - ya * c) / (va * vb - c * c) AS pb FROM m)
       SELECT o_orderkey, round(my + pa * (a - ma) + pb * (b - mb), 5) AS predicted, round(my + pa * (a - ma) + pb * (b - mb) - y, 5) AS residual FROM o, f""",
)
def _(spark, sf):
    kinds = F.flatten(F.array_repeat(F.array(*["a", "b"] * 50), 50))
    df = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") / 1000.0).alias("a"), (F.col("o_orderkey") % 1009 / 100.0).alias("b")
    ).repartition(max(16, 4 * spark.sparkContext.defaultParallelism)).withColumn("x", kinds)
    fit = reg.fit_pcr(df, "x", "y", k=2, scaling="center")
    out = reg.fitted(df, fit.model, ["o_orderkey"])
    return out.select("o_orderkey", F.round("predicted", 5).alias("predicted"), F.round("residual", 5).alias("residual"))


# One variable 5,000 times over: every component count but 0 and 1 is out of reach, and the curve is that of one variable.
@check(
    "pcr_cv_very_wide",
    """WITH o AS (SELECT o_totalprice / 1000 AS y, o_custkey / 1000.0 AS x, floor(((row_number() OVER (ORDER BY o_orderkey)) * 4 - 1) / count(*) OVER ()) AS f FROM orders),
       t AS (SELECT g.f, avg(y) AS my, avg(x) AS mx, covar_pop(x, y) / var_pop(x) AS s FROM o, (SELECT DISTINCT f FROM o) g WHERE g.f <> o.f GROUP BY 1),
       e AS (SELECT k, my + CASE WHEN k = 1 THEN s * (x - mx) ELSE 0 END - y AS e FROM o JOIN t USING (f), (VALUES (0), (1)) v(k))
       SELECT k, count(*) AS n, round(sqrt(avg(e * e)), 5) AS rmsecv, round(avg(e), 5) + 0.0 AS bias, round(avg(abs(e)), 5) AS mae FROM e GROUP BY 1""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") / 1000.0).alias("a"))
    wide = df.repartition(max(16, 4 * spark.sparkContext.defaultParallelism)).withColumn("x", F.array_repeat("a", 5000))
    curve = reg.fit_pcr(wide, "x", "y", cv=reg.CV(4, order_by=("o_orderkey",)), max_components=2, scaling="center").curve
    return curve.select("k", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("rmsecv", "bias", "mae")])


# Ten folds ten times over rows with gaps: each labelled row is held out once per repeat. The mean of the labelled
# rows left is what no component predicts, so the errors of k = 0 follow from the folds alone.
@check(
    "pcr_missing_repeats",
    """SELECT k, 10 * n AS n, 100 AS folds, true AS falls FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey % 9 > 0), (VALUES (0), (1)) v(k)""",
)
def _(spark, sf):
    x, y, key = F.col("o_totalprice") / 1000, F.col("o_custkey").cast("double"), F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(key % 7 > 0, x).alias("a"), F.when(key % 5 > 0, x * 2 + y / 1000).alias("b"), F.when(key % 9 > 0, x * 3 - y / 500).alias("y")
    )
    cv = reg.CV(10, order_by=("o_orderkey",), shuffle=True, repeats=10, seed=4)
    curve = fit_pcr_missing(df, ["a", "b"], "y", cv=cv, max_components=1).curve
    least = F.min("rmsecv").over(Window.partitionBy(F.lit(0)))  # a row per component count
    falls = F.when(F.col("k") == 1, F.col("rmsecv") == least).otherwise(F.col("rmsecv") > least)
    return curve.select("k", "n", F.col("folds").cast("int").alias("folds"), falls.alias("falls"))


@check(
    "pcr_robust_groups_out",
    """SELECT k, n, folds FROM (SELECT count(*) AS n, count(DISTINCT l_suppkey) AS folds FROM lineitem WHERE l_linenumber % 6 <> 0), (VALUES (0), (1), (2)) v(k)""",
)
def _(spark, sf):
    cv = reg.CV(0, group_by="l_suppkey", order_by=_ORDER)
    curve = reg.fit_pcr(_items(spark, sf), ["l_quantity", "l_discount"], "y", cv=cv, scaling="robust", max_components=2).curve
    return curve.select("k", "n", "folds")


@check(
    "folds_shuffled_rows",
    """SELECT r AS repeat, f AS fold, (f + 1) * n // 7 - f * n // 7 AS n, 0::BIGINT AS twice FROM (SELECT count(*) AS n FROM lineitem), range(3) a(r), range(7) b(f)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_ORDER)
    out = reg.assign_folds(df, reg.CV(7, order_by=_ORDER, shuffle=True, repeats=3, seed=9))
    per = out.groupBy("repeat", "fold").agg(F.count("*").alias("n"))
    # One grouping of the rows of all repeats and of the table itself, in place of a join of two.
    both = out.select("repeat", *_ORDER).unionByName(df.withColumn("repeat", F.lit(-1))).filter(" and ".join(f"{c} is not null" for c in _ORDER))
    seen = both.groupBy(*_ORDER).agg(*[F.count_if(F.col("repeat") == r).alias(f"c{r + 1}") for r in range(-1, 3)])
    off = sum((F.when((F.col(f"c{r}") > 0) & (F.col(f"c{r}") != F.col("c0")), 1).otherwise(0) for r in (1, 2, 3)), F.lit(0))
    twice = seen.agg(F.coalesce(F.sum(off), F.lit(0))).first()[0]
    return per.withColumn("twice", F.lit(twice).cast("long"))
