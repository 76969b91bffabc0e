"""Components, scores, diagnostics, lagged and kernel models."""

import numpy as np
from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import diagnostics, gappy, kernel, lagged, scoring
from eigenframe.operators.pca import PCAModel, Regression, explained_variance, fit_pca, loadings_table, variable_correlations
from eigenframe.operators.rowstage import RowStage

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
_K = ", ".join(KEY)
_KA = ", ".join(f"a.{k}" for k in KEY)

# A model with round numbers, so that everything made from it is plain SQL.
CENTER, DIVISOR = [25.5, 53000.0, 0.05, 0.04], [14.4, 30000.0, 0.03, 0.025]
P = np.array([[0.5, 0.5], [0.5, -0.5], [0.5, 0.5], [0.5, -0.5]])
LAMBDA = [1.2, 0.9]
LIMITS = {"t2_95": 4.5, "t2_99": 6.0, "q_95": 3.2, "q_99": 4.0, "t2_999": 9.0}
GAMMA, INTERCEPT = (3.0, -2.0), 10.0


def given() -> PCAModel:
    d = np.array(DIVISOR)
    beta = (P @ np.array(GAMMA)) / d
    reg = Regression("y", 2, GAMMA, INTERCEPT, tuple(beta), float(INTERCEPT - beta @ np.array(CENTER)), True)
    return PCAModel(
        "svd", tuple(FEATURES), 4, 2, 1000, "standard", np.array(CENTER), d, P, np.array(LAMBDA),
        np.array([1.2, 0.9, 0.5, 0.3]), np.array([1.2, 0.9]) / 2.9, score_mean=np.zeros(2), score_cov=np.diag(LAMBDA),
        limits=LIMITS, regression=reg,
    )


def _given_sql(extra=""):
    z = ", ".join(f"(({f} - {a}) / {b}) AS z{i}" for i, (f, a, b) in enumerate(zip(FEATURES, CENTER, DIVISOR)))
    t = ", ".join("(" + " + ".join(f"z{i} * {P[i, j]}" for i in range(4)) + f") AS pc{j + 1}" for j in range(2))
    q = " + ".join(f"pow(z{i} - (pc1 * {P[i, 0]} + pc2 * {P[i, 1]}), 2)" for i in range(4))
    return f"""z AS (SELECT *, {z}{extra} FROM lineitem), t AS (SELECT *, {t} FROM z),
      s AS (SELECT *, pc1 * pc1 / {LAMBDA[0]} + pc2 * pc2 / {LAMBDA[1]} AS t2, {q} AS q FROM t),
      o AS (SELECT *, t2 > {LIMITS['t2_95']} OR q > {LIMITS['q_95']} AS outside FROM s)"""


def _scored(spark, sf):
    return scoring.with_outside(scoring.score(table(spark, sf, "lineitem"), given(), KEY), given())


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


@check(
    "score_given",
    f"WITH {_given_sql()} SELECT {_K}, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in ('pc1', 'pc2', 't2', 'q'))}, outside FROM o",
)
def _(spark, sf):
    return _r(_scored(spark, sf), 7, "pc1", "pc2", "t2", "q")


@check(
    "fit_diagnostics_given",
    f"""WITH {_given_sql()} SELECT {_K}, round(d, 7) AS t2_fit, round(sqrt(d), 7) AS mahalanobis, d > {LIMITS['t2_999']} AS outlier FROM
        (SELECT *, pc1 * pc1 / ({LAMBDA[0]} + 1e-4) + pc2 * pc2 / ({LAMBDA[1]} + 1e-4) AS d FROM s)""",
)
def _(spark, sf):
    out = scoring.with_fit_diagnostics(scoring.score(table(spark, sf, "lineitem"), given(), KEY), given())
    return _r(out, 7, "t2_fit", "mahalanobis").select(*KEY, "t2_fit", "mahalanobis", "outlier")


@check(
    "outside_counts",
    f"""WITH {_given_sql()} SELECT count(*) AS n, count(*) FILTER (t2 > {LIMITS['t2_95']}) AS above_t2,
        count(*) FILTER (q > {LIMITS['q_95']}) AS above_q, count(*) FILTER (outside) AS outside FROM o""",
)
def _(spark, sf):
    return scoring.outside_counts(_scored(spark, sf), given())


@check(
    "double_outliers",
    f"WITH {_given_sql()} SELECT {_K} FROM o WHERE t2 > {LIMITS['t2_95']} AND q > {LIMITS['q_95']}",
)
def _(spark, sf):
    return scoring.double_outliers(_scored(spark, sf), given()).select(*KEY)


@check(
    "reconstruct_given",
    f"""WITH {_given_sql()} SELECT {_K}, """
    + ", ".join(
        f"round((pc1 * {P[i, 0]} + pc2 * {P[i, 1]}) * {DIVISOR[i]} + {CENTER[i]}, {(9, 4, 12, 12)[i]}) + 0.0 AS {f}" for i, f in enumerate(FEATURES)
    )
    + " FROM t",
)
def _(spark, sf):
    out = scoring.reconstruct(table(spark, sf, "lineitem"), given(), KEY)
    return _r(_r(_r(out, 4, "l_extendedprice"), 9, "l_quantity"), 12, "l_discount", "l_tax")


@check(
    "predict_given",
    f"WITH {_given_sql()} SELECT {_K}, round({INTERCEPT} + pc1 * {GAMMA[0]} + pc2 * {GAMMA[1]}, 7) + 0.0 AS predicted FROM t",
)
def _(spark, sf):
    return _r(scoring.predict(table(spark, sf, "lineitem"), given(), KEY), 7, "predicted")


_Y = "l_quantity * 0.4 + l_linenumber"


def _parts(where):
    return f"""count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmsep, round(avg(e), 6) AS bias, round(stddev_samp(e), 6) AS sep,
      round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM (SELECT *, {INTERCEPT} + pc1 * {GAMMA[0]} + pc2 * {GAMMA[1]} - y AS e
      FROM (SELECT *, {_Y} AS y FROM o)) {where}"""


@check(
    "prediction_error",
    f"""WITH {_given_sql()} SELECT 'all' AS part, {_parts('')} UNION ALL SELECT 'inside', {_parts('WHERE NOT outside')}
        UNION ALL SELECT 'outside', {_parts('WHERE outside')}""",
)
def _(spark, sf):
    y = (F.col("l_quantity") * 0.4 + F.col("l_linenumber")).alias("y")
    df = table(spark, sf, "lineitem").withColumn("y", y)
    scored = scoring.with_outside(scoring.score(df, given(), ["y"]), given())
    out = scored.withColumn("predicted", INTERCEPT + F.col("pc1") * GAMMA[0] + F.col("pc2") * GAMMA[1])
    return _r(scoring.prediction_error(out, "predicted", "y"), 6, "rmsep", "bias", "sep", "r2")


@check(
    "top_contributors",
    f"WITH {_given_sql()} SELECT l_orderkey, round(max(abs(pc1)), 7) AS contribution FROM t GROUP BY 1 ORDER BY max(abs(pc1)) DESC, 1 LIMIT 20",
)
def _(spark, sf):
    per = _scored(spark, sf).groupBy("l_orderkey").agg(F.max(F.abs("pc1")).alias("pc1"))
    return _r(scoring.top_contributors(per, "l_orderkey", "pc1"), 7, "contribution")


@check("align_columns", "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return scoring.align(table(spark, sf, "lineitem").select(*sorted(FEATURES), "l_orderkey"), given())


# --- fitted models whose eigenvalues have a closed form -------------------------------------

_TWO = """m AS (SELECT avg(l_quantity) AS ma, avg(l_quantity * 0.5 + 100 * l_discount) AS mb, var_samp(l_quantity) AS a,
    covar_samp(l_quantity, l_quantity * 0.5 + 100 * l_discount) AS b, var_samp(l_quantity * 0.5 + 100 * l_discount) AS c FROM lineitem),
  e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2,
    0.5 * atan2(2 * b, a - c) AS th FROM m)"""


def _two(spark, sf):
    return table(spark, sf, "lineitem").withColumn("w", F.col("l_quantity") * 0.5 + 100 * F.col("l_discount"))


def _pair(name, **kw):
    @check(
        name,
        f"""WITH {_TWO} SELECT 'PC1' AS component, round(l1, 6) AS eigenvalue, round(l1 / (l1 + l2), 9) AS ratio, round(l1 / (l1 + l2), 9) AS cumulative FROM e
            UNION ALL SELECT 'PC2', round(l2, 6), round(l2 / (l1 + l2), 9), 1.0 FROM e""",
    )
    def _(spark, sf):
        model = fit_pca(_two(spark, sf), ["l_quantity", "w"], 2, scaling="center", **kw)
        return explained_variance(spark, model).withColumns(
            {"eigenvalue": F.round("eigenvalue", 6), "ratio": F.round("ratio", 9), "cumulative": F.round("cumulative", 9)}
        )


_pair("pca_closed_form")
_pair("pca_tall_skinny", solver="tsqr")
_pair("nipals_closed_form", method="nipals")


@check(
    "pca_loadings",
    f"""WITH {_TWO} SELECT 'l_quantity' AS variable, 1 AS component, round(abs(cos(th)), 8) AS loading FROM e
        UNION ALL SELECT 'w', 1, round(abs(sin(th)), 8) FROM e
        UNION ALL SELECT 'l_quantity', 2, round(-abs(sin(th)), 8) FROM e UNION ALL SELECT 'w', 2, round(abs(cos(th)), 8) FROM e""",
)
def _(spark, sf):
    # The larger loading of a component is positive: cos > sin here, and the signs of the second differ.
    model = fit_pca(_two(spark, sf), ["l_quantity", "w"], 2, scaling="center")
    return loadings_table(spark, model).withColumn("loading", F.round("loading", 8))


@check(
    "pca_scores_t2",
    f"""WITH {_TWO} SELECT {_K}, round(pow(x * cos(th) + y * sin(th), 2) / l1 + pow(y * cos(th) - x * sin(th), 2) / l2, 6) AS t2,
        round(pow(x * cos(th) + y * sin(th), 2) / (l1 + 1e-4) + pow(y * cos(th) - x * sin(th), 2) / (l2 + 1e-4), 6) AS t2_fit, 0::DOUBLE AS q
        FROM (SELECT *, l_quantity - ma AS x, l_quantity * 0.5 + 100 * l_discount - mb AS y FROM lineitem, e)""",
)
def _(spark, sf):
    df = _two(spark, sf)
    model = fit_pca(df, ["l_quantity", "w"], 2, scaling="center")
    out = scoring.with_fit_diagnostics(scoring.score(df, model, KEY), model)
    return _r(out, 6, "t2", "t2_fit", "q").select(*KEY, "t2", "t2_fit", "q")


@check(
    "variable_correlations",
    f"""WITH {_TWO} SELECT 'l_quantity' AS variable, 1 AS component, round(abs(cos(th)) * sqrt(l1 / a), 7) AS r FROM e
        UNION ALL SELECT 'w', 1, round(abs(sin(th)) * sqrt(l1 / c), 7) FROM e
        UNION ALL SELECT 'l_quantity', 2, round(-abs(sin(th)) * sqrt(l2 / a), 7) FROM e
        UNION ALL SELECT 'w', 2, round(abs(cos(th)) * sqrt(l2 / c), 7) FROM e""",
)
def _(spark, sf):
    model = fit_pca(_two(spark, sf), ["l_quantity", "w"], 2, scaling="center")
    return variable_correlations(spark, model).withColumn("r", F.round("r", 7))


@check("pca_fit")
def _(spark, sf):
    return explained_variance(spark, fit_pca(table(spark, sf, "lineitem"), FEATURES, 3))


@check("pca_wide_rows")
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    model = fit_pca(df, "embedding", 5, row_stage=RowStage(snv=True, sg_window=7, sg_order=2))
    return scoring.score(df, model, ["vec_id"])


# 5,000 columns of two kinds: the spectrum is 2,500 times that of two columns, and with one component
# kept the rest is one eigenvalue l2, of which the limit is (z √2 / 3 + 7 / 9)³ l2.
_WIDE = 5000


def _wide_sql(name: str, a: str, b: str) -> str:
    limits = ", ".join(f"round(l2 * pow({z} * sqrt(2) / 3 + 7 / 9.0, 3), 4) AS q_{p}" for p, z in ((95, 1.6448536269514722), (99, 2.3263478740408408)))
    return f"""SELECT '{name}' AS rows_of, n, round(l1, 4) AS l1, round(l1 / (l1 + l2), 9) AS ratio, {limits}, round(r, 7) AS r FROM (
      SELECT n, 2500 * ((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + c * c)) AS l1, 2500 * ((va + vb) / 2 - sqrt(pow((va - vb) / 2, 2) + c * c)) AS l2,
        sqrt((1 + (va - vb) / 2 / sqrt(pow((va - vb) / 2, 2) + c * c)) / 2) * sqrt(((va + vb) / 2 + sqrt(pow((va - vb) / 2, 2) + c * c)) / va) AS r
      FROM (SELECT count(*) AS n, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM (SELECT {a} AS a, {b} AS b FROM {name})))"""


def _two_kinds(spark, sf, name, a, b):
    """Rows of ``name`` as 5,000 variables, a and b in turn."""
    kinds = F.flatten(F.array_repeat(F.array(*["a", "b"] * 50), _WIDE // 100))
    tasks = max(16, 4 * spark.sparkContext.defaultParallelism)
    return table(spark, sf, name).select("*", F.expr(a).alias("a"), F.expr(b).alias("b")).repartition(tasks).withColumn("x", kinds)


_KINDS = {"customer": ("c_acctbal / 1000", "c_nationkey / 10.0 + c_acctbal / 5000"), "orders": ("o_totalprice / 100000", "o_custkey / 1000.0 + o_totalprice / 300000")}


@check("pca_wide_limits", " UNION ALL ".join(_wide_sql(n, *ab) for n, ab in _KINDS.items()))
def _(spark, sf):
    out = []
    for name, ab in _KINDS.items():
        model = fit_pca(_two_kinds(spark, sf, name, *ab), "x", 1, scaling="center")
        r = variable_correlations(spark, model).filter("variable = 'v0'").first()["r"]
        numbers = (float(model.eigenvalues[0]), float(model.ratio[0]), float(model.limits["q_95"]), float(model.limits["q_99"]), abs(float(r)))
        out.append((name, int(model.n), *[round(x, d) for x, d in zip(numbers, (4, 9, 4, 4, 7))]))
    return spark.createDataFrame(out, "rows_of string, n long, l1 double, ratio double, q_95 double, q_99 double, r double")


@check("pca_missing")
def _(spark, sf):
    x, y, nr = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(
        *KEY, x.alias("a"), F.when(nr % 5 != 0, x + 2000 * y).alias("b"), F.when(nr % 4 != 0, 300 * y).alias("c"), "l_tax"
    )
    model = gappy.fit_pca_missing(df, ["a", "b", "c", "l_tax"], 2, "center")
    return gappy.score_missing(df, model, KEY)


@check("model_overview")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return diagnostics.model_overview(fit_pca(df, FEATURES, 3), df)


# --- scores against groups and metadata ---------------------------------------------------------


@check(
    "ellipses",
    f"""WITH {_given_sql()}, g AS (SELECT l_returnflag AS grp, count(*) AS n, avg(pc1) AS x, avg(pc2) AS y, var_samp(pc1) AS a,
          covar_samp(pc1, pc2) AS b, var_samp(pc2) AS c FROM t GROUP BY 1),
        h AS (SELECT *, (a + c) / 2 AS m, sqrt(pow((a - c) / 2, 2) + b * b) AS d, 0.5 * atan2(2 * b, a - c) AS th FROM g)
        SELECT grp AS "group", n, round(x, 7) + 0.0 AS center_x, round(y, 7) + 0.0 AS center_y, round(sqrt(5.991 * (m + d)), 7) AS major,
          round(sqrt(5.991 * (m - d)), 7) AS minor, round(CASE WHEN th < 0 THEN th + pi() ELSE th END, 5) AS angle FROM h WHERE n >= 3""",
)
def _(spark, sf):
    scored = scoring.score(table(spark, sf, "lineitem"), given(), ["l_returnflag"])
    out = diagnostics.ellipses(scored, "l_returnflag", "pc1", "pc2", 0.95)
    return _r(_r(out, 7, "center_x", "center_y", "major", "minor"), 5, "angle")


def _meta(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("gap", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_suppkey").cast("double")))
    return scoring.score(df, given(), ["gap", "l_partkey", "l_returnflag"])


def _corr_rows(value):
    flags = [f"CASE WHEN l_returnflag = '{v}' THEN 1.0 ELSE 0.0 END" for v in "ANR"]
    meta = {"gap": "CASE WHEN l_linenumber % 3 <> 0 THEN l_suppkey END", "l_partkey": "l_partkey"}
    meta |= {f"l_returnflag_{v}": f for v, f in zip("ANR", flags)}
    return " UNION ALL ".join(
        value.format(name=name, pc=pc, y=y) for name, y in meta.items() for pc in ("pc1", "pc2")
    )


@check(
    "score_correlations_pearson",
    f"WITH {_given_sql()} "
    + _corr_rows("SELECT '{name}' AS variable, '{pc}' AS component, count({y}) AS n, round(corr({pc}, {y}), 7) + 0.0 AS r FROM t"),
)
def _(spark, sf):
    out = diagnostics.score_correlations(_meta(spark, sf), ["pc1", "pc2"], ["gap", "l_partkey"], ["l_returnflag"])
    return _r(out, 7, "r").select("variable", "component", "n", "r")


@check(
    "score_correlations_spearman",
    f"WITH {_given_sql()} "
    + _corr_rows(
        """SELECT '{name}' AS variable, '{pc}' AS component, count(*) AS n, round(corr(rx, ry), 7) + 0.0 AS r FROM
           (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                   rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
            FROM (SELECT {pc} AS x, {y} AS y FROM t) WHERE y IS NOT NULL)"""
    ),
)
def _(spark, sf):
    out = diagnostics.score_correlations(
        _meta(spark, sf), ["pc1", "pc2"], ["gap", "l_partkey"], ["l_returnflag"], "spearman"
    )
    return _r(out, 7, "r").select("variable", "component", "n", "r")


_LOAD = """ld AS (SELECT p_type AS variable, 1 AS component, round(avg(p_size) - 25, 9) AS loading FROM part GROUP BY 1
    UNION ALL SELECT p_type, 2, round(avg(p_retailprice) - 950, 9) FROM part GROUP BY 1)"""


def _loadings(spark, sf):
    p = table(spark, sf, "part").groupBy(F.col("p_type").alias("variable"))
    a = p.agg(F.lit(1).alias("component"), F.round(F.avg("p_size") - 25, 9).alias("loading"))
    return a.union(p.agg(F.lit(2).alias("component"), F.round(F.avg("p_retailprice") - 950, 9).alias("loading")))


@check(
    "most_influential",
    f"WITH {_LOAD} SELECT component, arg_min(variable, (-abs(loading), variable)) AS variable, max(abs(loading)) AS loading FROM ld GROUP BY 1",
)
def _(spark, sf):
    return diagnostics.most_influential(_loadings(spark, sf))


@check(
    "components_for_80",
    """WITH v AS (SELECT row_number() OVER (ORDER BY s DESC) AS k, s FROM (SELECT l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY 1)),
       c AS (SELECT k, sum(s) OVER (ORDER BY k) / (SELECT sum(s) FROM v) AS cum FROM v)
       SELECT coalesce(min(k) FILTER (cum >= 0.8), max(k)) AS components, round(coalesce(min(cum) FILTER (cum >= 0.8), max(cum)), 9) AS cumulative FROM c""",
)
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("s"))  # seven rows
    v = table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.sum("l_quantity").alias("s"))
    v = v.select(F.row_number().over(w).cast("long").alias("k"), (F.sum("s").over(w) / F.sum("s").over(Window.partitionBy(F.lit(0)))).alias("cumulative"))
    return diagnostics.components_for(v).withColumn("cumulative", F.round("cumulative", 9))


@check(
    "biplot_scale",
    f"""WITH {_given_sql()}, {_LOAD}, l AS (SELECT variable, max(loading) FILTER (component = 1) AS x, max(loading) FILTER (component = 2) AS y FROM ld GROUP BY 1),
        f AS (SELECT 0.7 * greatest(1.2 * (SELECT greatest(max(abs(pc1)), max(abs(pc2))) FROM t), 1) / max(sqrt(x * x + y * y)) AS f FROM l)
        SELECT variable, round(x * f, 7) + 0.0 AS x, round(y * f, 7) + 0.0 AS y FROM l, f""",
)
def _(spark, sf):
    wide = _loadings(spark, sf).groupBy("variable").agg(
        F.max(F.when(F.col("component") == 1, F.col("loading"))).alias("x"),
        F.max(F.when(F.col("component") == 2, F.col("loading"))).alias("y"),
    )
    return _r(diagnostics.biplot_scale(_scored(spark, sf), wide), 7, "x", "y")


# --- lagged windows -----------------------------------------------------------------------------

_LAG = """s AS (SELECT user_id, ts, event_id, (value - m) / d AS z FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events)),
  w AS (SELECT z AS x, lead(z) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM s),
  g AS (SELECT sum(x * x) / (count(*) - 1) AS a, sum(x * y) / (count(*) - 1) AS b, sum(y * y) / (count(*) - 1) AS c FROM w WHERE y IS NOT NULL),
  e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2,
    0.5 * atan2(2 * b, a - c) AS th FROM g)"""
_ORDER = ["ts", "event_id"]


def _lagged(spark, sf):
    return lagged.fit_lagged_pca(table(spark, sf, "events"), ["value"], 2, _ORDER, k=2, partition_by=["user_id"])


@check(
    "lagged_pca_two",
    f"WITH {_LAG} SELECT 'PC1' AS component, round(l1, 8) AS eigenvalue FROM e UNION ALL SELECT 'PC2', round(l2, 8) FROM e",
)
def _(spark, sf):
    out = explained_variance(spark, _lagged(spark, sf).pca)
    return out.select("component", F.round("eigenvalue", 8).alias("eigenvalue"))


@check(
    "lag_contribution",
    f"""WITH {_LAG} SELECT 1 AS component, 0 AS lag, round(pow(cos(th), 2), 7) AS share FROM e UNION ALL SELECT 1, 1, round(pow(sin(th), 2), 7) FROM e
        UNION ALL SELECT 2, 0, round(pow(sin(th), 2), 7) FROM e UNION ALL SELECT 2, 1, round(pow(cos(th), 2), 7) FROM e""",
)
def _(spark, sf):
    out = lagged.lag_contribution(lagged.lagged_loadings(spark, _lagged(spark, sf)))
    return out.withColumn("share", F.round("share", 7))


_LL = """ll AS (SELECT l_linenumber AS component, CAST(l_suppkey % 5 AS INTEGER) AS lag, l_returnflag AS variable, round(avg(l_discount) - 0.05, 9) AS loading
    FROM lineitem GROUP BY 1, 2, 3)"""


def _ll(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("component"), (F.col("l_suppkey") % 5).cast("int").alias("lag"), F.col("l_returnflag").alias("variable")
    ).agg(F.round(F.avg("l_discount") - 0.05, 9).alias("loading"))


@check(
    "variable_importance",
    f"WITH {_LL} SELECT component, variable, round(sqrt(avg(loading * loading)), 9) AS importance FROM ll GROUP BY 1, 2",
)
def _(spark, sf):
    return lagged.variable_importance(_ll(spark, sf)).withColumn("importance", F.round("importance", 9))


@check(
    "dominant_profile",
    f"""WITH {_LL}, i AS (SELECT component, variable, sqrt(avg(loading * loading)) AS imp FROM ll GROUP BY 1, 2),
        t AS (SELECT component, arg_min(variable, (-imp, variable)) AS variable FROM i GROUP BY 1)
        SELECT component, variable, lag, loading FROM ll JOIN t USING (component, variable)""",
)
def _(spark, sf):
    return lagged.dominant_profile(_ll(spark, sf))


@check("loading_at", f"WITH {_LL} SELECT * FROM ll WHERE variable = 'R' AND lag = 3 AND component = 2")
def _(spark, sf):
    return lagged.loading_at(_ll(spark, sf), "R", 3, 2)


@check("lagged_pca")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double"))
    model = lagged.fit_lagged_pca(df, ["value", "hour"], 8, _ORDER, target_variance=0.6, partition_by=["user_id"])
    return lagged.score_lagged(df, model, _ORDER, ["user_id"])


# --- kernels ----------------------------------------------------------------------------------------


@check(
    "kernel_matrix",
    """WITH x AS (SELECT c_nationkey AS i, avg(c_acctbal) / 1000 AS a, count(*) / 50.0 AS b FROM customer GROUP BY 1),
       k AS (SELECT p.i, q.i AS j, exp(-0.5 * (pow(p.a - q.a, 2) + pow(p.b - q.b, 2))) AS k FROM x p, x q),
       r AS (SELECT i, avg(k) AS m FROM k GROUP BY 1)
       SELECT k.i, k.j, round(k - r.m - c.m + (SELECT avg(k) FROM k), 8) + 0.0 AS value FROM k JOIN r ON r.i = k.i JOIN r c ON c.i = k.j""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("i")).agg(
        (F.avg("c_acctbal") / 1000).alias("a"), (F.count("*") / 50.0).alias("b")
    )
    return _r(kernel.kernel_matrix(df, ["a", "b"], None, "i"), 8, "value")


def _kernel(name, params):
    @check(name)
    def _(spark, sf):
        df = table(spark, sf, "embeddings")
        model = kernel.fit_kernel_pca(df, "embedding", 4, params, "vec_id", landmarks=2000)
        return kernel.score_kernel(df, model, ["vec_id"])


_kernel("kernel_pca_rbf", kernel.KernelParams("rbf"))
_kernel("kernel_pca_poly", kernel.KernelParams("poly", degree=2))
_kernel("kernel_pca_linear", kernel.KernelParams("linear"))
