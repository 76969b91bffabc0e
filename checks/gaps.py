"""Inputs with gaps, late text and blank beginnings: results must not depend on where they stand or on the model's size."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.models import FEATURES, KEY, _given_sql, _r, given
from checks.registry import check, table
from eigenframe.operators import kernel, scoring
from eigenframe.operators import profile as prof
from eigenframe.plans.durable import scratch_path
from eigenframe.sources import tables


@check(
    "roles_late_text",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 49 THEN o_orderpriority WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS late FROM orders",
)
def _(spark, sf):
    number = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string"))
    late = F.when(F.col("o_orderkey") % 50 == 49, F.col("o_orderpriority")).otherwise(number)
    path = scratch_path(spark, "late")
    tables.write_table(table(spark, sf, "orders").select("o_orderkey", late.alias("late")), path)
    back, roles = tables.read_table(spark, path, id_col="o_orderkey")
    assert roles.categorical == ("late",)
    text = F.when(F.col("late") != tables.NA_TOKENS[0], F.col("late"))
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), text.alias("late"))


_GAPS = f"""WITH g AS (SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity)
    FROM lineitem), {_given_sql().replace('FROM lineitem', 'FROM g')}
    SELECT {', '.join(KEY)}, round(pc1, 7) + 0.0 AS pc1, round(q, 7) + 0.0 AS q, outside FROM o"""


def _gappy(spark, sf):
    key = F.col("l_orderkey")
    holed = F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, float("nan")).when(key % 13 == 0, float("inf"))
    return table(spark, sf, "lineitem").withColumn("l_quantity", holed.otherwise(F.col("l_quantity").cast("double")))


@check("score_with_gaps_columns", _GAPS)
def _(spark, sf):
    out = scoring.with_outside(scoring.score(_gappy(spark, sf), given(), KEY), given())
    return _r(out, 7, "pc1", "q").select(*KEY, "pc1", "q", "outside")


@check("score_with_gaps_array", _GAPS)
def _(spark, sf):
    row = F.array(*[F.col(c).cast("double") for c in FEATURES])
    whole = _gappy(spark, sf).withColumn("x", F.when(F.col("l_orderkey") % 13 != 0, row))
    model = replace(given(), features=("x",), regression=None)
    out = scoring.with_outside(scoring.score(whole, model, KEY), model)
    return _r(out, 7, "pc1", "q").select(*KEY, "pc1", "q", "outside")


# Values far from zero, after a blank beginning that a look at the first rows would take for the centre.
_FAR = {f"x{i}": f"{10.0 ** (i + 2)} + {c} * {i + 1} + l_quantity * {i % 3}" for i, c in enumerate(["l_discount", "l_tax", "l_quantity", "l_discount", "l_tax"])}


def _blank_head(n):
    cols = list(_FAR)[:n]
    sql = ", ".join(f"CASE WHEN l_orderkey > 700 THEN {_FAR[c]} END AS {c}" for c in cols)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 5) + 0.0 AS r FROM t" for i, a in enumerate(cols) for b in cols[i + 1 :])

    @check(f"correlations_blank_head_{n}", f"WITH t AS (SELECT {sql} FROM lineitem) SELECT * FROM ({pairs})")
    def _(spark, sf):
        df = table(spark, sf, "lineitem").select(*[F.when(F.col("l_orderkey") > 700, F.expr(_FAR[c])).alias(c) for c in cols])
        return prof.correlations(df, cols).withColumn("r", F.round("r", 5) + 0.0)


_blank_head(4)
_blank_head(5)


@check(
    "duplicates_null_order",
    """SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY n_regionkey ORDER BY k NULLS FIRST) AS r FROM
       (SELECT n_regionkey, CASE WHEN n_nationkey <> 3 THEN n_nationkey END AS k FROM nation)) WHERE r > 1""",
)
def _(spark, sf):
    k = F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("k")
    return prof.duplicate_rows(table(spark, sf, "nation").select("n_regionkey", k), ["n_regionkey"], ["k"])


@check(
    "kernel_two_points",
    """WITH c AS (SELECT count(*) FILTER (c_nationkey < 10) AS a, count(*) FILTER (c_nationkey >= 10) AS b FROM customer)
       SELECT round(sqrt(CAST(a AS DOUBLE) * b / (a + b) * (2 - 2 * exp(-0.5 * 5))) / 1000, 6) AS size, CAST(1 AS DOUBLE) AS share FROM c""",
)
def _(spark, sf):
    far = F.col("c_nationkey") >= 10
    df = table(spark, sf, "customer").select("c_custkey", F.array(F.when(far, 1.0).otherwise(0.0), F.when(far, 2.0).otherwise(0.0)).alias("x"))
    model = kernel.fit_kernel_pca(df, "x", 1, kernel.KernelParams("rbf", 0.5), "c_custkey", landmarks=200)
    scores = kernel.score_kernel(df, model, ["c_custkey"])
    size = F.round(F.sqrt(F.sum(F.col("pc1") * F.col("pc1"))) / 1000, 6).alias("size")
    return scores.agg(size, F.round(F.lit(float(model.ratio[0])), 6).alias("share"))
