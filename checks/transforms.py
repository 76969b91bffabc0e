"""Column transforms."""

from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import transforms as tr


def _r(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@check("log", "SELECT o_orderkey, round(ln(o_totalprice), 8) AS o_totalprice FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _r(tr.math_transform(df, "log", ["o_totalprice"]), 8, "o_totalprice")


@check("log_unchanged", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal")).alias("c_acctbal"))
    low = df.agg(F.min("c_acctbal")).first()[0]
    out = tr.math_transform(df.withColumn("c_acctbal", F.col("c_acctbal") - F.lit(low)), "log", ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round(F.col("c_acctbal") + F.lit(low), 2))


@check("sqrt_square", "SELECT p_partkey, round(sqrt(p_retailprice), 8) AS p_retailprice, p_size * p_size::DOUBLE AS p_size FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return _r(tr.math_transform(tr.math_transform(df, "sqrt", ["p_retailprice"]), "square", ["p_size"]), 8, "p_retailprice")


@check("strict_reciprocal", "SELECT p_partkey, round(1 / p_retailprice, 12) AS p_retailprice FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return _r(tr.strict_transform(df, "reciprocal", ["p_retailprice"]), 12, "p_retailprice")


@check(
    "standardise",
    """SELECT c_custkey, round((c_acctbal - m) / s, 7) + 0.0 AS c_acctbal FROM customer,
       (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)""",
)
def _(spark, sf):
    out = tr.standardise(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 7) + 0.0)


@check(
    "minmax",
    """SELECT p_partkey, round(-1 + 2 * (p_retailprice - a) / (b - a), 8) + 0.0 AS p_retailprice FROM part,
       (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part)""",
)
def _(spark, sf):
    out = tr.minmax(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], -1.0, 1.0)
    return out.withColumn("p_retailprice", F.round("p_retailprice", 8) + 0.0)


@check(
    "zscore_filter",
    """SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs((value - m) / s) <= 2.5""",
)
def _(spark, sf):
    return tr.zscore_filter(table(spark, sf, "events"), ["value"], 2.5).select("event_id")


@check(
    "equal_bins",
    """SELECT o_orderkey, 'Bin_' || CAST(least(floor((o_totalprice - a) / ((b - a) / 5)), 4) + 1 AS INTEGER) AS o_totalprice FROM orders,
       (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)""",
)
def _(spark, sf):
    return tr.equal_bins(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@check(
    "labelled_bins",
    """SELECT o_orderkey, CASE least(floor((o_totalprice - a) / ((b - a) / 3)), 2) WHEN 0 THEN 'Low' WHEN 1 THEN 'Mid' ELSE 'High' END AS o_totalprice
       FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return tr.equal_bins(df, ["o_totalprice"], labels=["Low", "Mid", "High"])


@check(
    "edge_bins",
    """SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 18.5 THEN 'small' WHEN p_size >= 18.5 AND p_size < 25 THEN 'middle'
       WHEN p_size >= 25 AND p_size < 40 THEN 'large' END AS size_class FROM part""",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size")
    return tr.edge_bins(df, "p_size", [1, 18.5, 25, 40], ["small", "middle", "large"], "size_class").drop("p_size")


@check(
    "one_hot",
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS c_mktsegment_{v}"
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer",
)
def _(spark, sf):
    return tr.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], drop=True)


@check(
    "ordinal",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END
       AS o_orderpriority_code FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return tr.ordinal(df, "o_orderpriority", ["5-LOW", "1-URGENT"], drop=True)


@check(
    "suggest_order",
    """WITH l AS (SELECT DISTINCT CASE WHEN o_orderpriority < '3' THEN 'High' WHEN o_orderpriority < '4' THEN 'Medium' ELSE 'Low' END AS v FROM orders)
       SELECT v, CAST(row_number() OVER (ORDER BY CASE v WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END) - 1 AS INTEGER) AS place FROM l""",
)
def _(spark, sf):
    p = F.col("o_orderpriority")
    df = table(spark, sf, "orders").select(F.when(p < "3", "High").when(p < "4", "Medium").otherwise("Low").alias("v"))
    return spark.createDataFrame(list(enumerate(tr.suggest_order(df, "v"))), "place int, v string")


@check(
    "label_order",
    """SELECT v, row_number() OVER (ORDER BY try_cast(v AS DOUBLE) NULLS LAST, v) AS place FROM
       (SELECT DISTINCT CAST(p_size AS VARCHAR) AS v FROM part UNION SELECT DISTINCT p_type FROM part)""",
)
def _(spark, sf):
    from eigenframe.operators.rows import number_rows

    p = table(spark, sf, "part")
    df = p.select(F.col("p_size").cast("string").alias("v")).union(p.select("p_type")).distinct()
    number, _text = tr.label_order("v")
    keyed = df.withColumn("x", F.col("v").try_cast("double")).withColumn("t", F.col("x").isNull())
    return number_rows(keyed, ["t", "x", "v"], name="place").select("v", "place")


@check(
    "split_column",
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority_1, split_part(o_orderpriority, '-', 2) AS o_orderpriority_2 FROM orders""",
)
def _(spark, sf):
    return tr.split_column(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", drop=True)


@check(
    "combine_columns",
    """SELECT p_partkey, coalesce(p_brand, '') || ' / ' || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS kind FROM part""",
)
def _(spark, sf):
    t = F.when(F.col("p_size") % 2 != 0, F.col("p_type"))
    df = table(spark, sf, "part").select("p_partkey", "p_brand", t.alias("p_type"))
    return tr.combine_columns(df, ["p_brand", "p_type"], " / ", "kind", drop=True)


_LOGS = "(ln(l_quantity) + ln(l_extendedprice) + ln(1 + l_tax)) / 3"
_ITEM = ["l_orderkey", "l_linenumber", "l_partkey"]


@check(
    "clr",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity) - {_LOGS}, 8) + 0.0 AS l_quantity_clr,
        round(ln(l_extendedprice) - {_LOGS}, 8) + 0.0 AS l_extendedprice_clr, round(ln(1 + l_tax) - {_LOGS}, 8) + 0.0 AS tax_clr FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_ITEM, "l_quantity", "l_extendedprice", (1 + F.col("l_tax")).alias("tax"))
    out = tr.clr(df, ["l_quantity", "l_extendedprice", "tax"], drop=True)
    return out.withColumns({c: F.round(c, 8) + 0.0 for c in out.columns if c.endswith("_clr")})


_Z = "((l_discount = 0)::INT + (l_tax = 0)::INT)"


@check(
    "zero_replacement",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS raw, round(l_quantity * k, 9) AS l_quantity,
        round(CASE WHEN l_discount = 0 THEN 0.001 ELSE l_discount * k END, 9) AS l_discount,
        round(CASE WHEN l_tax = 0 THEN 0.001 ELSE l_tax * k END, 9) AS l_tax
        FROM (SELECT *, 1 - 0.001 * {_Z} / (l_quantity + l_discount + l_tax) AS k FROM lineitem)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*_ITEM, F.col("l_quantity").alias("raw"), "l_quantity", "l_discount", "l_tax")
    return _r(tr.replace_zeros(df, ["l_quantity", "l_discount", "l_tax"], 0.001), 9, "l_quantity", "l_discount", "l_tax")


@check(
    "closure",
    """SELECT round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum, round(avg(s), 6) AS mean_sum,
       avg(s) > 0 AND (max(s) - min(s)) / avg(s) < 0.01 AS closed FROM (SELECT l_quantity + l_discount AS s FROM lineitem)""",
)
def _(spark, sf):
    return _r(tr.closure(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), 6, "min_sum", "max_sum", "mean_sum")


@check("box_cox", "SELECT o_orderkey, round((pow(o_totalprice, 0.3) - 1) / 0.3, 6) AS o_totalprice FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return _r(tr.power_transform(df, "box-cox", ["o_totalprice"], 0.3), 6, "o_totalprice")


@check(
    "yeo_johnson",
    """SELECT c_custkey, round(CASE WHEN x >= 0 THEN (pow(x + 1, 0.4) - 1) / 0.4 ELSE -(pow(1 - x, 1.6) - 1) / 1.6 END, 5) + 0.0 AS x
       FROM (SELECT c_custkey, c_acctbal / 100 - 20 AS x FROM customer)""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100 - 20).alias("x"))
    return tr.power_transform(df, "yeo-johnson", ["x"], 0.4).withColumn("x", F.round("x", 5) + 0.0)


@check("lambda_ml")
def _(spark, sf):
    df = table(spark, sf, "events").select("value")
    rows = [(k, tr.best_lambda(df, "value", k)) for k in ("box-cox", "yeo-johnson")]
    return spark.createDataFrame(rows, "kind string, lambda double")


@check(
    "month_first",
    """SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders""",
)
def _(spark, sf):
    word = F.date_format("o_orderdate", "MMMM yyyy")
    df = table(spark, sf, "orders").select("o_orderkey", word.alias("w"))
    return df.select("o_orderkey", F.date_format(tr.month_first(F.col("w")), "yyyy-MM-dd").alias("month"))
