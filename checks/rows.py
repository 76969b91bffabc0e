"""Choosing, ordering, reshaping and joining rows."""

from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.functions.parsing import to_number
from eigenframe.operators import joins, rows, scoring


@check("filter_numeric", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 250000")
def _(spark, sf):
    return rows.filter_rows(table(spark, sf, "orders"), "o_totalprice", ">=", 250000).select("o_orderkey", "o_custkey")


@check("filter_text", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def _(spark, sf):
    return rows.filter_rows(table(spark, sf, "customer"), "c_mktsegment", "equals", "Building").select("c_custkey")


@check("filter_contains_remove", "SELECT o_orderkey FROM orders WHERE NOT contains(lower(o_orderpriority), 'not')")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return rows.filter_rows(df, "o_orderpriority", "contains", "NOT", mode="remove").select("o_orderkey")


@check("filter_number_in_text", "SELECT o_orderkey FROM orders WHERE CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) > 3")
def _(spark, sf):
    lead = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    df = table(spark, sf, "orders").select("o_orderkey", lead.alias("lead"))
    return rows.filter_rows(df, "lead", ">", "3").select("o_orderkey")


@check("filter_empty", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber % 7 = 0")
def _(spark, sf):
    gap = F.when(F.col("l_linenumber") % 7 == 0, None).otherwise(F.col("l_discount"))
    df = table(spark, sf, "lineitem").withColumn("d", gap)
    return rows.filter_rows(df, "d", "is_empty").select("l_orderkey", "l_partkey", "l_suppkey")


@check(
    "filter_preview",
    """SELECT count(*) FILTER (l_discount <= 0.03) AS matched, count(*) AS total,
              count(*) FILTER (l_discount > 0.03) AS remaining FROM lineitem""",
)
def _(spark, sf):
    return rows.filter_preview(table(spark, sf, "lineitem"), "l_discount", "<=", 0.03, mode="remove")


@check(
    "exclude_range",
    """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
       WHERE r NOT IN (1, 7) AND NOT r BETWEEN 20 AND 900""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return rows.exclude_rows(df, "1,7,20-900", ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@check("exclude_columns", "SELECT c_custkey, c_acctbal FROM customer")
def _(spark, sf):
    return rows.exclude_columns(table(spark, sf, "customer"), "2-3,5")


@check(
    "delete_rows",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return rows.delete_rows(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ids, "c_custkey")


@check(
    "reorder_rename_insert",
    "SELECT CAST(NULL AS VARCHAR) AS note, n_name AS country, n_nationkey FROM nation",
)
def _(spark, sf):
    from eigenframe.roles import Roles

    df = table(spark, sf, "nation").drop("n_regionkey")
    df, _roles = rows.rename_column(df, Roles.from_schema(df.schema), "n_name", "country")
    return rows.reorder(rows.insert_column(df, "note", 0), ["note", "country", "n_nationkey"])


@check(
    "recombine",
    "SELECT p_partkey, p_brand, p_size, p_retailprice, p_type, p_name FROM part",
)
def _(spark, sf):
    from eigenframe.roles import Roles

    df = table(spark, sf, "part")
    roles = Roles.from_schema(df.schema, "p_partkey", targets=["p_retailprice"])
    return rows.recombine(df.select(*sorted(df.columns)), roles)


@check(
    "sort_mixed",
    r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 11 = 0 THEN ''
                ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders)
       SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS DOUBLE) END
              NULLS LAST, v, o_orderkey) AS place FROM t""",
)
def _(spark, sf):
    v = (
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 11 == 0, F.lit(""))
        .otherwise(F.col("o_custkey").cast("string"))
    )
    df = table(spark, sf, "orders").select("o_orderkey", v.alias("v"))
    number, text = rows.sort_keys("v")
    keyed = df.select("o_orderkey", to_number(F.col("v")).isNull().alias("is_text"), to_number(F.col("v")).alias("x"), text.alias("t"))
    placed = rows.number_rows(keyed, ["is_text", "x", "t", "o_orderkey"], name="place")
    return placed.select("o_orderkey", "place")


@check("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rows.head(df, [F.desc("o_totalprice"), "o_orderkey"], 25)


@check(
    "check_key",
    """SELECT count(*) - count(DISTINCT p_name) AS repeated, 0 AS blank, count(*) = count(DISTINCT p_name) AS usable FROM part""",
)
def _(spark, sf):
    return rows.check_key(table(spark, sf, "part"), "p_name").select(
        F.col("repeated").cast("long"), F.col("blank").cast("int"), "usable"
    )


@check(
    "number_rows",
    "SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1) AS nr FROM customer",
)
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rows.number_rows(df, ["c_acctbal", "c_custkey"], 100, 5, "nr").select("c_custkey", "nr")


@check(
    "sample_ids",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS \"Sample_ID\" FROM events",
)
def _(spark, sf):
    return rows.number_rows(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select(
        "event_id", "Sample_ID"
    )


@check(
    "transpose_long",
    """SELECT s_suppkey, 'balance' AS variable, s_acctbal AS value FROM supplier
       UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
def _(spark, sf):
    df = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return rows.transpose_long(df, "s_suppkey", ["balance", "nation"]).withColumn("value", F.col("value").cast("double"))


@check(
    "transpose_wide",
    """WITH v AS (SELECT r_name, round(avg(o_totalprice), 4) AS v FROM orders
         JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
         GROUP BY r_name)
       SELECT 'avg_price' AS variable, """
    + ", ".join(f"max(v) FILTER (r_name = '{r}') AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    + " FROM v",
)
def _(spark, sf):
    t = lambda n: table(spark, sf, n)
    per = (
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name")
        .agg(F.round(F.avg("o_totalprice"), 4).alias("avg_price"))
    )
    return rows.transpose(per, "r_name", ["avg_price"], ["r_name"])


@check(
    "farthest_points",
    """SELECT l_quantity, l_discount, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 8) AS distance
       FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem)
       ORDER BY sqrt(l_quantity * l_quantity + l_discount * l_discount) DESC, l_quantity, l_discount LIMIT 20""",
)
def _(spark, sf):
    return scoring.farthest(table(spark, sf, "lineitem"), "l_quantity", "l_discount", 20).withColumn(
        "distance", F.round("distance", 8)
    )


@check("inner_join", "SELECT o_orderkey, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "c_name", "c_acctbal")
    )


@check(
    "positional_join",
    """SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer)
       JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) USING (i)""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    b = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return joins.positional_join(a, b, ["c_acctbal", "c_custkey"], ["o_totalprice", "o_orderkey"]).select(
        "c_custkey", "o_orderkey"
    )


@check(
    "align_dates",
    """SELECT strftime(d, '%Y-%m-%d') AS d, n, round(factor, 7) AS factor FROM
         (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
         LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice) AS factor FROM lineitem
                    GROUP BY 1) USING (d)""",
)
def _(spark, sf):
    dates = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    factor = (
        table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("d"))
        .agg(F.avg("l_extendedprice").alias("factor"))
    )
    return joins.align_left(dates, factor, "d").select(
        F.date_format("d", "yyyy-MM-dd").alias("d"), "n", F.round("factor", 7).alias("factor")
    )


_PERIODS = """SELECT n_nationkey AS p, DATE '1994-01-01' + CAST(n_nationkey * 97 AS INTEGER) AS a,
    CASE WHEN n_nationkey % 9 = 8 THEN NULL ELSE DATE '1994-01-01' + CAST(n_nationkey * 97 + 60 + n_nationkey * 3 AS INTEGER) END AS b
    FROM nation"""


@check(
    "interval_join",
    f"""WITH p AS ({_PERIODS})
       SELECT o_orderkey, p FROM orders LEFT JOIN LATERAL (SELECT p FROM p WHERE o_orderdate >= a AND (b IS NULL OR o_orderdate < b)
         ORDER BY p LIMIT 1) ON true""",
)
def _(spark, sf):
    key = F.col("n_nationkey")
    base = F.lit("1994-01-01").cast("date")
    periods = table(spark, sf, "nation").select(
        key.alias("p"),
        F.date_add(base, key * 97).alias("a"),
        F.when(key % 9 != 8, F.date_add(base, key * 100 + 60)).alias("b"),
    )
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return joins.interval_join(df, "o_orderdate", periods, "a", "b", ["p"]).select("o_orderkey", "p")


# As many periods as line items, most of a few weeks, some of them open; each order in the first that holds its date.
@check(
    "interval_join_many",
    """WITH p AS (SELECT l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber AS p, l_shipdate AS a, CASE WHEN l_partkey % 397 <> 0 THEN l_shipdate + CAST(l_quantity AS INTEGER) * INTERVAL 1 DAY END AS b
         FROM lineitem)
       SELECT o_orderkey, min(p) AS p FROM orders LEFT JOIN p ON o_orderdate >= a AND (b IS NULL OR o_orderdate < b) GROUP BY o_orderkey""",
)
def _(spark, sf):
    number = (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("p")
    ends = [F.col("l_shipdate").alias("a"), F.when(F.col("l_partkey") % 397 != 0, F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))")).alias("b")]
    periods = table(spark, sf, "lineitem").select(number, *ends)
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = joins.interval_join(df, "o_orderdate", periods, "a", "b", ["p"])
    return out.select("o_orderkey", "p")


@check("anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark, sf):
    other = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.rows_without(table(spark, sf, "customer").select("c_custkey"), other, "c_custkey")
