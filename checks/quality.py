"""Types, profiles, missing cells, outliers, duplicates, correlations, reports."""

from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import profile as prof
from eigenframe.operators import quality
from eigenframe.roles import Roles

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat", "spike", "twin"]
TXT = ["l_returnflag", "l_linestatus"]

# One table with gaps, a constant, a magnitude slip and a near copy, built the same way on both sides.
_ITEMS = """items AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_linenumber <= 4 THEN NULL ELSE l_tax END AS l_tax,
  3.0::DOUBLE AS flat,
  CASE WHEN l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem) THEN 9e6 ELSE l_quantity END AS spike,
  l_quantity * 2 + l_discount AS twin,
  l_returnflag, CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE l_linestatus END AS l_linestatus FROM lineitem)"""


def items(spark, sf):
    df = table(spark, sf, "lineitem")
    top = df.agg(F.max("l_extendedprice").alias("top"))
    nr = F.col("l_linenumber")
    return df.join(F.broadcast(top), F.col("l_extendedprice") == F.col("top"), "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
        F.when(nr % 5 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(nr > 4, F.col("l_tax")).alias("l_tax"),
        F.lit(3.0).alias("flat"),
        F.when(F.col("top").isNotNull(), 9e6).otherwise(F.col("l_quantity")).alias("spike"),
        (F.col("l_quantity") * 2 + F.col("l_discount")).alias("twin"),
        "l_returnflag", F.when(nr % 6 != 0, F.col("l_linestatus")).alias("l_linestatus"),
    )


def _each(cols, body, source="items"):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM {source}" for c in cols)


def _type(c, source):
    text = f"trim(CAST({c} AS VARCHAR))"
    return f"""SELECT '{c}' AS "column", CASE WHEN count(v) = 0 THEN 'empty'
      WHEN count(v) FILTER (regexp_matches(v, '^[+-]?(([0-9]+(\\.[0-9]*)?)|(\\.[0-9]+))([eE][+-]?[0-9]+)?$')) > 0.9 * count(v) THEN 'numeric'
      WHEN count(DISTINCT v) < 0.2 * count(v) OR count(DISTINCT v) < 20 THEN 'categorical' ELSE 'text' END AS type
      FROM (SELECT nullif({text}, '') AS v FROM {source})"""


@check(
    "column_types",
    " UNION ALL ".join(_type(c, "documents") for c in ("doc_id", "text", "lang", "source", "n_chars")),
)
def _(spark, sf):
    return prof.column_types(table(spark, sf, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@check(
    "classify_new",
    """SELECT 'lead' AS "column", 'numeric' AS type FROM orders
       HAVING count(*) FILTER (NOT regexp_matches(split_part(o_orderpriority, '-', 1), '^[0-9]+$')) = 0""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("lead"))
    return prof.classify_new(df, "lead")


@check(
    "missing_report",
    f"WITH {_ITEMS} " + _each(NUM + TXT, "count(*) - count({c}) AS missing, count(*) AS rows, round(100.0 * (count(*) - count({c})) / count(*), 6) AS percent"),
)
def _(spark, sf):
    return prof.missing_report(items(spark, sf), NUM + TXT).withColumn("percent", F.round("percent", 6))


_M = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in NUM + TXT)


@check(
    "missing_summary",
    f"""WITH {_ITEMS} SELECT count(*) * {len(NUM + TXT)} AS cells, CAST(sum(m) AS BIGINT) AS missing, count(*) FILTER (m > 0) AS rows_with_gaps,
        round(100.0 * sum(m) / (count(*) * {len(NUM + TXT)}), 6) AS percent FROM (SELECT {_M} AS m FROM items)""",
)
def _(spark, sf):
    return prof.missing_summary(items(spark, sf), NUM + TXT).withColumn("percent", F.round("percent", 6))


@check("missing_by_row", f"WITH {_ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, {_M} AS missing FROM items")
def _(spark, sf):
    return prof.missing_by_row(items(spark, sf), NUM + TXT, ["l_orderkey", "l_linenumber", "l_partkey"])


@check(
    "missing_tokens",
    """SELECT role AS "column", count(*) FILTER (lower(trim(v)) IN ('', 'na', 'n/a', 'nan', 'null', 'm', '-', '?', 'none', 'missing')) AS missing
       FROM (SELECT role, CASE turn % 4 WHEN 0 THEN 'NA' WHEN 1 THEN ' ? ' WHEN 2 THEN 'Missing' ELSE role END AS v FROM conversations) GROUP BY role""",
)
def _(spark, sf):
    turn = F.col("turn") % 4
    df = table(spark, sf, "conversations").select(
        "role", F.when(turn == 0, "NA").when(turn == 1, " ? ").when(turn == 2, "Missing").otherwise(F.col("role")).alias("v")
    )
    return prof.missing_by_row(df, ["v"], ["role"]).groupBy(F.col("role").alias("column")).agg(F.sum("missing").alias("missing"))


def _pattern(c):
    return f"""SELECT '{c}' AS "column", CASE WHEN count(p) = 0 THEN 'none' WHEN max(p) = count(p) - 1 THEN 'top'
      WHEN min(p) = max(n) - count(p) THEN 'bottom' WHEN count(p) > 2 AND min(g) = max(g) AND min(g) > 1 THEN 'systematic' ELSE 'random' END AS pattern
      FROM (SELECT p, n, p - lag(p) OVER (ORDER BY p) AS g FROM (SELECT CASE WHEN {c} THEN pos END AS p, n FROM f) WHERE p IS NOT NULL
            UNION ALL SELECT NULL, max(n), NULL FROM f)"""


@check(
    "missing_pattern",
    """WITH f AS (SELECT r - 1 AS pos, n, false AS a, r <= 40 AS b, r > n - 30 AS c, r % 13 = 5 AS d, o_custkey % 10 = 0 AS e
         FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)) """
    + " UNION ALL ".join(_pattern(c) for c in "abcde"),
)
def _(spark, sf):
    from eigenframe.plans.ranges import dense_index

    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    n = F.lit(df.count())
    r = F.col("r") + 1
    df = dense_index(df, ["o_orderdate", "o_orderkey"], name="r")
    hole = lambda c: F.when(~c, 1.0)
    df = df.select(
        "o_orderdate", "o_orderkey", F.lit(1.0).alias("a"), hole(r <= 40).alias("b"), hole(r > n - 30).alias("c"),
        hole(r % 13 == 5).alias("d"), hole(F.col("o_custkey") % 10 == 0).alias("e"),
    )
    return prof.missing_pattern(df, list("abcde"), ["o_orderdate", "o_orderkey"])


def _profile_sql(c):
    return f"""SELECT '{c}' AS "column", 'numeric' AS type, n AS rows, n - k AS missing, u AS "unique", mean, md AS median, sd, mn AS min, mx AS max,
      q1, q3, q3 - q1 AS iqr,
      CASE WHEN k < 3 OR sd = 0 THEN 0 ELSE (m3 / pow(sd, 3)) * k * k / ((k - 1.0) * (k - 2.0)) END AS skewness,
      CASE WHEN k < 4 OR sd = 0 THEN 0 ELSE k * k * (k + 1.0) * (m4 / pow(sd, 4)) / ((k - 1.0) * (k - 2.0) * (k - 3.0))
        - 3 * (k - 1.0) * (k - 1.0) / ((k - 2.0) * (k - 3.0)) END AS kurtosis,
      NULL AS mode, 100.0 * (n - k) / n AS missing_pct
      FROM (SELECT count(*) AS n, count({c})::DOUBLE AS k, count(DISTINCT {c}) AS u, max(a) AS mean, max(s) AS sd, min({c}) AS mn, max({c}) AS mx,
        median({c}) AS md, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3,
        avg(pow({c} - a, 3)) AS m3, avg(pow({c} - a, 4)) AS m4
        FROM items, (SELECT avg({c}) AS a, stddev_pop({c}) AS s FROM items))"""


_NUMERIC = " UNION ALL ".join(_profile_sql(c) for c in NUM)
_DIGITS = {"mean": 4, "median": 5, "sd": 4, "q1": 5, "q3": 5, "iqr": 5, "skewness": 4, "kurtosis": 2}


@check(
    "numeric_profile",
    f"""WITH {_ITEMS}, p AS ({_NUMERIC}) SELECT "column", CAST(rows AS BIGINT) AS rows, CAST(missing AS BIGINT) AS missing, "unique", min, max, """
    + ", ".join(f"round({c}, {d}) AS {c}" for c, d in _DIGITS.items())
    + " FROM p",
)
def _(spark, sf):
    return prof.numeric_profile(items(spark, sf), NUM).withColumns({c: F.round(c, d) for c, d in _DIGITS.items()})


def _cat_sql(c):
    return f"""SELECT '{c}' AS "column", (SELECT count(*) FROM items) AS rows, (SELECT count(*) - count({c}) FROM items) AS missing,
      count(*) AS "unique", arg_min(v, (-n, v)) AS mode, max(n) AS mode_count
      FROM (SELECT {c} AS v, count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY 1)"""


_CATEGORICAL = " UNION ALL ".join(_cat_sql(c) for c in TXT)


@check("categorical_profile", f"WITH {_ITEMS} {_CATEGORICAL}")
def _(spark, sf):
    return prof.categorical_profile(items(spark, sf), TXT)


def _hist_sql(c):
    return f"""SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n
      FROM items, (SELECT min({c}) AS lo, max({c}) AS hi FROM items) WHERE {c} IS NOT NULL AND hi > lo GROUP BY 1, 2"""


_HIST = " UNION ALL ".join(_hist_sql(c) for c in NUM)


@check("histogram", f"WITH {_ITEMS} {_HIST}")
def _(spark, sf):
    return prof.histogram(items(spark, sf), NUM)


_SHAPE = f"""h AS (SELECT c."column", b.range AS bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT "column" FROM ({_HIST})) c
      CROSS JOIN range(10) b LEFT JOIN ({_HIST}) g ON g."column" = c."column" AND g.bin = b.range),
    peaks AS (SELECT "column", count(*) FILTER (bin BETWEEN 1 AND 8 AND n > a AND n > z) AS peaks FROM
      (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS z FROM h WINDOW w AS (PARTITION BY "column" ORDER BY bin)) GROUP BY 1),
    shape AS (SELECT p.*, CASE WHEN rows - missing < 10 THEN NULL WHEN abs(skewness) < 0.5 AND abs(kurtosis) < 1 THEN 'normal'
      WHEN skewness > 1 THEN 'right-skewed' WHEN skewness < -1 THEN 'left-skewed' WHEN peaks IS NULL THEN NULL
      WHEN peaks >= 2 THEN 'bimodal' ELSE 'unknown' END AS dist_type FROM ({_NUMERIC}) p LEFT JOIN peaks USING ("column"))"""


@check("distribution", f'WITH {_ITEMS}, {_SHAPE} SELECT "column", dist_type FROM shape')
def _(spark, sf):
    return prof.distribution(items(spark, sf), NUM)


def _jump_sql(c):
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, '{c}' AS "column", {c} AS value FROM items,
      (SELECT max(v) AS hi, max(v) FILTER (r2 = 2) AS h2, min(v) AS lo, max(v) FILTER (r1 = 2) AS l2, max(k) AS k FROM
        (SELECT v, row_number() OVER (ORDER BY v) AS r1, row_number() OVER (ORDER BY v DESC) AS r2, sum(n) OVER () AS k
         FROM (SELECT {c} AS v, count(*) AS n FROM items WHERE {c} IS NOT NULL GROUP BY 1)))
      WHERE k >= 4 AND (({c} = hi AND h2 <> 0 AND abs(hi) >= 100 * abs(h2)) OR ({c} = lo AND l2 <> 0 AND abs(lo) >= 100 * abs(l2)))"""


_JUMPS = " UNION ALL ".join(_jump_sql(c) for c in NUM)


@check("outliers", f"WITH {_ITEMS} {_JUMPS}")
def _(spark, sf):
    return prof.outliers(items(spark, sf), NUM, ["l_orderkey", "l_linenumber", "l_partkey"])


_REPORTABLE = f"""jumps AS (SELECT "column", count(*) AS outliers FROM ({_JUMPS}) GROUP BY 1),
    rep AS (SELECT "column", outliers, outliers * 100.0 <= (SELECT count(*) FROM items) OR outliers <= 3 AS reportable FROM jumps)"""


@check("reportable_outliers", f"WITH {_ITEMS}, {_REPORTABLE} SELECT * FROM rep")
def _(spark, sf):
    return prof.outlier_counts(items(spark, sf), NUM)


_SPARSE_COLS = ["c_acctbal", "c_mktsegment", "c_nationkey", "c_name", "extra"]
_CUST = """cust AS (SELECT c_custkey, c_name,
    CASE WHEN c_custkey % 50 IN (1, 2) THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 50 IN (1, 2) THEN '' ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE c_nationkey END AS c_nationkey,
    CASE WHEN c_custkey % 3 = 0 OR c_custkey % 50 = 2 THEN 'n/a' ELSE 'x' END AS extra FROM customer)"""


def _cust(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name",
        F.when(~(k % 50).isin(1, 2), F.col("c_acctbal")).alias("c_acctbal"),
        F.when((k % 50).isin(1, 2), "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 50 != 1, F.col("c_nationkey")).alias("c_nationkey"),
        F.when((k % 3 == 0) | (k % 50 == 2), "n/a").otherwise("x").alias("extra"),
    )


@check(
    "sparse_rows",
    f"""WITH {_CUST}, f AS (SELECT c_custkey, CAST((c_acctbal IS NOT NULL) AS INTEGER) + CAST(c_mktsegment <> '' AS INTEGER)
          + CAST((c_nationkey IS NOT NULL) AS INTEGER) + 1 + CAST(extra <> 'n/a' AS INTEGER) AS filled FROM cust),
        m AS (SELECT filled AS mid FROM (SELECT filled, row_number() OVER (ORDER BY filled) AS r, count(*) OVER () AS n FROM f) WHERE r = n // 2 + 1)
        SELECT c_custkey, filled FROM f, m WHERE filled = 0 OR 2 * filled < mid""",
)
def _(spark, sf):
    return prof.sparse_rows(_cust(spark, sf), _SPARSE_COLS, ["c_custkey"])


@check(
    "duplicate_rows",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text, lang, source ORDER BY doc_id) AS r FROM documents) WHERE r > 1""",
)
def _(spark, sf):
    return prof.duplicate_rows(table(spark, sf, "documents"), ["text", "lang", "source"], ["doc_id"])


@check(
    "duplicate_count",
    "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)",
)
def _(spark, sf):
    return prof.duplicate_count(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_returnflag"])


def _corr_sql(cols):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS x, '{b}' AS y, coalesce(CASE WHEN count(*) < 2 OR var_pop({a}) = 0 OR var_pop({b}) = 0 THEN 0.0 ELSE corr({a}, {b}) END, 0.0) AS r
            FROM items WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    )


@check("correlations", f"WITH {_ITEMS} SELECT x, y, round(r, 7) + 0.0 AS r FROM ({_corr_sql(NUM)})")
def _(spark, sf):
    return prof.correlations(items(spark, sf), NUM).withColumn("r", F.round("r", 7) + 0.0)


@check(
    "correlations_wide",
    """WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
       g AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 9 = 0 THEN NULL ELSE v END AS v FROM e)
       SELECT 'f' || (a.i - 1) AS x, 'f' || (b.i - 1) AS y, round(corr(a.v, b.v), 7) + 0.0 AS r
       FROM g a JOIN g b ON a.vec_id = b.vec_id AND a.i < b.i WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    m = df.agg(F.max(F.size("embedding")).alias("m")).first()["m"]
    cols = [
        F.when((F.col("vec_id") + i + 1) % 9 != 0, F.element_at("embedding", i + 1).cast("double")).alias(f"f{i}")
        for i in range(m)
    ]
    return prof.correlations(df.select(*cols), [f"f{i}" for i in range(m)]).withColumn("r", F.round("r", 7) + 0.0)


_ROLES = Roles(tuple(NUM), tuple(TXT), (), None, None, tuple(NUM + TXT))
_ALL = ", ".join(NUM + TXT)
_FILLED = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in NUM + TXT)
_REPORT = f"""WITH {_ITEMS}, {_SHAPE}, {_REPORTABLE},
  prof AS (SELECT "column", type, rows, missing, missing_pct, "unique", mean, sd, min, max, skewness, dist_type,
      coalesce((SELECT outliers FROM rep WHERE reportable AND rep."column" = shape."column"), 0) AS outliers FROM shape
    UNION ALL SELECT "column", 'categorical', rows, missing, 100.0 * missing / rows, "unique", NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM ({_CATEGORICAL})),
  fl AS (SELECT *, rows > missing AND CASE WHEN type = 'numeric' THEN min = max ELSE "unique" = 1 END AS constant FROM prof),
  pr AS (SELECT *, type = 'numeric' AND NOT constant AND abs(mean) > 0 AND sd < 0.001 * abs(mean) AS near FROM fl),
  f AS (SELECT {_FILLED} AS filled FROM items),
  t AS (SELECT 100.0 * (SELECT sum(missing) FROM prof) / (SELECT sum(rows) FROM prof) AS pct, (SELECT count(*) FROM items) AS n,
     (SELECT sum(c - 1) FROM (SELECT count(*) AS c FROM items GROUP BY {_ALL})) AS dup,
     (SELECT count(*) FROM f WHERE filled = 0 OR 2 * filled < (SELECT filled FROM (SELECT filled, row_number() OVER (ORDER BY filled) AS r,
         count(*) OVER () AS n FROM f) WHERE r = n // 2 + 1)) AS sparse) """


@check(
    "issues",
    _REPORT
    + f"""SELECT severity, category, "column", other, round(value, 4) AS value FROM (
       SELECT 'warning' AS severity, 'structure' AS category, NULL AS "column", NULL AS other, sparse::DOUBLE AS value FROM t WHERE sparse > 0
       UNION ALL SELECT CASE WHEN pct > 20 THEN 'error' ELSE 'warning' END, 'missing', NULL, NULL, pct FROM t WHERE pct > 10
       UNION ALL SELECT 'info', 'duplicate', NULL, NULL, dup FROM t WHERE dup > 0
       UNION ALL SELECT 'error', 'missing', "column", NULL, missing_pct FROM pr WHERE missing_pct > 50
       UNION ALL SELECT 'info', 'outlier', "column", NULL, outliers FROM pr WHERE outliers > 0
       UNION ALL SELECT 'warning', 'variance', "column", NULL, 0 FROM pr WHERE constant
       UNION ALL SELECT 'info', 'variance', "column", NULL, sd / abs(mean) FROM pr WHERE near
       UNION ALL SELECT 'info', 'distribution', "column", NULL, skewness FROM pr WHERE type = 'numeric' AND dist_type <> 'normal'
       UNION ALL SELECT 'warning', 'correlation', x, y, r FROM ({_corr_sql(NUM)}) WHERE abs(r) > 0.95)""",
)
def _(spark, sf):
    out = quality.issues(quality.profile(items(spark, sf), _ROLES))
    return out.withColumn("value", F.round("value", 4))


@check(
    "recommendations",
    _REPORT
    + """SELECT priority, category, "column", round(value, 4) AS value FROM (
       SELECT 'high' AS priority, 'missing' AS category, NULL AS "column", pct AS value FROM t WHERE pct > 10
       UNION ALL SELECT 'medium', 'duplicate', NULL, dup FROM t WHERE dup > 0
       UNION ALL SELECT 'medium', 'outlier', "column", outliers FROM pr WHERE outliers > 0
       UNION ALL SELECT 'high', 'scaling', "column", max - min FROM pr WHERE type = 'numeric' AND (max - min > 1000 OR max - min < 0.01)
       UNION ALL SELECT 'medium', 'distribution', "column", skewness FROM pr WHERE abs(skewness) > 1 AND "unique" > 2
       UNION ALL SELECT 'high', 'dominant', "column", 100 * sd * sd / (SELECT sum(sd * sd) FROM pr) FROM pr
         WHERE sd * sd > 0.5 * (SELECT sum(sd * sd) FROM pr))""",
)
def _(spark, sf):
    out = quality.recommendations(quality.profile(items(spark, sf), _ROLES))
    return out.withColumn("value", F.round("value", 4))


@check(
    "dataset_score",
    _REPORT
    + """SELECT round(greatest(0, least(100, 100 - 0.5 * max(pct) - 50.0 * count(*) FILTER (constant) / count(*) - 30.0 * max(dup) / max(n)
       - 5 * count(*) FILTER (missing_pct > 50) - 20.0 * sum(outliers) / (max(n) * count(*) FILTER (type = 'numeric')))), 5) AS score FROM pr, t""",
)
def _(spark, sf):
    return quality.dataset_score(quality.profile(items(spark, sf), _ROLES)).withColumn("score", F.round("score", 5))


@check(
    "column_scores",
    _REPORT
    + """SELECT "column", round(greatest(0, least(100, 100 - 0.5 * missing_pct - 30.0 * outliers / rows
       - CASE WHEN constant THEN 15 WHEN near THEN 10 ELSE 0 END)), 5) AS score FROM pr""",
)
def _(spark, sf):
    return quality.column_scores(quality.profile(items(spark, sf), _ROLES)).withColumn("score", F.round("score", 5))


@check(
    "readiness",
    f"""WITH {_ITEMS}, m AS ({_each(NUM + TXT, "100.0 * (count(*) - count({c})) / count(*) AS p, count(*) - count({c}) AS k")}),
       n AS (SELECT count(*) AS n FROM items),
       k AS (SELECT count(*) - count(DISTINCT l_orderkey) AS rep FROM items)
       SELECT level, "check", "column", round(value, 5) AS value FROM (
       SELECT 'INFO' AS level, 'numeric_columns' AS "check", NULL AS "column", {len(NUM)}::DOUBLE AS value
       UNION ALL SELECT 'INFO', 'categorical_columns', NULL, {len(TXT)}
       UNION ALL SELECT 'INFO', 'missing', NULL, (SELECT 100.0 * sum(k) FROM m) / (n * {len(NUM + TXT)}) FROM n
       UNION ALL SELECT 'INFO', 'large', NULL, n FROM n WHERE n > 10000
       UNION ALL SELECT 'INFO', 'row_names', 'l_orderkey', NULL
       UNION ALL SELECT 'WARNING', 'row_names_repeated', 'l_orderkey', rep FROM k WHERE rep > 0
       UNION ALL SELECT 'WARNING', 'missing', "column", p FROM m WHERE p > 50
       UNION ALL SELECT 'WARNING', 'constant', 'flat', NULL)""",
)
def _(spark, sf):
    out = quality.readiness(items(spark, sf), _ROLES.assign("l_orderkey", "id"))
    return out.withColumn("value", F.round("value", 5))


@check(
    "validate_file",
    f"""WITH {_ITEMS}, s AS ({_each(NUM, "count({c}) AS n, 100.0 * (count(*) - count({c})) / count(*) AS percent, var_pop({c}) AS v")})
       SELECT "column", CASE WHEN n = 0 THEN 'error' ELSE 'warning' END AS level,
         CASE WHEN n = 0 THEN 'all_missing' WHEN n > 1 AND v < 1e-10 THEN 'no_variance' ELSE 'mostly_missing' END AS finding,
         round(percent, 6) AS percent, false AS valid FROM s WHERE n = 0 OR (n > 1 AND v < 1e-10) OR percent > 50""",
)
def _(spark, sf):
    return quality.validate_file(items(spark, sf), _ROLES, strict=True).withColumn("percent", F.round("percent", 6))


@check(
    "scale_advice",
    """WITH s AS (SELECT 'l_quantity' AS c, stddev_samp(l_quantity) AS sd FROM lineitem UNION ALL SELECT 'l_extendedprice', stddev_samp(l_extendedprice) FROM lineitem
         UNION ALL SELECT 'l_tax', stddev_samp(l_tax) FROM lineitem)
       SELECT arg_max(c, sd) AS widest, arg_min(c, sd) AS narrowest, round(max(sd) / min(sd), 2) AS ratio,
         CASE WHEN max(sd) / min(sd) > 100 THEN 'very different' WHEN max(sd) / min(sd) > 10 THEN 'different' ELSE 'similar' END AS scales,
         false AS closed, false AS mostly_zero FROM s""",
)
def _(spark, sf):
    out = quality.scale_advice(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.select("widest", "narrowest", F.round("ratio", 2).alias("ratio"), "scales", "closed", "mostly_zero")


@check(
    "closed_composition",
    """WITH s AS (SELECT a + b + c AS s FROM (SELECT l_quantity AS a, 2 * l_quantity + l_discount AS b, 1000 - 3 * l_quantity AS c FROM lineitem)),
       m AS (SELECT s AS mid FROM (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM s) WHERE r = n // 2 + 1)
       SELECT (max(s) - min(s)) / max(mid) < 0.01 AS closed, round(max(mid), 6) AS total FROM s, m""",
)
def _(spark, sf):
    q = F.col("l_quantity")
    df = table(spark, sf, "lineitem").select(q.alias("a"), (2 * q + F.col("l_discount")).alias("b"), (1000 - 3 * q).alias("c"))
    return quality.closed_composition(df, ["a", "b", "c"]).withColumn("total", F.round("total", 6))


_RATIO = """r AS (SELECT vec_id, list_sum(list_transform(list_zip(x[2:], x[:-2]), lambda p: pow(p[1] - p[2], 2))) / (len(x) - 1)
    / list_var_samp(x) AS ratio, len(x) AS m FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""


@check("continuity", f"WITH {_RATIO} SELECT vec_id, round(ratio, 8) AS ratio FROM r")
def _(spark, sf):
    out = quality.continuity(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", F.round("ratio", 8).alias("ratio"))


@check(
    "axis_report",
    f"""WITH {_RATIO} SELECT CAST(max(m) AS INTEGER) AS variables, round(median(ratio), 8) AS ratio, median(ratio) <= 0.5 AS continuous,
        round(2 / median(ratio), 8) AS factor FROM r""",
)
def _(spark, sf):
    out = quality.axis_report(table(spark, sf, "embeddings"), "embedding")
    return out.withColumns({"ratio": F.round("ratio", 8), "factor": F.round("factor", 8)})


@check(
    "response_advisory",
    """SELECT 'l_linenumber' AS response, count(l_linenumber) AS observed, count(*) AS total, count(DISTINCT l_linenumber) AS "unique", true AS categorical FROM lineitem
       UNION ALL SELECT 'l_discount', count(l_discount), count(*), count(DISTINCT l_discount), count(DISTINCT l_discount) <= 10 FROM lineitem""",
)
def _(spark, sf):
    return quality.response_advisory(table(spark, sf, "lineitem"), ["l_linenumber", "l_discount"])


@check(
    "responses",
    f"WITH {_ITEMS} SELECT 'l_tax' AS response, count(l_tax) AS observed, count(*) AS total FROM items UNION ALL SELECT 'l_discount', count(l_discount), count(*) FROM items",
)
def _(spark, sf):
    return quality.responses(items(spark, sf), ["l_tax", "l_discount"])
