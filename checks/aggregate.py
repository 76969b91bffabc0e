"""Group aggregates, column statistics, densities."""

from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import aggregate

_GAP = "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount END"
_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


def _items(spark, sf):
    gap = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount"))
    return table(spark, sf, "lineitem").withColumn("d", gap)


def _how(how):
    @check(
        f"aggregate_{how}",
        {
            "mean": f"""SELECT l_suppkey, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(d), 8) AS d,
                  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS l_returnflag
                  FROM (SELECT *, {_GAP} AS d FROM lineitem) GROUP BY l_suppkey""",
            "sum": f"""SELECT l_suppkey, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(d), 6) AS d,
                  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS l_returnflag
                  FROM (SELECT *, {_GAP} AS d FROM lineitem) GROUP BY l_suppkey""",
            "median": f"""SELECT l_suppkey, round(median(l_extendedprice), 4) AS l_extendedprice, round(median(d), 8) AS d,
                  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS l_returnflag
                  FROM (SELECT *, {_GAP} AS d FROM lineitem) GROUP BY l_suppkey""",
            "first": f"""SELECT l_suppkey, first(l_extendedprice ORDER BY {_ORDER}) AS l_extendedprice,
                  first(d ORDER BY {_ORDER}) FILTER (d IS NOT NULL) AS d,
                  CASE WHEN min(l_returnflag) = max(l_returnflag) THEN max(l_returnflag) END AS l_returnflag
                  FROM (SELECT *, {_GAP} AS d FROM lineitem) GROUP BY l_suppkey""",
        }[how],
    )
    def _(spark, sf):
        out = aggregate.aggregate_rows(
            _items(spark, sf), "l_suppkey", how, ["l_extendedprice", "d"], ["l_returnflag"], _ORDER.split(", ")
        )
        digits = {"mean": (4, 8), "sum": (2, 6), "median": (4, 8)}.get(how)
        if digits is None:
            return out
        return out.withColumns({"l_extendedprice": F.round("l_extendedprice", digits[0]), "d": F.round("d", digits[1])})


for _h in ("mean", "median", "sum", "first"):
    _how(_h)


@check(
    "aggregate_preview",
    """SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, max(n) AS largest, min(n) AS smallest,
              CAST(sum(c) AS BIGINT) AS text_conflicts
       FROM (SELECT l_orderkey, count(*) AS n,
               CASE WHEN min(l_returnflag) <> max(l_returnflag) THEN 1 ELSE 0 END
             + CASE WHEN min(l_linestatus) <> max(l_linestatus) THEN 1 ELSE 0 END AS c FROM lineitem GROUP BY 1)""",
)
def _(spark, sf):
    return aggregate.aggregate_preview(table(spark, sf, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(body, cols=_COLS, source="lineitem"):
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM {source}" for c in cols)


@check(
    "column_stats",
    _per_column(
        """count({c}) AS n, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS sd, min({c}) AS min, max({c}) AS max"""
    ),
)
def _(spark, sf):
    s = aggregate.column_stats(table(spark, sf, "lineitem"), _COLS)
    return s.select("column", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "min", "max")


@check(
    "robust_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", m AS median, round(1.4826 * percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({c} - m)), 6) AS mad
            FROM lineitem, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY {c}) AS m FROM lineitem) GROUP BY m"""
        for c in _COLS
    ),
)
def _(spark, sf):
    s = aggregate.robust_column_stats(table(spark, sf, "lineitem"), _COLS)
    return s.withColumn("mad", F.round("mad", 6))


@check(
    "variance_ranking",
    f"""SELECT "column", round(v, 6) AS variance, row_number() OVER (ORDER BY v DESC, "column") AS rank
        FROM ({_per_column("var_samp({c}) / 1e6 AS v")})""",
)
def _(spark, sf):
    v = aggregate.variance_ranking(table(spark, sf, "lineitem"), _COLS)
    return v.select("column", F.round(F.col("variance") / 1e6, 6).alias("variance"), F.col("rank").cast("long"))


@check(
    "constant_columns",
    """SELECT "column" FROM (SELECT 'flag' AS "column", var_pop(1.0) AS v FROM orders
       UNION ALL SELECT 'price', var_pop(o_totalprice) FROM orders UNION ALL SELECT 'tiny', var_pop(o_orderkey * 1e-12) FROM orders)
       WHERE v < 1e-8""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        F.lit(1.0).alias("flag"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") * 1e-12).alias("tiny")
    )
    return aggregate.constant_columns(df, ["flag", "price", "tiny"])


def _box(c):
    return f"""SELECT '{c}' AS "column", min({c}) AS min, round(max(q1), 6) AS q1, round(max(md), 6) AS median, round(max(q3), 6) AS q3,
      max({c}) AS max, min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)) AS lower_fence,
      max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)) AS upper_fence,
      min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1)) > min({c}) AS low_outliers,
      max({c}) FILTER ({c} <= q3 + 1.5 * (q3 - q1)) < max({c}) AS high_outliers
      FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS md, quantile_cont({c}, 0.75) AS q3 FROM events)"""


@check("box_stats", _box("value"))
def _(spark, sf):
    b = aggregate.box_stats(table(spark, sf, "events"), ["value"])
    return b.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


@check(
    "density_grid",
    """WITH p AS (SELECT p_size AS x, p_retailprice AS y FROM part),
       s AS (SELECT count(*) AS n, pow(count(*), -1.0 / 6) * sqrt(stddev_pop(x) * stddev_pop(y)) AS h,
                    min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
       g AS (SELECT i.range AS i, j.range AS j, x0 - 3 * h + j.range * (x1 - x0 + 6 * h) / 50 AS gx,
                    y0 - 3 * h + i.range * (y1 - y0 + 6 * h) / 50 AS gy, h, n FROM s, range(50) i, range(50) j)
       SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
              round(sum(exp(-0.5 * (pow((gx - x) / h, 2) + pow((gy - y) / h, 2)))) / (2 * pi() * max(h) * max(h) * max(n)), 9) AS density
       FROM g, p GROUP BY 1, 2""",
)
def _(spark, sf):
    d = aggregate.density_grid(table(spark, sf, "part"), "p_size", "p_retailprice")
    return d.select("i", "j", F.round("density", 9).alias("density"))


@check(
    "means_extents",
    _per_column("round(avg({c}), 5) AS mean, min({c}) AS min, max({c}) AS max", ["s_acctbal", "s_nationkey"], "supplier"),
)
def _(spark, sf):
    s = aggregate.column_stats(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])
    return s.select("column", F.round("mean", 5).alias("mean"), "min", "max")
