"""Lags, rolling statistics, ranks, and row-wise preprocessing."""

from pyspark.sql import functions as F

from checks.registry import check, table
from eigenframe.operators import rowstage
from eigenframe.operators import windows as win
from eigenframe.plans.dense import smoothing_matrix

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_ORDER = ["ts", "event_id"]


@check(
    "lag_embed",
    f"""SELECT event_id, user_id, value_lag0, value_lag1, value_lag2, value_lag3 FROM
        (SELECT event_id, user_id, value AS value_lag0, lead(value, 1) OVER w AS value_lag1, lead(value, 2) OVER w AS value_lag2,
           lead(value, 3) OVER w AS value_lag3, lead(1, 3) OVER w AS ok FROM events {_W}) WHERE ok = 1""",
)
def _(spark, sf):
    return win.lag_embed(table(spark, sf, "events"), ["value"], 4, _ORDER, ["user_id"]).drop("ts")


def _label(mode, sql):
    @check(f"window_label_{mode}", sql)
    def _(spark, sf):
        out = win.lag_embed(table(spark, sf, "events"), ["value"], 3, _ORDER, ["user_id"], "event_type", mode)
        return out.select("event_id", "window_label")


_THREE = f"""SELECT event_id, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events {_W}"""
_label("first", f"SELECT event_id, a AS window_label FROM ({_THREE}) WHERE c IS NOT NULL")
_label("last", f"SELECT event_id, c AS window_label FROM ({_THREE}) WHERE c IS NOT NULL")
_label("majority", f"SELECT event_id, CASE WHEN b = c THEN b ELSE a END AS window_label FROM ({_THREE}) WHERE c IS NOT NULL")


@check(
    "autocorrelation",
    """WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS t, value - m AS x, v FROM events,
         (SELECT avg(value) AS m, var_pop(value) AS v FROM events))
       SELECT CAST(k.range AS INTEGER) AS lag, CASE WHEN k.range = 0 THEN 1.0 ELSE round(avg(a.x * b.x) / max(a.v), 8) END AS r
       FROM range(11) k JOIN s a ON true JOIN s b ON b.t = a.t + k.range GROUP BY k.range""",
)
def _(spark, sf):
    out = win.autocorrelation(table(spark, sf, "events"), "value", 10, _ORDER)
    return out.withColumn("r", F.round("r", 8))


@check(
    "autocorrelation_by_series",
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value - avg(value) OVER (PARTITION BY user_id) AS x,
           var_pop(value) OVER (PARTITION BY user_id) AS v FROM events)
       SELECT user_id, lag, CASE WHEN lag = 0 THEN 1.0 ELSE round(avg(p) / max(v), 8) END AS r
       FROM (SELECT a.user_id, CAST(b.t - a.t AS INTEGER) AS lag, a.x * b.x AS p, a.v
             FROM s a JOIN s b ON a.user_id = b.user_id AND b.t BETWEEN a.t AND a.t + 3) GROUP BY user_id, lag""",
)
def _(spark, sf):
    out = win.autocorrelation(table(spark, sf, "events"), "value", 3, _ORDER, ["user_id"])
    return out.withColumn("r", F.round("r", 8))


@check(
    "returns",
    f"""SELECT event_id, round((value - p) / nullif(p, 0), 9) + 0.0 AS value_simple, round(ln(value) - ln(p), 8) + 0.0 AS value_log,
        round(value - p, 6) + 0.0 AS value_difference FROM (SELECT event_id, value, lag(value) OVER w AS p FROM events {_W})""",
)
def _(spark, sf):
    out = win.returns(table(spark, sf, "events"), "value", _ORDER, ["user_id"])
    digits = {"value_simple": 9, "value_log": 8, "value_difference": 6}
    return out.select("event_id", *[(F.round(c, d) + 0.0).alias(c) for c, d in digits.items()])


@check(
    "rolling_volatility",
    """SELECT event_id, CASE WHEN n >= 20 THEN round(s * sqrt(252), 6) END AS vol FROM (SELECT event_id, count(value) OVER w AS n,
         stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
)
def _(spark, sf):
    out = win.rolling(table(spark, sf, "events"), "value", 20, "volatility", _ORDER, ["user_id"], "vol")
    return out.select("event_id", F.round("vol", 6).alias("vol"))


@check(
    "moving_average_ratio",
    """SELECT event_id, CASE WHEN n >= 5 THEN round(m, 7) END AS ma, CASE WHEN n >= 5 THEN round(value / m, 7) END AS ratio
       FROM (SELECT event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m FROM events
             WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""",
)
def _(spark, sf):
    df = win.rolling(table(spark, sf, "events"), "value", 5, "mean", _ORDER, name="ma")
    out = win.rolling(df, "value", 5, "ratio", _ORDER, name="ratio")
    return out.select("event_id", F.round("ma", 7).alias("ma"), F.round("ratio", 7).alias("ratio"))


@check(
    "average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS rank
       FROM lineitem""",
)
def _(spark, sf):
    out = win.average_rank(table(spark, sf, "lineitem"), "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@check(
    "diagonal_average",
    """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)
       SELECT user_id, t, round(value, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM s) WHERE n >= 3""",
)
def _(spark, sf):
    from eigenframe.plans.ranges import dense_index

    lagged = win.lag_embed(table(spark, sf, "events"), ["value"], 3, _ORDER, ["user_id"])
    placed = dense_index(lagged, _ORDER, ["user_id"], "at")
    out = win.diagonal_average(placed, ["value"], 3, "at", ["user_id"])
    return out.withColumn("value", F.round("value", 6))


_X = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _long(df, name):
    return df.select("vec_id", F.posexplode(name).alias("i", "v")).select("vec_id", "i", (F.round("v", 8) + 0.0).alias("v"))


@check(
    "snv",
    f"""SELECT vec_id, CAST(generate_subscripts(z, 1) - 1 AS INTEGER) AS i, round(unnest(z), 8) + 0.0 AS v FROM
        (SELECT vec_id, list_transform(x, lambda e: (e - list_avg(x)) / list_stddev_samp(x)) AS z FROM {_X})""",
)
def _(spark, sf):
    return _long(rowstage.snv(table(spark, sf, "embeddings"), "embedding"), "snv")


@check(
    "vector_norm",
    f"""SELECT vec_id, CAST(generate_subscripts(z, 1) - 1 AS INTEGER) AS i, round(unnest(z), 8) + 0.0 AS v FROM
        (SELECT vec_id, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda u: u * u)))) AS z FROM {_X})""",
)
def _(spark, sf):
    return _long(rowstage.vector_norm(table(spark, sf, "embeddings"), "embedding"), "unit")


def _savgol_sql(m=64, window=7, order=2):
    w = smoothing_matrix(m, window, order)
    rows = ", ".join("[" + ", ".join(repr(float(v)) for v in w[i]) + "]" for i in range(m))
    return f"""WITH c AS (SELECT [{rows}]::DOUBLE[][] AS c)
      SELECT vec_id, CAST(i.range AS INTEGER) AS i, round(list_dot_product(x, c[i.range + 1]), 8) + 0.0 AS v FROM {_X}, c, range({m}) i"""


@check("savgol", _savgol_sql())
def _(spark, sf):
    return _long(rowstage.savgol(table(spark, sf, "embeddings"), "embedding", 7, 2), "smooth")


@check("row_stage")
def _(spark, sf):
    stage = rowstage.RowStage(snv=True, sg_window=9, sg_order=2, sg_deriv=1)
    return _long(rowstage.apply_row_stage(table(spark, sf, "embeddings"), "embedding", stage, "z"), "z")


_F = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale(scaling, center, divisor):
    body = ", ".join(f"round(({c} - {center.format(c=c)}) / ({divisor.format(c=c)}), 7) + 0.0 AS {c}" for c in _F)
    stats = ", ".join(
        f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, percentile_disc(0.5) WITHIN GROUP (ORDER BY {c}) AS {c}_p" for c in _F
    )
    mads = ", ".join(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({c} - {c}_p)) AS {c}_d" for c in _F)

    @check(
        f"scale_{scaling}",
        f"""WITH s AS (SELECT {stats} FROM lineitem), d AS (SELECT {mads} FROM lineitem, s)
            SELECT l_orderkey, l_linenumber, l_partkey, {body} FROM lineitem, s, d""",
    )
    def _(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_F)
        out = rowstage.apply_columns(df, rowstage.fit_columns(df, _F, scaling))
        return out.withColumns({c: F.round(c, 7) + 0.0 for c in _F})


_scale("center", "{c}_m", "1")
_scale("standard", "{c}_m", "{c}_s")
_scale("scale", "0", "{c}_s")
_scale("robust", "{c}_p", "1.4826 * {c}_d")


@check("scale_inverse", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(f"round({c}, 6) AS {c}" for c in _F) + " FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_F)
    stage = rowstage.fit_columns(df, _F, "standard")
    out = rowstage.invert_columns(rowstage.apply_columns(df, stage), stage)
    return out.withColumns({c: F.round(c, 6) for c in _F})


@check(
    "observed_stats",
    """SELECT "column", round(center, 8) AS center, round(divisor, 8) AS divisor FROM (
       SELECT 'd' AS "column", avg(l_discount) AS center, stddev_samp(l_discount) AS divisor FROM lineitem WHERE l_linenumber % 5 <> 0
       UNION ALL SELECT 't', avg(l_tax), stddev_samp(l_tax) FROM lineitem WHERE l_linenumber % 3 <> 0)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount")).alias("d"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("t"),
    )
    s = rowstage.fit_columns(df, ["d", "t"], "standard")
    rows = [(c, round(a, 8), round(b, 8)) for c, a, b in zip(s.features, s.center, s.divisor)]
    return spark.createDataFrame(rows, "column string, center double, divisor double")
