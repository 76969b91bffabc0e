"""Dropping and filling missing cells."""

from pyspark.sql import functions as F

from checks.quality import _ITEMS, items
from checks.registry import check, table
from eigenframe.operators import missing

_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
_K = ", ".join(_KEY)
_GAPS = ["l_discount", "l_tax"]


def _impute(strategy, sql):
    @check(f"impute_{strategy}", f"WITH {_ITEMS} {sql}")
    def _(spark, sf):
        out = missing.impute(items(spark, sf), _GAPS, strategy).select(*_KEY, *_GAPS)
        return out.withColumns({c: F.round(c, 8) for c in _GAPS})


_impute("drop", f"SELECT {_K}, l_discount, l_tax FROM items WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
_impute("zero", f"SELECT {_K}, coalesce(l_discount, 0) AS l_discount, coalesce(l_tax, 0) AS l_tax FROM items")
for _name, _fn in (("mean", "avg"), ("median", "median")):
    _impute(
        _name,
        f"""SELECT {_K}, round(coalesce(l_discount, (SELECT {_fn}(l_discount) FROM items)), 8) AS l_discount,
            round(coalesce(l_tax, (SELECT {_fn}(l_tax) FROM items)), 8) AS l_tax FROM items""",
    )


_EV = """ev AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"""


def _events(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id",
        F.when(e % 3 != 0, F.col("value")).alias("value"),
        F.when(e % 4 != 0, F.col("event_type")).alias("event_type"),
    )


@check(
    "fill_forward",
    f"""WITH {_EV} SELECT event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(event_type IGNORE NULLS) OVER w AS event_type
        FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(spark, sf):
    out = missing.fill(_events(spark, sf), "forward", ["value", "event_type"], order_by=["ts", "event_id"], partition_by=["user_id"])
    return out.select("event_id", "value", "event_type")


@check(
    "fill_backward",
    f"""WITH {_EV} SELECT event_id, first_value(value IGNORE NULLS) OVER w AS value, first_value(event_type IGNORE NULLS) OVER w AS event_type
        FROM ev WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(spark, sf):
    out = missing.fill(_events(spark, sf), "backward", ["value", "event_type"], order_by=["ts", "event_id"])
    return out.select("event_id", "value", "event_type")


_MODE = "(SELECT {c} FROM ev WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"


@check(
    "fill_mode",
    f"WITH {_EV} SELECT event_id, coalesce(event_type, {_MODE.format(c='event_type')}) AS event_type FROM ev",
)
def _(spark, sf):
    return missing.fill(_events(spark, sf), "mode", ["event_type"]).select("event_id", "event_type")


@check(
    "fill_mean",
    f"""WITH {_EV} SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM ev)), 7) AS value,
        coalesce(event_type, {_MODE.format(c='event_type')}) AS event_type FROM ev""",
)
def _(spark, sf):
    out = missing.fill(_events(spark, sf), "mean", ["value", "event_type"])
    return out.select("event_id", F.round("value", 7).alias("value"), "event_type")


@check(
    "fill_median",
    f"WITH {_EV} SELECT event_id, round(coalesce(value, (SELECT median(value) FROM ev)), 7) AS value FROM ev",
)
def _(spark, sf):
    return missing.fill(_events(spark, sf), "median", ["value"]).select("event_id", F.round("value", 7).alias("value"))


@check(
    "fill_constant",
    f"WITH {_EV} SELECT event_id, coalesce(event_type, 'other') AS event_type FROM ev",
)
def _(spark, sf):
    return missing.fill(_events(spark, sf), "constant", ["event_type"], "other").select("event_id", "event_type")


@check(
    "drop_sparse_fill",
    """WITH s AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS b, CASE WHEN event_id % 15 <= 1 THEN NULL ELSE 1.5 END AS c,
          CASE WHEN event_id % 15 = 0 THEN NULL ELSE value + 1 END AS d FROM events),
       k AS (SELECT * FROM s WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2),
       f AS (SELECT event_id, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b,
          last_value(c IGNORE NULLS) OVER w AS c, last_value(d IGNORE NULLS) OVER w AS d FROM k
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, a, b, c::DOUBLE AS c, d FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""",
)
def _(spark, sf):
    e, v = F.col("event_id"), F.col("value")
    df = table(spark, sf, "events").select(
        "event_id", "ts", "user_id",
        F.when(e % 3 != 0, v).alias("a"), F.when(e % 5 != 0, v * 2).alias("b"),
        F.when(e % 15 > 1, 1.5).alias("c"), F.when(e % 15 != 0, v + 1).alias("d"),
    )
    out = missing.drop_sparse_then_fill(df, list("abcd"), ["ts", "event_id"], partition_by=["user_id"])
    return out.select("event_id", *"abcd")
