"""Parsing, reading, writing, and the streaming additions on batch tables."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from checks.models import CENTER, DIVISOR, FEATURES, KEY, P, _given_sql, given
from checks.registry import check, table
from eigenframe.functions.parsing import to_number
from eigenframe.operators import gappy, scoring
from eigenframe.operators.gappy import _Component
from eigenframe.plans.durable import scratch_path
from eigenframe.sources import models as store
from eigenframe.sources import tables
from eigenframe.streaming.monitor import share_outside


@check(
    "parse_numbers",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN o_totalprice WHEN 2 THEN NULL WHEN 3 THEN 'inf'::DOUBLE
       WHEN 4 THEN -o_totalprice ELSE NULL END AS x FROM orders""",
)
def _(spark, sf):
    k, p = F.col("o_orderkey") % 6, F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(","))
    cell = (
        F.when(k == 0, "N/A").when(k == 1, F.concat(F.lit(" "), p)).when(k == 2, F.concat(p, F.lit("d")))
        .when(k == 3, "Inf").when(k == 4, F.concat(F.lit("-"), p)).otherwise(F.col("o_orderpriority"))
    )
    df = table(spark, sf, "orders").select("o_orderkey", cell.alias("c"))
    return df.select("o_orderkey", to_number(F.col("c"), ",").alias("x"))


@check(
    "delimited_round_trip",
    """SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderpriority"
    )
    path = scratch_path(spark, "orders")
    tables.write_table(df, path, dialect=tables.EUROPEAN)
    back, roles = tables.read_table(spark, path, dialect=tables.detect_dialect(spark, path), id_col="o_orderkey")
    assert roles.categorical == ("o_orderpriority",)
    return back.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@check("parquet_roles", "SELECT c_custkey, c_acctbal, c_nationkey FROM customer")
def _(spark, sf):
    df, roles = tables.read_table(spark, f"{sf}/customer.parquet", "parquet", id_col="c_custkey")
    return df.select(roles.id_col, *roles.features)


@check(
    "model_round_trip",
    f"WITH {_given_sql()} SELECT {', '.join(KEY)}, round(pc1, 7) + 0.0 AS pc1, round(q, 7) + 0.0 AS q FROM s",
)
def _(spark, sf):
    path = scratch_path(spark, "model")
    store.save_model(given(), spark, path)
    out = scoring.score(table(spark, sf, "lineitem"), store.load_model(spark, path), KEY)
    return out.select(*KEY, (F.round("pc1", 7) + 0.0).alias("pc1"), (F.round("q", 7) + 0.0).alias("q"))


# Scores over observed cells: each component takes what the one before has left of the cells that are there.
_HOLED = f"""WITH z AS (SELECT *, {", ".join(f"CASE WHEN l_linenumber % {5 + i} <> 0 THEN ({c} - {a}) / {b} END AS z{i}" for i, (c, a, b) in enumerate(zip(FEATURES, CENTER, DIVISOR)))} FROM lineitem),
    n AS (SELECT *, {" + ".join(f"CASE WHEN z{i} IS NULL THEN 0 ELSE 1 END" for i in range(4))} AS seen FROM z),
    a AS (SELECT *, ({" + ".join(f"coalesce(z{i}, 0) * {P[i, 0]}" for i in range(4))}) / (seen * 0.25) AS pc1 FROM n),
    b AS (SELECT *, ({" + ".join(f"coalesce(z{i} - pc1 * {P[i, 0]}, 0) * {P[i, 1]}" for i in range(4))}) / (seen * 0.25) AS pc2 FROM a),
    c AS (SELECT *, {" + ".join(f"coalesce(pow(z{i} - pc1 * {P[i, 0]} - pc2 * {P[i, 1]}, 2), 0)" for i in range(4))} AS q FROM b)"""


@check("gap_model_round_trip", f"{_HOLED} SELECT {', '.join(KEY)}, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in ('pc1', 'pc2', 'q'))} FROM c")
def _(spark, sf):
    path = scratch_path(spark, "gap-model")
    components = [_Component(0, 0.0, [P[:, j]]) for j in range(2)]
    store.save_model(replace(given(), regression=None, history=(components, np.ones(2))), spark, path)
    holed = {c: F.when(F.col("l_linenumber") % (5 + i) != 0, F.col(c)) for i, c in enumerate(FEATURES)}
    out = gappy.score_missing(table(spark, sf, "lineitem").withColumns(holed), store.load_model(spark, path), KEY)
    return out.select(*KEY, *[(F.round(c, 7) + 0.0).alias(c) for c in ("pc1", "pc2", "q")])


@check(
    "share_outside_by_window",
    f"""WITH {_given_sql()} SELECT strftime(time_bucket(INTERVAL 30 DAY, l_shipdate, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS start, count(*) AS n,
        round(avg(CASE WHEN outside THEN 1.0 ELSE 0.0 END), 8) AS share_outside FROM o GROUP BY 1""",
)
def _(spark, sf):
    scored = scoring.with_outside(scoring.score(table(spark, sf, "lineitem"), given(), ["l_shipdate"]), given())
    out = share_outside(scored, "l_shipdate", "30 days")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n", F.round("share_outside", 8).alias("share_outside"))
