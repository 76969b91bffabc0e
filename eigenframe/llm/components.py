"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is one minimum per node and one join with it. Minima are combined
before their shuffle, and since both sides of the join are stored tables, AQE may
split a node with very many neighbours. Rounds grow with the logarithm of the
nodes; each is a table in the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.plans.durable import discard, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _pull(pairs: DataFrame, include: DataFrame) -> DataFrame:
    """``pairs`` (node, other) whose other end is tied to the smallest neighbour of ``node`` instead."""
    least = stored(include.groupBy("node").agg(F.min("other").alias("least")), "least")
    joined = pairs.join(least.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"))
    return joined.select(F.col("other").alias("u"), F.col("least").alias("v")), least


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges may repeat, run either way, or join a node to itself; NULL ends are no
    edges. An empty table gives no rows. Raises if ``max_rounds`` do not suffice,
    which takes a path of more nodes than any table can hold.
    """
    clean = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    loops = clean.filter("_a = _b").select(F.col("u").alias("node"))
    now = stored(clean.filter("_a <> _b").select("u", "v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("u").alias("node"), F.col("v").alias("other")).union(now.select("v", "u"))
        large, least = _pull(both.filter("other > node"), both.union(both.select("node", "node")))
        middle = stored(large.filter("u <> v").distinct(), "edges")
        discard(least), discard(now)
        down = middle.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("other"))
        small, least = _pull(down, down)
        ties = small.union(least.select("node", "least")).filter("u <> v")
        now = stored(ties.distinct(), "edges")
        discard(least), discard(middle)
        before, mark = mark, _mark(now)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(loops).distinct()
    own = roots.join(stars.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left_anti")
    return stars.union(own.select("node", F.col("node").alias("component")))
