"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are scaled to length one, where the largest cosine is the smallest distance,
and projected on ``lines`` random directions. Each projection is a sorted array. A
query opens a window around its own projection in every array; all windows widen
together (virtual rehashing), and a vector that has fallen into enough of them is
verified with its exact cosine. A query is done when its k-th verified distance is so
far inside the windows that a nearer vector would almost surely have been found; windows
that have grown over everything verify everything, so no query ends short.

Rows are dealt to blocks and queries to chunks, both of bounded size. A task holds one
block and one chunk; each query meets every block once, and the best of its blocks are
merged. What a task gives is at most k rows for each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.plans.durable import stored

RESULT = "query_uid long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Windows:
    """How windows grow, when a vector is verified, and when a query is done."""

    share: float = 0.6  # of all windows, that a vector must be in
    start: float = 0.35  # half width; projections of unit vectors have unit spread
    growth: float = 1.5
    reach: float = 1.06  # done when this times the k-th distance is inside the windows


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, lines: int, seed: int):
        self.vectors = vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / self.norms[:, None]
        self.directions = np.random.RandomState(seed).normal(size=(vectors.shape[1], lines))
        at = (self.unit @ self.directions).T
        self.order = np.ascontiguousarray(at.argsort(axis=1, kind="stable"))
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, how: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and cosines of the best verified vectors of each query; ``own`` is its place here, or -1.

        At least ``k`` are given where there are as many, with all that tie with the k-th.
        """
        out: list[tuple[np.ndarray, np.ndarray]] = []
        some = max(1, (4 << 20) // len(self.vectors))  # queries whose counts are held at a time
        for at in range(0, len(queries), some):
            out.extend(self._search(queries[at : at + some], own[at : at + some], k, how))
        return out

    def _search(self, queries: np.ndarray, own: np.ndarray, k: int, how: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
        n, lines = len(self.vectors), len(self.sorted)
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        center, least = (unit @ self.directions).T, math.ceil(how.share * lines)
        counts = np.zeros((len(queries), n), dtype=np.int16)
        near = np.full((len(queries), n), -np.inf, dtype=np.float32)  # cosines of the verified
        wanted = np.minimum(k, n - (own >= 0))
        live, half = np.flatnonzero(wanted > 0), how.start
        left = right = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, center)])
        while len(live):
            lo, hi = left.copy(), right.copy()
            for j, s in enumerate(self.sorted):
                lo[j, live] = np.searchsorted(s, center[j, live] - half, side="left")
                hi[j, live] = np.searchsorted(s, center[j, live] + half, side="right")
            going = []
            for q in live.tolist():
                gained = []  # what the windows have gained on both sides
                for o, a, b, c, d in zip(self.order, lo[:, q].tolist(), left[:, q].tolist(), right[:, q].tolist(), hi[:, q].tolist()):
                    gained += (o[a:b], o[c:d])
                counts[q] += np.bincount(np.concatenate(gained), minlength=n).astype(np.int16)
                fresh = (counts[q] >= least) & (near[q] == -np.inf)
                if own[q] >= 0:
                    fresh[own[q]] = False
                found = np.flatnonzero(fresh)
                if len(found):
                    near[q, found] = self.unit[found] @ unit[q]
                kth = float(np.partition(near[q], n - wanted[q])[n - wanted[q]])
                if kth == -np.inf or math.sqrt(max(0.0, 2 - 2 * kth)) * how.reach > half:
                    going.append(q)
            left, right, half = lo, hi, half * how.growth
            live = np.array(going, dtype=np.int64)
        out = []
        for q, m in enumerate(wanted.tolist()):
            if m <= 0:
                out.append((np.zeros(0, dtype=np.int64), np.zeros(0)))
                continue
            kth = float(np.partition(near[q], n - m)[n - m])
            at = np.flatnonzero(near[q] >= kth - 1e-5)  # beyond the rounding of single precision
            norm = math.sqrt(float((queries[q] * queries[q]).sum()))
            out.append((at, (self.vectors[at] * queries[q]).sum(axis=1) / (self.norms[at] * norm)))
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL or empty, all components finite, not all zero."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame, is_query: Column, k: int = 5, lines: int = 64, how: Windows = Windows(),
    block_rows: int = 65536, least_blocks: int = 24, chunk_rows: int = 4096, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest rows of each query row: query_id, rank, vec_id, score.

    ``rows`` has vec_id and embedding; other columns are ignored. Vectors that are NULL,
    empty, zero, or hold NULL or non-finite components take no part; vectors of another
    length than the query's are no candidates. A row is never its own neighbour, but rows
    that repeat its id are. Equal scores go to the smaller vec_id, NULL last. A query
    with fewer than ``k`` candidates gets them all.
    """
    vector = F.col("embedding").cast("array<double>").alias("v")
    taken = rows.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), vector, F.coalesce(is_query, F.lit(False)).alias("q"))
    kept = stored(taken.withColumn("uid", F.monotonically_increasing_id()).withColumn("d", F.size("v")), "vectors")
    n, queries = kept.agg(F.count("*"), F.sum(F.col("q").cast("long"))).first()
    blocks = max(1, math.ceil(n / block_rows), min(least_blocks, math.ceil(n / 1024)))
    chunks = max(1, math.ceil((queries or 0) / chunk_rows))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    all_chunks = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    queries_only = kept.filter("q")
    block, chunk = F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(chunks)).cast("int")
    base = kept.select("d", block.alias("b"), all_chunks.alias("c"), "uid", "vec_id", "v", F.lit(False).alias("ask"))
    ask = queries_only.select("d", all_blocks.alias("b"), chunk.alias("c"), "uid", "vec_id", "v", F.lit(True).alias("ask"))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("ask").to_numpy(zero_copy_only=False)
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
        uid, ids = table.column("uid").to_numpy(), np.array(table.column("vec_id").to_pylist(), dtype=object)
        data = np.flatnonzero(~asks)
        out: list[list] = [[], [], [], []]
        if len(data):
            built = Block(v[data], lines, seed)
            place = {u: i for i, u in enumerate(uid[data].tolist())}
            tie = np.array([(1 << 63) - 1 if x is None else x for x in ids[data]])
            asked = np.flatnonzero(asks)
            own = np.array([place.get(u, -1) for u in uid[asked].tolist()], dtype=np.int64)
            for i, (at, score) in zip(asked.tolist(), built.search(v[asked], own, k, how)):
                best = np.lexsort((tie[at], -score))[:k]
                for column, values in zip(out, ([int(uid[i])] * len(best), [ids[i]] * len(best), ids[data][at[best]].tolist(), score[best].tolist())):
                    column.extend(values)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in RESULT.split(", ")])

    found = base.unionByName(ask).groupBy("d", "b", "c").applyInArrow(run, RESULT)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
