"""Near copies at a given similarity: candidates from SimHash and from bands of minimum hashes, each verified exactly.

SimHash at a radius that block joins can serve finds pairs that are nearly equal, and
only some of those at a Jaccard similarity of 0.8. Bands of minimum hashes of the same
shingles add candidates down to that similarity: with 16 bands of 6, a pair at 0.8 shares
a band with a chance of 99 %. A link counts only if the shingle sets of both texts are as
similar as asked, so candidates that met for another reason cost time and nothing else.

Texts that are equal count once. Groups of a candidate key that have the same members
are one group. In a task, members of a group are walked breadth-first: what links to
a text already found leaves the pool, so copies of one text cost one comparison each. A
group larger than a task should walk is dealt to cells, one for each pair of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices, text_bytes
from eigenframe.llm.components import components
from eigenframe.llm.simhash import SEED, close_links, text_key
from eigenframe.plans.durable import discard, stored
from eigenframe.roles import unique_name

BROADCAST_NODES = 1_000_000  # text hashes that may be broadcast, 8 MB; more are joined by a shuffle
_CELLS = 1 << 18  # hashes times functions at once
_BITS = 64 << 20  # bytes of the bitsets of one cell


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; a shorter text is one shingle, none without a word."""
    found = text.lower().split()  # on bytes: A-Z only, and the ASCII white space only
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    tails = ends[min(words, len(found)) - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), tails)], dtype=np.uint64)


def simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        some = hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


class Bands:
    """Keys of ``bands`` groups of ``rows`` minimum hashes each."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.flip = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64)
        self.times = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; ``hashes`` must not be empty."""
        least = np.full(len(self.flip), np.iinfo(np.uint64).max, dtype=np.uint64)
        step = max(1, _CELLS // len(self.flip))
        for at in range(0, len(hashes), step):
            np.minimum(least, ((hashes[at : at + step, None] ^ self.flip) * self.times).min(axis=0), out=least)
        data = least.astype("<u8").reshape(self.shape)
        return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(data)], dtype=np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _bitsets(sets: list[np.ndarray]) -> np.ndarray | None:
    """Each set as bits, over the hashes that more than one of them has; None if that takes too much memory."""
    found, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place, wide = np.cumsum(shared) - 1, -(-int(shared.sum()) // 64)
    if len(sets) * wide * 8 > _BITS:
        return None
    bits, ends = np.zeros((len(sets), wide), dtype=np.uint64), np.cumsum([len(s) for s in sets])
    for i, (end, s) in enumerate(zip(ends, sets)):
        mine = code[end - len(s) : end]
        row = np.zeros(wide * 64, dtype=bool)
        row[place[mine[shared[mine]]]] = True
        bits[i] = np.packbits(row).view(np.uint64)
    return bits


def links_within(nodes: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links at ``least`` or more that span what such links connect."""
    size, bits = np.array([len(s) for s in sets]), _bitsets(sets) if len(sets) > 2 else None
    out, left = [], np.lexsort((nodes, size))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            fits = np.minimum(size[left], size[at]) >= least * np.maximum(size[left], size[at])
            near = np.zeros(len(left), dtype=bool)
            some = left[fits]
            if bits is None:
                near[fits] = [similarity(sets[at], sets[i]) >= least for i in some]
            else:
                both = np.bitwise_count(bits[some] & bits[at]).sum(axis=1, dtype=np.int64)
                near[fits] = both / (size[at] + size[some] - both) >= least
            hit = left[near].tolist()
            out.extend((nodes[at], nodes[i]) for i in hit)
            queue.extend(hit)
            left = left[~near]
    return out


def _sketches(texts: DataFrame, words: int, bands: Bands) -> DataFrame:
    """(node, fp, keys) of each row (node, text); texts without a word have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            hashes = [shingle_hashes(t, words) for t in text_bytes(batch.column(1))]
            keys = [bands.keys(h) if len(h) else np.zeros(0, np.int64) for h in hashes]
            fps = pa.array([simhash_of(h) if len(h) else 0 for h in hashes], pa.int64())
            yield pa.record_batch([batch.column(0), fps, pa.array(keys, pa.list_(pa.int64()))], names=["node", "fp", "keys"])

    return texts.mapInArrow(run, "node long, fp long, keys array<long>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the sorted shingle set of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            data = [np.unique(shingle_hashes(t, words)).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def _verified(cells: DataFrame, least: float) -> DataFrame:
    """(a, b) links within runs of equal (key, cell) of rows (key, cell, node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = links_within(nodes, sets, least)
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, cell, node, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, cell) != now:
                    if len(nodes) > 1:
                        yield links()
                    now, nodes, sets = (key, cell), [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, dtype=np.uint64))
        if len(nodes) > 1:
            yield links()

    parts = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return parts.select("key", "cell", "node", "hashes").mapInArrow(run, "a long, b long").distinct()


def _few(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a hint to broadcast them if they are few enough."""
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


def _dealt(members: DataFrame, cell_rows: int) -> DataFrame:
    """(key, cell, node): members of a key, dealt so that every two of them meet in a cell of bounded size."""
    met = members.withColumn("_n", F.ceil(F.col("n") / cell_rows)).withColumn("_mine", F.pmod(F.xxhash64("node", F.lit(1)), "_n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_other")
    return met.select("key", "node", "_n", "_mine", other).select(
        "key", (F.least("_mine", "_other") * F.col("_n") + F.greatest("_mine", "_other")).alias("cell"), "node"
    )


def _stars(keyed: DataFrame, cell_rows: int) -> DataFrame:
    """(key, cell, node): the smallest node of each key, with parts of those it shares any key with."""
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = stored(keyed.join(hubs, "key").filter("node <> hub").select("hub", "node").distinct(), "stars")
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
    near = pairs.join(sizes, "hub").select(F.col("hub").alias("key"), F.pmod(F.xxhash64("node", F.lit(2)), "cells").alias("cell"), "node")
    own = sizes.select(F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.col("hub").alias("node"))
    return near.unionByName(own)


def links(texts: DataFrame, words: int = 5, least: float = 0.8, bits: int = 4, bands: int = 16, rows: int = 6, cell_rows: int = 1024) -> DataFrame:
    """(a, b) pairs of ``node`` of different texts (node, text) at similarity ``least`` or more that connect the candidates that are.

    First the smallest node of each candidate key is compared with the others, which ties
    most copies together. Only keys whose members are still apart are walked in full.
    """
    sketches = stored(_sketches(texts, words, Bands(bands, rows)).filter(F.size("keys") > 0).dropDuplicates(["node"]), "sketches")
    heads = stored(sketches.select("fp").distinct(), "heads")
    close = stored(close_links(heads, bits), "links")
    tied = close.withColumn("key", F.xxhash64("a", "b", F.lit("simhash")))
    tied = tied.select("key", F.explode(F.array("a", "b")).alias("fp")).unionByName(heads.select(F.xxhash64("fp", F.lit("same")).alias("key"), "fp"))
    by_hash = tied.join(sketches.select("fp", "node"), "fp").select("key", "node")
    keyed = sketches.select(F.explode("keys").alias("key"), "node").unionByName(by_hash)
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    keyed = stored(keyed.join(shared, "key").distinct(), "keys")
    wanted = stored(keyed.select("node").distinct(), "nodes")
    sets = stored(_sets(texts.join(_few(wanted), "node", "left_semi").select("node", "text"), words).dropDuplicates(["node"]), "sets")

    first = stored(_verified(_stars(keyed, cell_rows).join(sets, "node"), least), "verified")
    parts = stored(components(first, "a", "b"), "components")
    apart = keyed.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("_part", F.coalesce("component", "node"))
    apart = apart.groupBy("key").agg(
        F.count("*").alias("n"), (F.min("_part") != F.max("_part")).alias("open"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s"),
    ).filter("open")
    # Keys with the same members are one group.
    groups = stored(apart.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"), "groups")
    second = _verified(_dealt(keyed.join(groups, "key"), cell_rows).join(sets, "node"), least)
    out = stored(first.unionByName(second), "verified")
    for table in (sketches, heads, close, keyed, wanted, sets, first, parts, groups):
        discard(table)
    return out


def first_of_each(docs: DataFrame, words: int = 5, least: float = 0.8, bits: int = 4, bands: int = 16, rows: int = 6, cell_rows: int = 1024) -> DataFrame:
    """``docs`` with one row for each group of near copies: that of the smallest doc_id (NULL last), then text hash.

    Texts at ``least`` or more are linked, and links connect groups. Texts without a
    word (NULL, empty, white space) are one group, since their sets are equal. Rows that
    repeat id and text are one document, of which any row stays. All columns stay as
    they are, whatever their names; an empty table gives no rows.
    """
    key = unique_name("text_key", docs.columns)
    rows_of = docs.select("doc_id", text_key().alias("node"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    verified = links(rows_of.select("node", "text"), words, least, bits, bands, rows, cell_rows)
    ids = stored(rows_of.select("doc_id", "node", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank")), "ids")
    tied = stored(components(verified, "a", "b"), "components")
    named = ids.join(tied.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    group = F.when(F.col("blank"), F.lit(0)).otherwise(1).alias("kind"), F.when(~F.col("blank"), F.coalesce("component", "node")).alias("group")
    named = stored(named.select("doc_id", "node", *group), "named")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = named.groupBy("kind", "group").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    # Only groups of several rows have anything to drop.
    best = best.filter("n > 1").select(F.col("kind").alias("_k"), F.col("group").alias("_g"), "best")
    gone = named.join(best, (F.col("kind") == F.col("_k")) & F.col("group").eqNullSafe(F.col("_g")))
    gone = stored(gone.filter(rank != F.col("best")).select(F.col("doc_id").alias("_id"), "node").distinct(), "gone")
    repeated = ids.groupBy("doc_id", "node").count().filter("count > 1").limit(1).count()
    kept = docs.withColumn(key, text_key())
    if repeated:
        kept = kept.dropDuplicates(["doc_id", key])
    gone = gone.select(F.col("_id").alias(unique_name("gone_id", kept.columns)), F.col("node").alias(unique_name("gone_node", kept.columns)))
    drop = F.col("doc_id").eqNullSafe(F.col(gone.columns[0])) & (F.col(key) == F.col(gone.columns[1]))
    return kept.join(_few(gone), drop, "left_anti").drop(key)
