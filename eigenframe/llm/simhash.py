"""SimHash near duplicates: fingerprints, pigeonhole blocks, components.

Fingerprints of 64 bits are cut into blocks. Two that differ in at most ``bits``
places leave at least ``blocks - bits`` blocks untouched, so they agree on some
choice of that many blocks: each choice is a join key, and every close pair meets
under one of them, whatever the data. Only distinct fingerprints are compared,
with the smallest id of each, so copies cost nothing.

Under a key, rows sit sorted in one partition. Few rows are compared by shifts of
the sorted arrays; many are walked breadth-first, each found fingerprint leaving
the pool, so that a key gives a spanning forest and never its pairs. A key with
more fingerprints than a task should walk is dealt to cells, one for each pair of
its parts: every two of its rows still meet, in some task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices, text_bytes
from eigenframe.llm.components import components
from eigenframe.plans.durable import stored
from eigenframe.roles import unique_name

SEED = 42


def fingerprint(text: bytes, words: int = 4) -> int:
    """SimHash of the word shingles of ``text``, as a signed 64-bit number; 0 if it has no word."""
    found = text.lower().split()  # on bytes: A-Z only, and the ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    tails = ends[min(words, len(found)) - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), tails)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 8192):
        some = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def text_key() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, key, fp) for each row of ``docs``, ``key`` being ``text_key``; a NULL text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            fps = [fingerprint(t, words) for t in text_bytes(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "key", "fp"])

    text = F.col("text").cast("string").alias("text")
    return docs.select("doc_id", text_key().alias("key"), text).mapInArrow(run, "doc_id long, key long, fp long")


def block_count(distinct: int, bits: int) -> int:
    """Blocks whose keys are some times longer than numbering the fingerprints would take.

    Any number of blocks above ``bits`` finds the same pairs; this one keeps
    chance meetings fewer than the rows of the join.
    """
    for blocks in range(bits + 2, 65):
        if (64 // blocks) * (blocks - bits) >= math.log2(max(distinct, 1)) + 2:
            return blocks
    return 64


def block_masks(blocks: int, bits: int) -> list[int]:
    """A mask of the bits kept, for each choice of ``blocks - bits`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(single, blocks - bits)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_forest(fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at ``bits`` or fewer that span the components of one key's fingerprints."""
    found, left = [], fp
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                hit = left[near]
                found.append((np.full(len(hit), at), hit))
                queue.extend(hit)
                left = left[~near]
    return found


def _links(keys: np.ndarray, fps: np.ndarray, bits: int, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; ``keys`` (rows of two numbers) must be sorted."""
    change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    starts = np.concatenate(([0], change))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= few, sizes)
    out = []
    for step in range(1, few):
        same = (run[step:] == run[:-step]) & small[step:]
        a, b = fps[:-step][same], fps[step:][same]
        near = np.bitwise_count(a ^ b) <= bits
        out.append((a[near], b[near]))
    for k in np.flatnonzero(sizes > few):
        out.extend(close_forest(fps[starts[k] : starts[k] + sizes[k]], bits))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _link_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    keys, fps = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.uint64)

    def emit(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = _links(k, f, bits)
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
        keys = np.concatenate([keys, key])
        fps = np.concatenate([fps, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys):
            last = int(np.argmax((keys == keys[-1]).all(axis=1)))  # the last run may go on in the next batch
            if last:
                yield emit(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield emit(keys, fps)


def close_links(fps: DataFrame, bits: int, blocks: int | None = None, cell_rows: int = 8192) -> DataFrame:
    """(a, b) pairs of distinct fingerprints at ``bits`` or fewer that connect all that are connected by such pairs.

    ``fps`` has one row per distinct ``fp``.
    """
    blocks = blocks or block_count(fps.count(), bits)
    masks = block_masks(blocks, bits)
    each = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("kept")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(each).alias("_k")).select((F.xxhash64("_k.choice", "_k.kept")).alias("key"), "fp")
    # Keys that meet by chance of the hash only add pairs to verify.
    sizes = stored(rows.groupBy("key").count().filter(F.col("count") > 1), "keys")
    cells = F.ceil(F.col("count") / cell_rows)
    met = rows.join(sizes, "key").withColumn("_n", cells).withColumn("_mine", F.pmod(F.xxhash64("fp", F.lit(1)), "_n"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_other")
    dealt = met.select("key", "fp", "_n", "_mine", other).select(
        "key", (F.least("_mine", "_other") * F.col("_n") + F.greatest("_mine", "_other")).alias("cell"), "fp"
    )
    parts = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return parts.mapInArrow(lambda it: _link_batches(it, bits), "a long, b long").distinct()


def _grouped(docs: DataFrame, words: int, bits: int, blocks: int | None, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with their fingerprints, and (fp, component, component_id) for each fingerprint."""
    rows = stored(fingerprints(docs, words), "fingerprints")
    heads = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    links = stored(close_links(heads.select("fp"), bits, blocks, cell_rows), "links")
    tied = stored(components(links, "a", "b"), "components")
    named = heads.join(tied, heads["fp"] == tied["node"])
    least = stored(named.groupBy("component").agg(F.min("head").alias("least")), "least")
    of_fp = heads.join(tied, heads["fp"] == tied["node"], "left").join(least, "component", "left")
    component = F.coalesce("component", "fp").alias("component")
    number = F.when(F.col("component").isNull(), F.col("head")).otherwise(F.col("least"))
    return rows, stored(of_fp.select(F.col("fp").alias("_fp"), component, number.alias("component_id")), "groups")


def near_groups(docs: DataFrame, words: int = 4, bits: int = 4, blocks: int | None = None, cell_rows: int = 8192) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    The component is the smallest doc_id reachable over links of ``bits`` or fewer
    differing bits, itself included. Rows without a word have fingerprint zero and
    link like any others. Repeated rows and repeated ids give a row each; a NULL
    doc_id is never the smallest, and a group of such rows has a NULL component.
    Columns beyond doc_id and text are ignored.
    """
    rows, groups = _grouped(docs, words, bits, blocks, cell_rows)
    return rows.join(groups, rows["fp"] == groups["_fp"]).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, words: int = 4, bits: int = 4, blocks: int | None = None, cell_rows: int = 8192) -> DataFrame:
    """``docs`` with one row for each group of near duplicates: that of the smallest doc_id (NULL last), then text hash.

    Rows that repeat both are one document, of which any row stays. All columns stay as they are.
    """
    rows, groups = _grouped(docs, words, bits, blocks, cell_rows)
    named = rows.join(groups, rows["fp"] == groups["_fp"])
    best = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("b"))
    key, best_id, best_key = (unique_name(c, docs.columns) for c in ("text_key", "best_id", "best_key"))
    best = stored(best.select(F.col("b.doc_id").alias(best_id), F.col("b.key").alias(best_key)), "first")
    keyed = docs.withColumn(key, text_key())
    if rows.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count():
        keyed = keyed.dropDuplicates(["doc_id", key])
    same = F.col("doc_id").eqNullSafe(F.col(best_id)) & (F.col(key) == F.col(best_key))
    return keyed.join(best, same, "left_semi").drop(key)
