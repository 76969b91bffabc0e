"""How far each source of a language departs from the others, and from the language, in its words.

Terms are counted per slice of texts, then per (language, source, term) over all rows.
Terms in enough documents of their language are kept and numbered. A group (language
and source) is then a sorted array of term numbers with their counts, cut into blocks
of bounded size and packed. One task takes an unordered pair of groups and a block:
the numbers of the shorter array are searched in the longer one, from the place of
the one before, and terms of both, of either alone and of neither are priced. The
price is the same both ways, so a pair is priced once and reported twice.

All prices are integers and exact: probabilities in billionths, and the floor of
(p - q)² / (p + q) for each term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.llm.common import slices, text_bytes
from eigenframe.plans.durable import discard, stored

#: Letters A-Z become small; other ASCII but a-z separates terms; bytes beyond ASCII stay.
_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_SCALE = 1_000_000_000


@dataclass(frozen=True)
class Rules:
    least_documents: int = 10  # of its language, for a term to be kept
    top: int = 10  # terms listed per group
    block: int = 65_536  # terms of a language that one pair task merges


def _count(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of a slice of (lang, source, text)."""
    texts = pa.array([t.translate(_FOLD) for t in text_bytes(batch.column(2))], pa.binary())
    split = pc.split_pattern(texts, pattern=b" ")
    words = split.flatten().dictionary_encode()
    terms = words.dictionary
    code = words.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = pc.not_equal(terms, pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)[code] if len(terms) else np.zeros(0, bool)
    size = max(1, len(terms))
    in_doc, n = np.unique(doc[real] * size + code[real], return_counts=True)
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    langs = lang.indices.to_numpy().astype(np.int64)
    group = langs * max(1, len(source.dictionary)) + source.indices.to_numpy()
    _, of_doc = np.unique(group, return_inverse=True)
    first = np.unique(group, return_index=True)[1]
    key = of_doc[in_doc // size] * size + in_doc % size
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    at, found = key[order][starts] // size, key[order][starts] % size
    sums = np.add.reduceat(n[order], starts) if len(starts) else n
    docs = np.diff(np.append(starts, len(order)))
    rows = pa.array(first[at])
    columns = [batch.column(0).take(rows), batch.column(1).take(rows), terms.take(pa.array(found)), pa.array(sums.astype(np.int64)), pa.array(docs)]
    return pa.record_batch(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, limit=8 << 20, rows=1 << 16):
            yield _count(batch)

    found = docs.select(*_group(), F.col("text").cast("string").alias("text"))
    found = found.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def billionths(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in steps of a thousand: exact up to 9 · 10^15."""
    over = total + 2 * terms
    whole, rest = F.lit(0).cast("long"), (count + 2).cast("long")
    for _ in range(3):
        here = rest * 1000
        whole, rest = whole * 1000 + _div(here, over), here % over
    return whole + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def probabilities(counts: np.ndarray, over: int) -> np.ndarray:
    """``billionths`` of an array, ``over`` being the whole divisor."""
    rest = counts.astype(np.int64) + 2
    if not len(rest) or int(rest.max()) < 1 << 33:
        return rest * _SCALE // over + 1
    whole = np.zeros(len(rest), dtype=np.int64)
    for _ in range(3):
        here, rest = divmod(rest * 1000, over)
        whole = whole * 1000 + here
    return whole + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and their counts: gaps and counts byte by byte of equal weight, compressed."""
    gaps = np.diff(ids, prepend=0).astype("<u8")
    planes = np.stack([gaps, counts.astype("<u8")], axis=1).view(np.uint8).reshape(len(ids), 16).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=16 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(16, n)
    both = np.ascontiguousarray(planes.T).view("<i8").reshape(n, 2)
    return np.cumsum(both[:, 0]), both[:, 1]


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], over_a: int, over_b: int) -> tuple[int, int]:
    """(sum of prices, terms) of the terms that one of two sorted (numbers, counts) has.

    NumPy's search goes on from the place of the number before, as long as numbers
    rise, so the shorter array leaps through the longer one.
    """
    if len(a[0]) > len(b[0]):
        a, b, over_a, over_b = b, a, over_b, over_a
    p, q = probabilities(a[1], over_a), probabilities(b[1], over_b)
    none_a, none_b = (probabilities(np.zeros(1), over)[0] for over in (over_a, over_b))
    at = np.searchsorted(b[0], a[0])
    hit = np.zeros(len(at), dtype=bool)
    inside = at < len(b[0])
    hit[inside] = b[0][at[inside]] == a[0][inside]
    alone = np.ones(len(b[0]), dtype=bool)
    alone[at[hit]] = False
    total = prices(p[hit], q[at[hit]]).sum() + prices(p[~hit], none_b).sum() + prices(none_a, q[alone]).sum()
    return int(total), len(p) + int(alone.sum())


def _pair_task(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    lang, a, b, over_a, over_b = (k.as_py() for k in key[:5])
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    x, y = (unpack(t.column(7)[0].as_py(), t.column(6)[0].as_py()) if len(t) else empty for t in (left, right))  # data, size
    total, terms = merged(x, y, over_a, over_b)
    return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([total], pa.int64()), "terms": pa.array([terms], pa.int64())})


def _pack_group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    ids, counts = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(ids)
    names = {c: pa.array([k.as_py()], k.type) for c, k in zip(("lang", "source", "block"), key)}
    return pa.table({**names, "size": pa.array([len(ids)], pa.int64()), "data": [pack(ids[order], counts[order])]})


def _numbered(docs: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, term, n, lang_n, id, lead) of kept terms; ``lead`` is 1 in one row of each (lang, term), else 0.

    Numbers are given after the last exchange of their rows, in the task that writes
    them, so that a task that runs again changes no number that others have seen.
    """
    term = Window.partitionBy("lang", "term")
    out = term_counts(docs).withColumn("_docs", F.sum("docs").over(term)).filter(F.col("_docs") >= rules.least_documents)
    out = out.withColumn("lang_n", F.sum("n").over(term)).withColumn("_row", F.monotonically_increasing_id())
    out = out.withColumn("id", F.min("_row").over(term)).withColumn("lead", (F.col("id") == F.col("_row")).cast("long"))
    return stored(out.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "id", "lead"), "terms")


def audit(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``docs``.

    Part ``pair``: each other source of the language, by the summed prices of all kept
    terms. Part ``term``: the kept terms that the group has oftener than its language,
    the dearest ``rules.top``. NULL texts, languages and sources are empty strings, and
    such a group is one like any other. Groups without kept terms have pairs too (0 if
    their language keeps none) and no terms; a language of one source has no pairs.
    Repeated rows count as often as they are there. Other columns are ignored; an empty
    table gives no rows.
    """
    kept = _numbered(docs, rules)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("lead").alias("terms"))
    seen = docs.select(*_group()).distinct().join(sums, ["lang", "source"], "left")
    by_lang = seen.groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    groups = stored(seen.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total")).join(by_lang, "lang"), "groups")

    most = groups.agg(F.max("terms")).first()[0] or 0
    blocks = max(1, math.ceil(most / rules.block))
    cells = kept.select("lang", "source", "id", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"))
    schema = "lang string, source string, block int, size long, data binary"
    arrays = stored(cells.groupBy("lang", "source", "block").applyInArrow(_pack_group, schema), "arrays")

    over = (F.col("total") + 2 * F.col("terms")).alias("over")
    one = groups.select("lang", F.col("source").alias("a"), over.alias("over_a"), "terms")
    two = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("b"), over.alias("over_b"))
    pairs = stored(one.join(two, (F.col("lang") == F.col("_lang")) & (F.col("a") < F.col("b"))).drop("_lang"), "pairs")
    keys = ["lang", "a", "b", "over_a", "over_b", "block"]  # then size and data: the places _pair_task reads
    side = lambda c: pairs.drop("terms").join(arrays.withColumnRenamed("source", c), ["lang", c])
    right = side("b").select(*[F.col(k).alias(f"_{k}") for k in (*keys, "size", "data")])
    tasks = side("a").select(*keys, "size", "data").groupBy(*keys).cogroup(right.groupBy(*[f"_{k}" for k in keys]))
    merges = tasks.applyInArrow(_pair_task, "lang string, a string, b string, value long, terms long")
    priced = merges.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("terms").alias("seen"))

    zero = lambda c: billionths(F.lit(0), F.col(c), F.lit(0))  # noqa: E731  the terms are in ``over`` already
    neither = F.when(F.col("terms") > 0, price(zero("over_a"), zero("over_b")) * (F.col("terms") - F.coalesce("seen", F.lit(0)))).otherwise(0)
    value = (F.coalesce("value", F.lit(0)) + neither).alias("value")
    both = pairs.join(priced, ["lang", "a", "b"], "left").select("lang", F.explode(_both_ways()).alias("_way"), value)
    both = both.select("lang", "_way.source", F.lit("pair").alias("part"), "_way.item", "value")

    named = kept.join(groups, ["lang", "source"])
    p, q = billionths(F.col("n"), F.col("total"), F.col("terms")), billionths(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = named.withColumn("_p", p).withColumn("_q", q).filter("_p > _q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("_p"), F.col("_q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.top)
    out = stored(both.withColumn("rank", F.row_number().over(order)).unionByName(top), "audit")
    for table in (kept, groups, arrays, pairs):
        discard(table)
    return out


def _both_ways() -> Column:
    way = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    return F.array(way("a", "b"), way("b", "a"))
