"""Substring dedup by sliding spans of sentences.

A text is cut into sentences; a long sentence is cut further at its commas, and a
stretch that is still long after words chosen by their own hash, so that a passage
pasted into the middle of another sentence is cut the same way in every document.
From each sentence starts one span: the fewest following sentences, at least
``sentences`` of them, that hold ``words`` words. Full-width marks need no white
space after them, and in scripts written without spaces between words, lengths are
measured and stretches cut by characters. Spans are hashed over their words
in lower case. The first of equal spans, by doc_id and then by place, stays; every
sentence under any other is removed.

Repeats inside a document are found where it is read. Across documents, one
aggregate finds the smallest doc_id of each hash (combined before the shuffle),
and a join with the repeated hashes alone gives the spans to remove; both sides are
stored tables, so AQE may split a passage that very many documents share.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices
from eigenframe.plans.durable import discard, stored
from eigenframe.roles import unique_name

#: Characters of scripts without spaces between words: about two make a word, or five.
DENSE = "々〆〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
LOOSE = "ก-๎ກ-໎ໜ-ໟက-ဿၐ-႟ក-៓"
PAIRED, SPELLED = re.compile(f"[{DENSE}]"), re.compile(f"[{LOOSE}]")
UNSPACED = re.compile(f"[{DENSE}{LOOSE}]")
WIDE = re.compile(f"[{DENSE}{LOOSE}。！？｡，；：、､။៕។]")  # in a text with one of these, parts may end inside words
END = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？｡။៕។]+[\"'”’)\]」』）】》〉］｣]*\s*|\s*\n\s*")
COMMA = re.compile(r"[,;:]\s+|[，；：、､]\s*")
GAP = re.compile(r"\s+|$")
LONG = 12  # words a sentence may have before it is cut further
GRAM = 4  # characters whose hash decides on a cut inside a word without spaces


def _units(part: str) -> int:
    """The words of ``part``, a long one without spaces counted by its characters."""
    return sum(max(1, (5 * len(PAIRED.findall(w)) + 2 * len(SPELLED.findall(w)) + 9) // 10) for w in part.split())


def _cut_by_words(text: str, a: int, b: int) -> list[int]:
    """Ends of the parts of a stretch without a mark: after words whose hash is a multiple of four.

    Where a word has no spaces around it, after runs of characters whose hash is a multiple of eight.
    """
    ends, at = [], a
    for gap in GAP.finditer(text, a, b):
        word = text[at : gap.start()]
        if len(word) > GRAM and not word.isascii() and UNSPACED.search(word):
            for i in range(GRAM, len(word)):
                if UNSPACED.match(word, i - 1) and zlib.crc32(word[i - GRAM : i].lower().encode("utf-8", "surrogatepass")) % 8 == 0:
                    if unicodedata.category(word[i])[0] != "M":  # a mark stays with its letter
                        ends.append(at + i)
        if gap.end() > gap.start() > at and zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % 4 == 0:
            ends.append(gap.end())
        at = gap.end()
    return ends


def sentences(text: str) -> tuple[list[int], list[int]]:
    """Ends of the sentences of ``text`` as places in it, and the number of words of each (``_units`` in scripts without spaces).

    White space after a sentence belongs to it; a part without a word joins the one before it.
    """
    ends, counts, at = [], [], 0

    def add(end: int, n: int) -> None:
        nonlocal at
        if n:
            ends.append(end), counts.append(n)
        elif ends:
            ends[-1] = end
        at = end if n or ends else at

    unspaced = not text.isascii() and UNSPACED.search(text) is not None

    def words(a: int, b: int) -> int:
        return _units(text[a:b]) if unspaced else len(text[a:b].split())

    for stop in [*(m.end() for m in END.finditer(text)), len(text)]:
        if stop <= at:
            continue
        n = words(at, stop)
        if n > LONG:
            for comma in [*(m.end() for m in COMMA.finditer(text, at, stop)), stop]:
                if comma <= at:
                    continue
                if words(at, comma) > LONG:
                    for end in _cut_by_words(text, at, comma):
                        add(end, words(at, end))
                if comma > at:
                    add(comma, words(at, comma))
        else:
            add(stop, n)
    return ends, counts


def spans(text: str, least_sentences: int = 3, least_words: int = 20) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentence after the last) of every span of ``text``."""
    ends, counts = sentences(text)
    total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))) if counts else np.zeros(1, dtype=np.int64)
    if len(counts) < least_sentences or total[-1] < least_words:
        return []
    if not text.isascii() and WIDE.search(text):
        parts = [" ".join(text[a:b].lower().split()).encode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]
        tail = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        joined, total_of = b" ".join(parts), np.arange(len(parts) + 1)
    else:
        joined, tail = _words_joined(text, total)
        total_of = total
    begin = np.concatenate(([0], tail[:-1]))
    n = len(counts)
    stop = np.maximum(np.searchsorted(total, total[:-1] + least_words), np.arange(n) + least_sentences)
    ok = np.flatnonzero(stop <= n)
    first, last = total_of[:-1][ok], total_of[stop[ok]] - 1
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b]) for a, b in zip(begin[first].tolist(), (tail[last] - 1).tolist())]
    return list(zip(found, ok.tolist(), stop[ok].tolist()))


def _words_joined(text: str, total: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of ``text`` in lower case with single spaces, and where each ends, its space included."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text.isascii() else [w.encode("utf-8", "surrogatepass") for w in text.lower().split()]
    if len(words) != total[-1]:  # lower case, or a rare control character, changed how words part
        words = [w.lower().encode("utf-8", "surrogatepass") for w in text.split()]
    return b" ".join(words), np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)


def row_key() -> Column:
    """Tells texts of one doc_id apart, and orders those without one."""
    return F.xxhash64("text")


def all_spans(docs: DataFrame, least_sentences: int, least_words: int) -> DataFrame:
    """(h, doc_id, key, at, again): each span; ``again`` if the same document has it earlier.

    ``at`` packs the number of sentences (each has a word, so there are at most
    ``least_words``) and the first sentence, to keep what is shuffled small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            h, doc, key, at, again = [], [], [], [], []
            for d, k, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen: set[int] = set()
                found = spans(text or "", least_sentences, least_words)
                for x, a, b in found:
                    h.append(x), at.append((b - a) << 32 | a), again.append(x in seen)
                    seen.add(x)
                doc.extend([d] * len(found)), key.extend([k] * len(found))
            hashes = pa.array(np.array(h, dtype=np.uint64).view(np.int64))
            columns = [hashes, *(pa.array(x, pa.int64()) for x in (doc, key, at)), pa.array(again, pa.bool_())]
            yield pa.record_batch(columns, names=["h", "doc_id", "key", "at", "again"])

    if not 1 <= max(least_sentences, least_words) < 256:
        raise ValueError("a span has fewer than 256 sentences and words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "h long, doc_id long, key long, at long, again boolean")


def without(text: str, cover: list[tuple[int, int]]) -> tuple[str, int, int]:
    """``text`` without the sentences in ``cover``, and how many sentences and words went."""
    ends, counts = sentences(text)
    gone = np.zeros(len(ends) + 1, dtype=np.int64)
    for a, b in cover:
        gone[a] += 1
        gone[b] -= 1
    out = np.cumsum(gone)[: len(ends)] > 0
    starts = [0, *ends[:-1]]
    kept = "".join(text[a:b] for a, b, x in zip(starts, ends, out.tolist()) if not x)
    return kept.rstrip() if out[-1] else kept, int(out.sum()), int(np.array(counts)[out].sum())


RESULT = "struct<text:string,removed_sentences:int,removed_words:int>"


def _cleaned(text: pa.Array, cover: pa.Array) -> pa.Array:
    found = [
        None if t is None or c is None else without(t, [(x & 0xFFFFFFFF, (x & 0xFFFFFFFF) + (x >> 32 & 0xFF)) for x in c])
        for t, c in zip(text.to_pylist(), cover.to_pylist())
    ]
    columns = [[None if f is None else f[i] for f in found] for i in range(3)]
    return pa.StructArray.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))],
        names=["text", "removed_sentences", "removed_words"],
    )


def remove_repeats(
    docs: DataFrame, least_sentences: int = 3, least_words: int = 20, names: tuple[str, str] = ("removed_sentences", "removed_words")
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, plus what was removed: two columns called ``names``.

    Every row and every other column stays as it is. A NULL text stays NULL, and a
    text with too few sentences or words for a span stays whole. In scripts without
    spaces two characters count as a word (five in Thai, Lao, Burmese and Khmer). Rows of one doc_id
    count as one document, so none of them is cut for the sake of another. Rows with a
    NULL doc_id come after all others, by the hash of their text, each text a document
    of its own (so rows that repeat such a text are not cut for each other). A document all of whose sentences repeat keeps an
    empty text. Columns of ``docs`` named as the two new ones are replaced.
    """
    found = stored(all_spans(docs, least_sentences, least_words), "spans")
    fresh = found.filter(~F.col("again")).select("h", "doc_id", "key", "at")
    nameless = F.min(F.when(F.col("doc_id").isNull(), F.col("key")))
    owners = fresh.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), nameless.alias("owner_key")).filter("n > 1")
    owners = stored(owners.select("h", "owner", F.when(F.col("owner").isNull(), F.col("owner_key")).alias("owner_key")), "owners")
    after = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") > F.col("owner")).otherwise(F.col("owner").isNotNull() | (F.col("key") > F.col("owner_key")))
    later = fresh.join(owners, "h").filter(after).select("doc_id", "key", "at")
    hits = later.union(found.filter("again").select("doc_id", "key", "at"))
    doc, key, cover_doc, cover_key, cover_at, cut = (
        unique_name(c, [*docs.columns, *names]) for c in ("span_doc", "span_key", "cover_doc", "cover_key", "cover_at", "span_cut")
    )
    cover = hits.groupBy(F.col("doc_id").alias(cover_doc), F.col("key").alias(cover_key)).agg(F.collect_set("at").alias(cover_at))
    cover = stored(cover, "cover")
    discard(found), discard(owners)
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), key: row_key()})
    joined = keyed.join(cover, F.col(doc).eqNullSafe(F.col(cover_doc)) & (F.col(key) == F.col(cover_key)), "left")
    changed = F.when(F.col(cover_at).isNotNull(), F.col("text"))
    joined = joined.withColumn(cut, F.arrow_udf(_cleaned, RESULT)(changed, F.col(cover_at)))
    new = {
        "text": F.coalesce(F.col(cut)["text"], F.col("text")),
        names[0]: F.coalesce(F.col(cut)["removed_sentences"], F.lit(0)),
        names[1]: F.coalesce(F.col(cut)["removed_words"], F.lit(0)),
    }
    return joined.withColumns(new).drop(doc, key, cover_doc, cover_key, cover_at, cut)
