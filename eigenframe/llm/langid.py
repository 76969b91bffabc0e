"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, and runs of anything but letters count as one gap. N-grams of
one to three characters are hashed to a fixed number of buckets. Each task counts
buckets per language and gives one row for each that occurs, so what is shuffled and
what reaches the driver is bounded by buckets times languages. The matrix of log
probabilities is broadcast: buckets times at most ``MAX_LANGUAGES`` floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 256
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, one row per order; where each text starts; whether it has a letter.

    Two gaps stand before every text, and gaps are thought after the last, so no n-gram joins
    two texts and none depends on the texts around.
    """
    lowered = ["  " + t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum(sizes) - sizes
    alpha = _letters()[codes]
    some = np.add.reduceat(alpha, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, dtype=bool)
    first = np.zeros(len(codes), dtype=bool)
    first[starts] = first[starts + 1] = True
    keep = alpha | first | np.concatenate(([True], alpha[:-1]))  # a gap is kept where it begins
    place = np.cumsum(keep) - 1
    kept = np.where(alpha, codes, 32)[keep].astype(np.uint32)
    starts = place[starts]
    n = len(kept)
    padded = np.concatenate([kept, np.full(max(ORDERS), 32, dtype=np.uint32)])
    out, h = np.empty((len(ORDERS), n), dtype=np.int32), np.zeros(n, dtype=np.uint32)
    for k in range(max(ORDERS)):
        h = (h ^ padded[k : k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out[ORDERS.index(k + 1)] = ((h + np.uint32(k)) & np.uint32(BUCKETS - 1)).astype(np.int32)
    return out, starts, some


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray  # languages x buckets
    log_prior: np.ndarray


def fit(docs: DataFrame, learn_from: Column, smoothing: float = 0.5) -> Model:
    """Count over all rows of ``docs`` (text, lang) where ``learn_from`` is true; NULL languages teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, 0, limit=2 << 20):
            texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            grams, starts, _ = hashed(texts)
            names = sorted(set(langs))
            index = {x: i for i, x in enumerate(names)}
            which = np.repeat(np.array([index[x] for x in langs]), np.diff(np.append(starts, grams.shape[1])))
            for order in grams:
                found = np.bincount(which * BUCKETS + order, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for x, row in zip(names, found):
                    if x not in counts:
                        counts[x] = np.zeros(BUCKETS + 1, dtype=np.int64)
                    counts[x][:BUCKETS] += row
            for x in langs:
                counts[x][BUCKETS] += 1  # documents
        for x, row in counts.items():
            at = np.flatnonzero(row)
            columns = [pa.array([x] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at])]
            yield pa.record_batch(columns, names=["lang", "bucket", "n"])

    rows = docs.filter(learn_from & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), "lang")
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.limit(MAX_LANGUAGES * (BUCKETS + 1) + 1).toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS + 1))
    index = {x: i for i, x in enumerate(languages)}
    counts[[index[x] for x in found.column("lang").to_pylist()], found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    grams, documents = counts[:, :BUCKETS] + smoothing, counts[:, BUCKETS]
    log_prob = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    return Model(tuple(languages), log_prob, np.log(documents / max(1.0, documents.sum())))


def classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    grams, starts, some = hashed([t or "" for t in texts])
    if not len(texts) or not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total = np.tile(model.log_prior, (len(texts), 1))
    for k, row in enumerate(model.log_prob):
        for order in grams:
            total[:, k] += np.add.reduceat(row[order], starts, dtype=np.float64)
    best = total.argmax(axis=1)
    score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    names = [model.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
    return names, np.where(some, score, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` of every row of ``docs``.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every
    text if nothing was learned. Equal posteriors go to the first name. Rows with a
    NULL or repeated id are classified like any others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, limit=2 << 20):
            names, score = classify(batch.column(1).to_pylist(), shared.value)
            yield pa.record_batch([batch.column(0), pa.array(names), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
