"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Statistics of the whole text, none of its id or source, are standardised and mapped
to cosines that approximate a Gaussian kernel. Each task sums its part of the normal
equations, by fold; the sums are added up in a tree of fan ``FAN``. What reaches the
driver is one matrix per fold, of the size of the features. Each fold is scored by
the equations of the other folds (total minus fold), and those held-out scores, in a
fixed number of bins, are what the isotonic curve is fitted to.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import cuts, release, slices
from eigenframe.plans.durable import stored

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "space", "mark", "cry", "symbol", "other", "non_ascii", "newline",
    "distinct", "echo", "top_word", "bare", "repeated_line", "short_word", "repeated_trigram", "ends_line",
)
FAN = 32
LOW, HIGH, BINS = -0.25, 1.25, 1024  # of raw scores, for calibration
_KIND = np.zeros(128, dtype=np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c\n", ".,;:?'", "!", "#*$%&|<>", "\"`~@^_=+/\\[]{}()-"), 1):
    _KIND[[ord(c) for c in _chars]] = _k


def statistics(text: str) -> list[float]:
    """The statistics of a text, all finite; those of an empty one are 0."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, words = len(codes), text.split()
    if not n:
        return [0.0] * len(STATISTICS)
    ascii_ = codes[codes < 128]
    kinds = np.bincount(_KIND[ascii_], minlength=8) / n
    upper = kinds[1] + (sum(map(str.isupper, text)) - kinds[1] * n) / n if len(ascii_) < n else kinds[1]
    m, counts = max(1, len(words)), Counter(words)
    echo = sum(a == b for a, b in zip(words, words[1:])) / m
    bare = sum(k for w, k in counts.items() if not any(map(str.isalnum, w)))
    short = sum(k for w, k in counts.items() if len(w) <= 3)
    lines = [x for x in text.split("\n") if x.strip()]
    trigrams = Counter(zip(words, words[1:], words[2:]))
    again = sum(k for k in trigrams.values() if k > 1)
    ended = sum(x.rstrip().endswith((".", "?", "!", "…", "。")) for x in lines)
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / m, float(upper), *(float(x) for x in kinds[2:8]),
        1 - len(ascii_) / n, text.count("\n") / n, len(counts) / m, echo, max(counts.values(), default=0) / m, bare / m,
        1 - len(set(lines)) / max(1, len(lines)), short / m, again / max(1, m - 2), ended / max(1, len(lines)),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs``; a NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = pa.array([statistics(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), x], names=["doc_id", "x"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # of the features and of the constant
    curve: tuple[np.ndarray, np.ndarray]  # raw score, calibrated score

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -5.0, 5.0)
        phi = np.sqrt(2.0 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([phi, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(x) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _equations(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold, the sum of [phi, y]'[phi, y] over weighted rows (x, fold, n, ones)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                phi = shared.value.features(_matrix(batch.column(0)))
                fold, n, ones = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                for f in np.unique(fold):
                    p, w, y = phi[fold == f], n[fold == f].astype(float), ones[fold == f].astype(float)
                    m = np.concatenate([(p * w[:, None]).T @ p, (p.T @ y)[:, None]], axis=1)
                    sums[int(f)] = sums[int(f)] + m if int(f) in sums else m
        where = TaskContext.get().partitionId() if TaskContext.get() else 0
        for f, m in sums.items():
            yield pa.record_batch([pa.array([f]), pa.array([where], pa.int64()), pa.array([m.tobytes()])], names=["fold", "part", "m"])

    def add(table: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x.as_buffer()) for x in table.column("m"))
        first = [table.column("fold")[0].as_py()], [table.column("part")[0].as_py() // FAN], [m.tobytes()]
        return pa.table([pa.array(first[0]), pa.array(first[1], pa.int64()), pa.array(first[2])], names=["fold", "part", "m"])

    schema = "fold long, part long, m binary"
    sums = stored(rows.select("x", "fold", "n", "ones").mapInArrow(part, schema), "equations")
    while (sums.agg(F.max("part")).first()[0] or 0) > 0:
        sums = stored(sums.groupBy("fold", F.floor(F.col("part") / FAN)).applyInArrow(add, schema), "equations")
    size = len(model.phases) + 1
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        out[r["fold"]] = np.frombuffer(r["m"]).reshape(size, size + 1)
    return out


def solve(equations: np.ndarray, ridge: float) -> np.ndarray:
    gram, target = equations[:, :-1], equations[:, -1]
    penalty = np.full(len(gram), ridge * max(1.0, gram[-1, -1]) / len(gram))
    penalty[-1] = 1e-9 * max(1.0, gram[-1, -1])  # the constant is free
    return np.linalg.solve(gram + np.diag(penalty), target)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in rising order; the middle and the share of ones of each pool."""
    pools: list[list[float]] = []
    for at, w, y in zip(x, n, ones):
        pools.append([at * w, w, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fit(
    measured: DataFrame, labels: DataFrame, learn_from: Column, features: int = 256, width: float = 1.0, ridge: float = 0.01, seed: int = 7
) -> Model:
    """A model from ``measured`` (doc_id, x) and ``labels`` (doc_id, quality), over labels where ``learn_from`` is true.

    All such rows are used. Labels of one id are added up first, so an id with very
    many labels is one weighted row. NULL labels teach nothing; without any label
    every score is 0.5.
    """
    marked = labels.filter(learn_from & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    summed = marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("double")).alias("ones"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")
    rows = stored(measured.join(summed, "doc_id").select("x", fold, "n", "ones"), "labelled")
    d = len(STATISTICS)
    n = F.sum("n").alias("n")
    sums = rows.agg(n, *[F.sum(F.col("x")[i] * F.col("n")).alias(f"s{i}") for i in range(d)]).first()
    rng = np.random.RandomState(seed)
    directions, phases = rng.normal(size=(d, features)) / (width * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features)
    if not sums["n"]:
        flat = (np.array([0.0]), np.array([0.5]))
        return Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(features + 1), flat)
    center = np.array([sums[f"s{i}"] for i in range(d)]) / sums["n"]
    spread = rows.agg(*[F.sum((F.col("x")[i] - float(center[i])) ** 2 * F.col("n")).alias(f"s{i}") for i in range(d)]).first()
    scale = np.sqrt(np.array([spread[f"s{i}"] for i in range(d)]) / sums["n"])
    scale = np.where(scale > 1e-9, scale, 1.0)
    blank = Model(center, scale, directions, phases, np.zeros(features + 1), (np.zeros(1), np.zeros(1)))
    by_fold = _equations(rows, blank)
    total = sum(by_fold.values())
    others = {f: solve(total - m, ridge) if (total - m)[-1, -2] > 0.5 else np.zeros(features + 1) for f, m in by_fold.items()}
    shared = rows.sparkSession.sparkContext.broadcast((blank, others))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights = shared.value
        for batch in batches:
            if batch.num_rows:
                fold, raw = batch.column(1).to_numpy(), np.empty(batch.num_rows)
                x = _matrix(batch.column(0))
                for f in np.unique(fold):
                    raw[fold == f] = model.raw(x[fold == f], weights[int(f)])
                at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.record_batch([pa.array(at), batch.column(2), batch.column(3)], names=["bin", "n", "ones"])

    scored = rows.select("x", "fold", "n", "ones").mapInArrow(held_out, "bin long, n long, ones double")
    bins = sorted(scored.groupBy("bin").agg(n, F.sum("ones").alias("ones")).collect(), key=lambda r: r["bin"])
    at = np.array([LOW + (r["bin"] + 0.5) * (HIGH - LOW) / BINS for r in bins])
    curve = isotonic(at, np.array([float(r["n"]) for r in bins]), np.array([r["ones"] for r in bins]))
    return Model(center, scale, directions, phases, solve(total, ridge), curve)


def score_measured(measured: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""
    shared = measured.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = shared.value.score(_matrix(batch.column(1)))
                yield pa.record_batch([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def score_text(text: Column, session, model: Model) -> Column:
    """The score of a text column, as an expression: rows keep all their columns."""
    shared = session.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        parts = [np.array([statistics(t or "") for t in texts.slice(at, n).to_pylist()]) for at, n in cuts(texts)]
        release()
        return pa.array(shared.value.score(np.concatenate(parts))) if parts else pa.array([], pa.float64())

    return F.arrow_udf(run, "double")(text.cast("string"))
