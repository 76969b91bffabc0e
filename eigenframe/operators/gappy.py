"""NIPALS on rows with gaps: one aggregate per iteration, no state kept between jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.operators.pca import PCAModel, _model
from eigenframe.operators.rowstage import Features, RowStage, element_columns, robust_stats, stage_numbers
from eigenframe.plans.dense import FLAT, NIPALS_STEPS, fix_signs
from eigenframe.plans.gram import feature_array, width_of

_TINY = 1e-8  # least sum of squares a least-squares step divides by


@dataclass
class _Component:
    """How a row finds its score: the start column and every loading vector tried so far.

    A row whose observed loadings are all about zero keeps its previous score, so
    the whole (short) history is what replaces per-row state.
    """

    column: int
    start: float
    tried: list[np.ndarray] = field(default_factory=list)

    def scores(self, w: np.ndarray, seen: np.ndarray, tried: int | None = None) -> np.ndarray:
        steps = self.tried if tried is None else self.tried[:tried]
        t = np.where(seen[:, self.column], w[:, self.column], self.start)
        open_rows = np.arange(len(w))
        for p in reversed(steps):
            if not len(open_rows):
                break
            den = seen[open_rows] @ (p * p)
            ok = den > _TINY
            hit = open_rows[ok]
            t[hit] = (w[hit] @ p) / den[ok]
            open_rows = open_rows[~ok]
        return t


def _deflate(w: np.ndarray, seen: np.ndarray, done: Sequence[_Component]) -> tuple[np.ndarray, list[np.ndarray]]:
    scores = []
    for comp in done:
        t = comp.scores(w, seen)
        w = w - np.outer(t, comp.tried[-1]) * seen
        scores.append(t)
    return w, scores


def _read(batch, center, divisor):
    x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(center))
    z = (x - center) / divisor
    seen = np.isfinite(z)
    return np.where(seen, z, 0.0), seen.astype(float)


def fit_pca_missing(df: DataFrame, features: Features, k: int, scaling: str = "standard") -> PCAModel:
    """Loadings and scores by least squares over the observed cells (Wold's NIPALS).

    Column statistics skip gaps; ratios are relative to the components extracted.
    Row stages need complete rows and are refused by having no place here.
    """
    m = width_of(df, features)
    names = (features,) if isinstance(features, str) else tuple(features)
    flat = element_columns(df, features, m)
    placed = flat.withColumn("_part", F.spark_partition_id())
    stats = placed.agg(
        F.count("*").alias("n"),
        F.approx_count_distinct("_part").alias("parts"),
        *[F.avg(c).alias(f"a_{c}") for c in flat.columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in flat.columns],
    ).first()
    n = int(stats["n"])
    if n < 2 or not 1 <= k <= min(n, m):
        raise ValueError(f"{k} components from {n} rows and {m} variables")
    mean = np.array([stats[f"a_{c}"] or 0.0 for c in flat.columns])
    sd = np.array([stats[f"s_{c}"] or 0.0 for c in flat.columns])
    if scaling == "robust":
        center, divisor = robust_stats(df, features, m)
    else:
        center, divisor = stage_numbers(mean, sd, scaling)
    rows = df.select(feature_array(df, features).alias("x"))
    slots = df.sparkSession.sparkContext.defaultParallelism
    if stats["parts"] < slots // 2:
        rows = rows.repartition(slots)  # one exchange for dozens of passes that would leave slots idle
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done, lam, rest = _components(rows, m, k, center, divisor, n)
        # Scoring needs the last vector only: a row that says nothing about a component gets its starting mean.
        done = [replace(c, tried=c.tried[-1:]) for c in done]
        p = np.array([c.tried[-1] for c in done]).T if done else np.zeros((m, 0))
        signed = fix_signs(p)
        flips = np.sign((signed * p).sum(axis=0))
        moments = _score_moments(rows, done, center, divisor, flips, n)
    finally:
        rows.unpersist()
    a = len(done)
    tail = np.full(m - a, rest / (n - 1) / (m - a)) if m > a else np.zeros(0)
    model = _model(
        df.sparkSession, "nipals-missing", names, m, n, scaling, center, divisor, RowStage(), lam, signed,
        np.concatenate([lam, tail]), None, None,
    )
    total = float(lam.sum())
    return replace(
        model, ratio=lam / total if total else lam, score_mean=moments[0], score_cov=moments[1], history=(done, flips)
    )


def _sums(rows: DataFrame, make, width: int) -> np.ndarray:
    """Add up one vector per task."""

    def partial(batches):
        total = np.zeros(width)
        for b in batches:
            total += make(b.column(0))
        yield pa.record_batch({"v": pa.array([total], pa.list_(pa.float64()))})

    got = rows.mapInArrow(partial, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    return np.array([r["v"] for r in got.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])


def _components(rows, m, k, center, divisor, n):
    done: list[_Component] = []
    lam: list[float] = []
    while True:
        # Column spread of what is left, the size of the last score, and what remains, in one pass.
        def spread(col, done=tuple(done)):
            w, seen = _read(col, center, divisor)
            w, scores = _deflate(w, seen, done)
            last = float((scores[-1] ** 2).sum()) if scores else 0.0
            return np.concatenate([seen.sum(0), w.sum(0), (w * w).sum(0), [last]])

        s = _sums(rows, spread, 3 * m + 1)
        cnt, tot, sq = np.maximum(s[:m], 1), s[m : 2 * m], s[2 * m : 3 * m]
        if done:
            lam.append(s[-1] / (n - 1))
        rest = float(sq.sum())
        var = sq / cnt - (tot / cnt) ** 2
        if len(done) == k or var.max() < FLAT:
            return done, np.array(lam), rest
        col = int(var.argmax())
        comp = _Component(col, float(tot[col] / cnt[col]))
        for _ in range(NIPALS_STEPS + 1):

            def step(col, comp=comp, done=tuple(done)):
                w, seen = _read(col, center, divisor)
                w, _scores = _deflate(w, seen, done)
                t = comp.scores(w, seen)
                old = comp.scores(w, seen, len(comp.tried) - 1) if comp.tried else t
                return np.concatenate([w.T @ t, seen.T @ (t * t), [((t - old) ** 2).sum()]])

            s = _sums(rows, step, 2 * m + 1)
            if comp.tried and np.sqrt(s[-1]) < 1e-8:
                break
            if len(comp.tried) == NIPALS_STEPS:
                raise RuntimeError(f"component {len(done) + 1}: no convergence in {NIPALS_STEPS} iterations")
            p = np.where(s[m : 2 * m] > _TINY, s[:m] / np.where(s[m : 2 * m] > _TINY, s[m : 2 * m], 1), 0.0)
            norm = np.linalg.norm(p)
            if norm < _TINY:
                raise RuntimeError(f"component {len(done) + 1}: nothing left to load on")
            comp.tried.append(p / norm)
        done.append(comp)


def _score_moments(rows, done, center, divisor, flips, n):
    k = len(done)
    if not k:
        return np.zeros(0), np.zeros((0, 0))

    def sums(col):
        w, seen = _read(col, center, divisor)
        _w, scores = _deflate(w, seen, done)
        t = np.column_stack(scores) * flips
        return np.concatenate([t.sum(0), (t.T @ t).ravel()])

    s = _sums(rows, sums, k + k * k)
    mean = s[:k] / n
    return mean, (s[k:].reshape(k, k) - n * np.outer(mean, mean)) / (n - 1)


def score_missing(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """Scores, T² and the squared residual over observed cells, for rows with or without gaps."""
    done, flips = model.history
    center, divisor, k = model.center, model.divisor, model.k
    rows = df.select(*keep, feature_array(df, model.source).alias("_x"))
    fields = [T.StructField(f"pc{j + 1}", T.DoubleType()) for j in range(k)]
    fields += [T.StructField("t2", T.DoubleType()), T.StructField("q", T.DoubleType())]
    schema = T.StructType(rows.select(*keep).schema.fields + fields)
    names, lam, kept = [f.name for f in schema.fields], np.maximum(model.eigenvalues, 1e-300), len(keep)

    def project(batches):
        for b in batches:
            w, seen = _read(b.column(kept), center, divisor)
            w, scores = _deflate(w, seen, done)
            t = np.column_stack(scores) * flips if k else np.zeros((len(w), 0))
            cols = [b.column(i) for i in range(kept)] + [pa.array(t[:, j]) for j in range(k)]
            cols += [pa.array((t**2 / lam).sum(axis=1)), pa.array((w * w).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(project, schema)
