"""Kernel principal components.

Tables use landmarks (Williams & Seeger 2001), chosen by number and the same at
every size: each row is mapped onto the kernel of a bounded set and the rest is
ordinary distributed PCA. With as many landmarks as rows the result is exact. A
fit without landmarks decomposes the whole kernel, and is an error beyond the few
rows for which that is meant.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.operators.pca import _complete
from eigenframe.operators.rowstage import Features, RowStage, apply_row_stage
from eigenframe.plans.dense import fix_signs
from eigenframe.plans.gram import feature_array, moments, pieces, width_of

EXACT_ROWS = 1_500  # rows whose whole kernel is decomposed
MAX_LANDMARKS = 10_000
SHOW_ROWS = 1_000  # rows of a kernel matrix written out
BROADCAST_CELLS = 50_000_000


@dataclass(frozen=True)
class KernelParams:
    kind: str = "rbf"  # rbf, linear, poly
    gamma: float = 0.0  # 0 means 1 / number of variables
    degree: int = 3
    coef0: float = 1.0

    def resolved(self, m: int) -> KernelParams:
        if self.kind not in ("rbf", "linear", "poly"):
            raise ValueError(f"unknown kernel {self.kind!r}")
        return KernelParams(self.kind, self.gamma or 1.0 / m, self.degree, self.coef0)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = a @ b.T
        if self.kind == "linear":
            return dot
        if self.kind == "poly":
            return (self.gamma * dot + self.coef0) ** self.degree
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * dot
        return np.exp(-self.gamma * np.maximum(d2, 0.0))


@dataclass(frozen=True)
class KernelModel:
    params: KernelParams
    features: tuple[str, ...]
    row_stage: RowStage
    divisor: np.ndarray
    k: int
    n: int
    eigenvalues: np.ndarray
    ratio: np.ndarray
    base: np.ndarray  # training rows, or landmarks
    lift: np.ndarray  # kernel row -> feature row; identity for exact models
    shift: np.ndarray  # subtracted from the lifted row
    weights: np.ndarray  # lifted, shifted row -> scores
    row_mean: bool  # exact models also subtract the mean of each kernel row
    grand: float
    approximate: bool

    @property
    def source(self) -> Features:
        return self.features[0] if len(self.features) == 1 else list(self.features)


def _rows(df: DataFrame, features: Features, stage: RowStage) -> DataFrame:
    if stage.active:
        return apply_row_stage(df, features, stage, "_kx")
    return df.withColumn("_kx", feature_array(df, features))


def _batch(b, divisor):
    return b.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(divisor)) / divisor


def fit_kernel_pca(
    df: DataFrame,
    features: Features,
    k: int,
    params: KernelParams | None = None,
    id_col: str = "id",
    scale: bool = False,
    row_stage: RowStage | None = None,
    landmarks: int | None = None,
) -> KernelModel:
    """On ``landmarks`` rows if given, however many rows there are; else exact, for ``EXACT_ROWS`` rows at most.

    Centring happens in the kernel, so the only column stage is ``scale``. Missing cells fail the fit.
    """
    stage = row_stage or RowStage()
    m = width_of(df, features)
    p = (params or KernelParams()).resolved(m)
    names = (features,) if isinstance(features, str) else tuple(features)
    rows = _complete(_rows(df, features, stage).select(F.col(id_col).alias("_id"), "_kx"), "_kx")
    n = rows.count()
    if n < 2 or not 1 <= k <= n:
        raise ValueError(f"{k} components from {n} rows")
    divisor = np.ones(m)
    if scale:
        sd = moments(rows, "_kx").sd
        divisor = np.where(sd < 1e-8, 1.0, sd)
    if landmarks is not None:
        if not 1 <= landmarks <= MAX_LANDMARKS:
            raise ValueError(f"between 1 and {MAX_LANDMARKS} landmarks")
        return _with_landmarks(rows, names, stage, p, divisor, k, n, landmarks)
    if n > EXACT_ROWS:
        raise ValueError(f"{n} rows exceed the {EXACT_ROWS} of an exact kernel: give a number of landmarks")
    base = np.array([r["_kx"] for r in rows.orderBy("_id").select("_kx").collect()]) / divisor
    full = p.matrix(base, base)
    mean = full.mean(axis=0)
    centred = full - mean - mean[:, None] + mean.mean()
    lam, v = np.linalg.eigh((centred + centred.T) / 2)
    total = float(np.maximum(lam, 0.0).sum())
    lam, v = lam[::-1][:k], fix_signs(v[:, ::-1][:, :k])
    kept = np.maximum(lam, 0.0)
    kept[kept < 1e-10] = 0.0
    weights = v / np.sqrt(np.where(kept > 0, kept, np.inf))
    return KernelModel(
        p, names, stage, divisor, k, n, kept, kept / total if total > 0 else kept * 0, base, np.zeros((0, 0)), mean, weights,
        True, float(mean.mean()), False,
    )


def _with_landmarks(rows, names, stage, p, divisor, k, n, count):
    m = len(divisor)
    if count * m > BROADCAST_CELLS:
        raise ValueError("too many landmarks to broadcast")
    picked = rows.orderBy(F.xxhash64("_id"), "_id").limit(count).collect()
    base = np.array([r["_kx"] for r in picked]) / divisor
    w, u = np.linalg.eigh(p.matrix(base, base))
    good = w > 1e-10 * w[-1]
    lift = u[:, good] / np.sqrt(w[good])
    mapped = _lifted(rows, p, base, lift, divisor)
    mom = moments(mapped, "z")
    lam, vec = np.linalg.eigh(mom.scatter)
    lam, vec = np.maximum(lam[::-1], 0.0), fix_signs(vec[:, ::-1])
    k = min(k, len(lam))
    total = float(lam.sum())
    return KernelModel(
        p, names, stage, divisor, k, n, lam[:k], lam[:k] / total if total else lam[:k], base, lift, mom.mean, vec[:, :k],
        False, 0.0, count < n,
    )


def _lifted(rows, p, base, lift, divisor):
    held = rows.sparkSession.sparkContext.broadcast((base, lift))

    def up(batches):
        b0, l0 = held.value
        for b in pieces(batches, sum(b0.shape)):
            z = p.matrix(_batch(b.column(0), divisor), b0) @ l0
            yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.list_(pa.float64()))], names=["z"])

    return rows.select("_kx").mapInArrow(up, "z array<double>")


def score_kernel(df: DataFrame, model: KernelModel, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of new (or training) rows: a narrow plan with the training rows broadcast."""
    rows = _rows(df, model.source, model.row_stage).select(*keep, "_kx")
    fields = [T.StructField(f"pc{j + 1}", T.DoubleType()) for j in range(model.k)]
    schema = T.StructType(rows.select(*keep).schema.fields + fields)
    names, at, p, divisor = [f.name for f in schema.fields], len(keep), model.params, model.divisor
    held = df.sparkSession.sparkContext.broadcast((model.base, model.lift, model.shift, model.weights))
    row_mean, grand, k = model.row_mean, model.grand, model.k

    def project(batches):
        base, lift, shift, weights = held.value
        for b in pieces(batches, sum(base.shape)):
            z = p.matrix(_batch(b.column(at), divisor), base)
            if row_mean:
                z = z - shift - z.mean(axis=1, keepdims=True) + grand
            else:
                z = z @ lift - shift
            t = z @ weights
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(at)] + [pa.array(t[:, j]) for j in range(k)], names=names
            )

    return rows.mapInArrow(project, schema)


def kernel_matrix(df: DataFrame, features: Features, params: KernelParams | None, id_col: str) -> DataFrame:
    """The doubly centred kernel as ``(i, j, value)``; only for tables small enough to look at."""
    m = width_of(df, features)
    p = (params or KernelParams()).resolved(m)
    rows = _rows(df, features, RowStage()).select(F.col(id_col).alias("_id"), "_kx")
    picked = rows.orderBy("_id").limit(SHOW_ROWS + 1).collect()
    if len(picked) > SHOW_ROWS:
        raise ValueError(f"a kernel matrix is written for at most {SHOW_ROWS} rows")
    ids, base = [r["_id"] for r in picked], np.array([r["_kx"] for r in picked])
    mean = p.matrix(base, base).mean(axis=0)
    held = df.sparkSession.sparkContext.broadcast((ids, base, mean))
    one = np.ones(m)

    def block(batches):
        names, b0, mu = held.value
        for b in batches:
            z = p.matrix(_batch(b.column(1), one), b0)
            z = z - mu - z.mean(axis=1, keepdims=True) + mu.mean()
            kind, left = b.column(0).type, b.column(0).to_pylist()
            i, j = [v for v in left for _ in names], names * len(left)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, kind), pa.array(j, kind), pa.array(z.ravel())], names=["i", "j", "value"]
            )

    kind = rows.schema["_id"].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("value", T.DoubleType())])
    return rows.mapInArrow(block, schema)
