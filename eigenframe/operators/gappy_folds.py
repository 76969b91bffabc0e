"""Cross-validation of regression on predictors with gaps, all folds in the same passes.

Least squares over observed cells has no moments of all rows to subtract, so every fold needs
a fit of its own. Among rows with the same gaps, though, a score is an affine function of the
cells, whatever was tried before, so the sums that a step needs follow from the moments of
each kind of row and fold: one scan, and steps on small matrices. Where kinds of rows are
too many for that, the fits share their scans: each pass gathers, for every fold, the sums its
next step needs over the rows it learns from, and a fold that has settled drops out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.operators.gappy import _TINY, _Component, _deflate
from eigenframe.operators.rowstage import MAD_SCALE, stage_numbers
from eigenframe.plans.dense import FLAT, NIPALS_STEPS, floor_at_one, nested_fits
from eigenframe.plans.durable import stored
from eigenframe.plans.fold_ranks import values_at
from eigenframe.plans.gram import feature_array
from eigenframe.plans.products import Rows

AT_ONCE = 200  # fits that share their passes; more go in turns
MOMENT_CELLS = 1_000_000  # moments of all kinds of rows and folds that may be held at once
MOMENT_FOLDS = 1000


@dataclass
class _Fit:
    """One fold held out: its scale, the components found, and the one it works on."""

    key: tuple[int, int]
    center: np.ndarray
    divisor: np.ndarray
    done: list[_Component] = field(default_factory=list)
    now: _Component | None = None
    over: bool = False

    def read(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        z = (x - self.center) / self.divisor
        seen = np.isfinite(z)
        w, scores = _deflate(np.where(seen, z, 0.0), seen.astype(float), self.done)
        return w, seen.astype(float), scores

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What the next step needs of these rows: spread of the columns, or the products with the scores."""
        w, seen, _ = self.read(x)
        if self.now is None:
            return np.concatenate([seen.sum(0), w.sum(0), (w * w).sum(0)])
        t = self.now.scores(w, seen)
        old = self.now.scores(w, seen, len(self.now.tried) - 1) if self.now.tried else t
        return np.concatenate([w.T @ t, seen.T @ (t * t), np.append(((t - old) ** 2).sum(), np.zeros(len(self.center) - 1))])

    def advance(self, s: np.ndarray, k: int) -> None:
        m = len(self.center)
        a, b, c = s[:m], s[m : 2 * m], s[2 * m :]
        if self.now is None:
            count = np.maximum(a, 1)
            var = c / count - (b / count) ** 2
            col = int(var.argmax())
            self.over = var[col] < FLAT
            if not self.over:
                self.now = _Component(col, float(b[col] / count[col]))
        elif self.now.tried and np.sqrt(c[0]) < 1e-8:
            self.done.append(self.now)
            self.now, self.over = None, len(self.done) == k
        elif len(self.now.tried) == NIPALS_STEPS:
            raise RuntimeError(f"fold {self.key}, component {len(self.done) + 1}: no convergence in {NIPALS_STEPS} iterations")
        else:
            p = np.where(b > _TINY, a / np.where(b > _TINY, b, 1), 0.0)
            norm = np.linalg.norm(p)
            if norm < _TINY:
                raise RuntimeError(f"fold {self.key}, component {len(self.done) + 1}: nothing left to load on")
            self.now.tried.append(p / norm)


class _Kind:
    """Rows with the same gaps: their moments of [1, z…, y] for one fit, and what a score is of [1, z…]."""

    def __init__(self, seen: np.ndarray, pool: np.ndarray):
        self.seen, self.pool = seen.astype(float), pool
        m = len(seen)
        self.left = np.zeros((m + 1, m))  # the deflated cells as functions of [1, z…]
        self.left[np.arange(1, m + 1), np.arange(m)] = self.seen

    def score(self, comp: _Component, tried: int | None = None) -> np.ndarray:
        steps = comp.tried if tried is None else comp.tried[:tried]
        for p in reversed(steps):
            den = self.seen @ (p * p)
            if den > _TINY:
                return self.left @ p / den
        if self.seen[comp.column]:
            return self.left[:, comp.column]
        return np.append(comp.start, np.zeros(len(self.seen)))

    def deflate(self, comp: _Component) -> np.ndarray:
        t = self.score(comp)
        self.left = self.left - np.outer(t, comp.tried[-1]) * self.seen
        return t

    def sums(self, now: _Component | None) -> np.ndarray:
        """As :meth:`_Fit.sums`, from moments."""
        g, w = self.pool, self.left
        if now is None:
            return np.concatenate([self.seen * g[0, 0], g[0] @ w, ((g @ w) * w).sum(0)])
        t = self.score(now)
        gap = t - self.score(now, len(now.tried) - 1) if now.tried else t * 0
        m = len(self.seen)
        return np.concatenate([w.T @ g @ t, self.seen * (t @ g @ t), np.append(max(gap @ g @ gap, 0.0), np.zeros(m - 1))])


def _scaled(g: np.ndarray, center: np.ndarray, divisor: np.ndarray) -> np.ndarray:
    """Moments of [1, x…, (y)] as those of [1, (x - center) / divisor…, (y)]."""
    m = len(center)
    turn = np.eye(len(g))
    turn[np.arange(1, m + 1), np.arange(1, m + 1)] = 1 / divisor
    turn[1 : m + 1, 0] = -center / divisor
    return turn @ g @ turn.T


def _moments(df: DataFrame, values: Column, width: int, shift: np.ndarray) -> dict[tuple[int, int, bytes], np.ndarray]:
    """Per (repeat, fold, gaps) the moments of [1, x…], then of [1, x…, y] over labelled rows, x and y less ``shift``; NULL cells count as 0."""
    m = width

    def run(batches):
        total: dict[tuple[int, int, bytes], np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) - shift[:m]
            y = batch.column(1).to_numpy(zero_copy_only=False) - shift[m]
            seen, lab = np.isfinite(x), np.isfinite(y)
            z = np.column_stack([np.ones(len(x)), np.where(seen, x, 0.0), np.where(lab, y, 0.0)])
            kinds, kind = np.unique(np.packbits(seen, axis=1), axis=0, return_inverse=True)
            code = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy(), kind.ravel()])
            keys, at = np.unique(code, axis=1, return_inverse=True)
            order = np.argsort(at.ravel(), kind="stable")
            cuts = np.searchsorted(at.ravel()[order], np.arange(1, keys.shape[1]))
            for (repeat, fold, k), own in zip(keys.T.tolist(), np.split(order, cuts)):
                a, b = z[own][:, : m + 1], z[own[lab[own]]]
                g = np.concatenate([(a.T @ a).ravel(), (b.T @ b).ravel()])
                key = (repeat, fold, kinds[k].tobytes())
                total[key] = total[key] + g if key in total else g
        names = ["repeat", "fold", "gaps", "v"]
        yield pa.record_batch([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([k[2] for k in total], pa.binary()),
                               pa.array(list(total.values()), pa.list_(pa.float64()))], names=names)

    parts = df.select(values.alias("x"), "_y", *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("repeat", "fold")])
    cells = parts.mapInArrow(run, "repeat int, fold int, gaps binary, v array<double>").select("repeat", "fold", "gaps", F.posexplode("v").alias("i", "v"))
    out: dict[tuple[int, int, bytes], np.ndarray] = {}
    size = (m + 1) ** 2 + (m + 2) ** 2
    for r in cells.groupBy("repeat", "fold", "gaps", "i").agg(F.sum("v").alias("v")).toLocalIterator():
        out.setdefault((r["repeat"], r["fold"], bytes(r["gaps"])), np.zeros(size))[r["i"]] = r["v"]
    return out


def _by_moments(
    df: DataFrame, held: DataFrame, features: Sequence[str], kinds: Sequence[bytes], cv, limit: int, scaling: str, learns, shift: np.ndarray
) -> DataFrame:
    """The predictions from one scan for moments and one expression over the rows held out."""
    m, forward = len(features), cv.scheme == "forward"
    found = _moments(df, feature_array(df, features), m, shift)
    sizes: dict[tuple[int, int], int] = {}
    for (repeat, fold, _), g in found.items():
        sizes[repeat, fold] = sizes.get((repeat, fold), 0) + round(g[0])
    masks = {k: np.unpackbits(np.frombuffer(k, np.uint8))[:m].astype(bool) for k in kinds}
    rows = []
    by_repeat: dict[int, list] = {}
    for (repeat, fold, kind), g in found.items():
        by_repeat.setdefault(-1 if fold == -1 else repeat, []).append((fold, kind, g))
    for key in _held_out(sizes, cv):
        pools: dict[bytes, np.ndarray] = {}
        for fold, kind, g in [*by_repeat.get(-1, ()), *by_repeat[key[0]]]:
            if fold == -1 or learns(key[1], np.array(fold)):
                pools[kind] = pools[kind] + g if kind in pools else g
        first = (m + 1) ** 2
        total = [(masks[k], g[:first].reshape(m + 1, m + 1), g[first:].reshape(m + 2, m + 2)) for k, g in sorted(pools.items())]
        count = np.maximum(sum(seen * a[0, 0] for seen, a, _ in total), 1)
        mean = sum(a[0, 1:] for _, a, _ in total) / count
        square = sum(np.diag(_scaled(a, np.where(seen, mean, 0.0), np.ones(m)))[1:] * seen for seen, a, _ in total)
        sd = np.sqrt(np.maximum(square, 0.0) / np.maximum(count - 1, 1))
        center, divisor = map(np.asarray, stage_numbers(mean + shift[:m], sd, scaling))
        center = center - shift[:m]
        fit = _Fit(key, center, divisor)
        each = [_Kind(seen, _scaled(a, np.where(seen, center, 0.0), divisor)) for seen, a, _ in total]
        while not fit.over:
            done = len(fit.done)
            fit.advance(sum(kind.sums(fit.now) for kind in each), limit)
            if len(fit.done) > done and not fit.over:
                for kind in each:
                    kind.deflate(fit.done[-1])
        k = len(fit.done)
        g = np.zeros((k + 2, k + 2))
        for seen, _, b in total:
            t = _score_rows(fit, seen)
            take = np.zeros((k + 2, m + 2))
            take[0, 0] = take[-1, -1] = 1.0
            take[1:-1, : m + 1] = t
            g += take @ _scaled(b, np.where(seen, center, 0.0), divisor) @ take.T
        n, mu = g[0, 0], g[0, 1:] / g[0, 0]
        scatter = g[1:, 1:] - n * np.outer(mu, mu)
        gammas = nested_fits(scatter[:k, :k], scatter[:k, -1], mu[:k], mu[-1] + shift[m], k)
        for kind in kinds:
            # In the units of the table: a row of coefficients for each component count, those of absent cells 0.
            t = _score_rows(fit, masks[kind])
            betas = []
            for gamma in gammas:
                b = gamma[1:] @ t[: len(gamma) - 1]
                slope = np.where(masks[kind], b[1:] / divisor, 0.0)
                betas.append([float(gamma[0] + b[0] - slope @ (center + shift[:m])), *slope.tolist()])
            rows.append((*key, "".join("1" if s else "0" for s in masks[kind]), betas))
    spark = df.sparkSession
    solved = F.broadcast(spark.createDataFrame(rows, "repeat int, fold int, _gaps string, _betas array<array<double>>"))
    held = held.withColumn("_gaps", _gaps(features))

    def predicted(b):
        out = F.element_at(b, 1)
        for i, c in enumerate(features):
            out = out + F.element_at(b, i + 2) * F.when(_known(c), F.col(f"`{c}`").cast("double")).otherwise(0.0)
        return out

    return held.join(solved, ["repeat", "fold", "_gaps"]).select(
        *dict.fromkeys(cv.order_by), F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"), "_y", F.transform("_betas", predicted).alias("predictions")
    )


def _score_rows(fit: _Fit, seen: np.ndarray) -> np.ndarray:
    """Scores of rows with these gaps as functions of [1, z…], a row per component."""
    kind = _Kind(seen, np.zeros((1, 1)))
    return np.array([kind.deflate(c) for c in fit.done]).reshape(-1, len(seen) + 1)


def _known(c: str) -> Column:
    v = F.col(f"`{c}`").cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _gaps(features: Sequence[str]) -> Column:
    """Which features a row has, as a string of 0 and 1."""
    return F.concat(*[F.when(_known(c), "1").otherwise("0") for c in features])


def _held_out(sizes: dict[tuple[int, int], int], cv) -> list[tuple[int, int]]:
    """(repeat, fold) of the fits."""
    forward = cv.scheme == "forward"
    keys = sorted(k for k in sizes if k[1] >= (1 if forward else 0))
    if forward and cv.min_train:
        keys = [k for k in keys if sum(n for o, n in sizes.items() if o[0] == k[0] and 0 <= o[1] < k[1]) >= cv.min_train]
    if not keys:
        raise ValueError("no usable folds")
    return keys


def _summed(rows: Rows, fits: Sequence[_Fit], make, width: int) -> np.ndarray:
    """Sums of one vector per fit over the rows it learns from; one row per cell reaches the driver."""
    layout, zero = rows.layout, np.zeros(rows.width)

    def run(batches):
        total = np.zeros((len(fits), width))
        for x, repeat, fold, piece in layout.blocks(batches, zero):
            for i, fit in enumerate(fits):
                own = layout.takes_part(fit.key, repeat, fold)
                if own.any():
                    total[i] += make(fit, x, own, piece)
        yield pa.record_batch({"v": pa.array([total.ravel()], pa.list_(pa.float64()))})

    cells = rows.df.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    got = cells.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in got]).reshape(len(fits), width)


def _scales(rows: Rows, keys: Sequence[tuple[int, int]], scaling: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centre and divisor of the rows each fold learns from, gaps skipped."""
    m = rows.width
    blank = [_Fit(k, np.zeros(m), np.ones(m)) for k in keys]
    first = _summed(rows, blank, lambda fit, x, own, _: np.concatenate([np.isfinite(x[own]).sum(0), np.nansum(x[own], axis=0)]), 2 * m)
    count = np.maximum(first[:, :m], 1)
    mean = first[:, m:] / count
    if scaling == "robust":
        ranks = np.maximum(-(-first[:, :m] // 2) - 1, 0)
        median = values_at(rows, keys, ranks)
        return list(zip(median, floor_at_one(MAD_SCALE * values_at(rows, keys, ranks, median))))
    about = [_Fit(k, c, np.ones(m)) for k, c in zip(keys, mean)]
    square = _summed(rows, about, lambda fit, x, own, _: np.nansum((x[own] - fit.center) ** 2, axis=0), m)
    sd = np.sqrt(square / np.maximum(count - 1, 1))
    return [tuple(map(np.asarray, stage_numbers(a, b, scaling))) for a, b in zip(mean, sd)]


def cross_validate(base: DataFrame, held: DataFrame, features: Sequence[str], cv, limit: int, scaling: str) -> DataFrame:
    """(order columns, repeat, fold, _y, predictions) of the rows held out, a prediction for each component count."""
    carry = list(dict.fromkeys(cv.order_by))
    spare = base.filter("_y is null").withColumns({c: F.lit(None).cast("int") for c in ("repeat", "fold")})
    df = held.unionByName(spare, allowMissingColumns=True)
    forward = cv.scheme == "forward"
    learns = (lambda held_out, fold: (fold >= 0) & (fold < held_out)) if forward else (lambda held_out, fold: fold != held_out)
    extra = [F.col("_y"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]]
    if scaling != "robust" and 0 < cv.folds * cv.repeats <= MOMENT_FOLDS:
        shift, kinds = _kinds(base, features)
        if len(kinds) * (cv.folds + 1) * cv.repeats * (len(features) + 2) ** 2 <= MOMENT_CELLS:
            return _by_moments(df, held, features, kinds, cv, limit, scaling, learns, shift)
    rows = Rows(df, feature_array(df, features), len(features), extra, ("repeat", "fold"), learns)
    rows.df = stored(rows.df, "rows")
    sizes = {(r["repeat"], r["fold"]): r["count"] for r in rows.df.groupBy("repeat", "fold").count().collect()}
    keys = _held_out(sizes, cv)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [_predicted(rows, keys[i : i + AT_ONCE], limit, scaling, carry, types) for i in range(0, len(keys), AT_ONCE)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _kinds(base: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, list[bytes]]:
    """A centre of the features and the response, and the gaps that rows have (one too many of them at most)."""
    means = base.agg(*[F.avg(F.when(_known(c), F.col(f"`{c}`").cast("double"))).alias(f"a{i}") for i, c in enumerate(features)], F.avg("_y").alias("y")).first()
    seen = base.select(_gaps(features).alias("gaps")).distinct().limit(MOMENT_CELLS // (len(features) + 2) ** 2 + 1).collect()
    masks = [np.packbits(np.array([s == "1" for s in r["gaps"]])).tobytes() for r in seen]
    return np.nan_to_num(np.array([v or 0.0 for v in means], dtype=float), posinf=0.0, neginf=0.0), sorted(masks)


def _predicted(rows: Rows, keys: Sequence[tuple[int, int]], limit: int, scaling: str, carry: list[str], types: dict) -> DataFrame:
    layout, zero = rows.layout, np.zeros(rows.width)
    fits = [_Fit(k, c, d) for k, (c, d) in zip(keys, _scales(rows, keys, scaling))]
    while active := [f for f in fits if not f.over]:
        sums = _summed(rows, active, lambda fit, x, own, _: fit.sums(x[own]), 3 * rows.width)
        for fit, s in zip(active, sums):
            fit.advance(s, limit)

    def gram(fit: _Fit, x: np.ndarray, own: np.ndarray, piece: pa.RecordBatch) -> np.ndarray:
        y = piece.column(3).to_numpy(zero_copy_only=False)
        own = own & np.isfinite(y)
        scores = fit.read(x[own])[2]
        z = np.column_stack([np.ones(own.sum()), *scores, *[np.zeros(own.sum())] * (limit - len(scores)), y[own]])
        return (z.T @ z).ravel()

    paths = {}
    for fit, s in zip(fits, _summed(rows, fits, gram, (limit + 2) ** 2)):
        g, k = s.reshape(limit + 2, limit + 2), len(fit.done)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        scatter = g[1:, 1:] - n * np.outer(mean, mean)
        paths[fit.key] = (fit, nested_fits(scatter[:k, :k], scatter[:k, -1], mean[:k], mean[-1], k))

    def run(batches):
        for x, repeat, fold, piece in layout.blocks(batches, zero):
            for key in {*zip(repeat.tolist(), fold.tolist())} & paths.keys():
                own = np.flatnonzero((repeat == key[0]) & (fold == key[1]))
                fit, gammas = paths[key]
                t = np.column_stack([np.ones(len(own)), *fit.read(x[own])[2]])
                values = np.column_stack([t[:, : len(g)] @ g for g in gammas])
                kept = piece.take(pa.array(own))
                yield pa.record_batch(
                    [*kept.columns[4:], *kept.columns[1:4], pa.array(list(values), pa.list_(pa.float64()))], names=[*carry, "repeat", "fold", "_y", "predictions"]
                )

    schema = T.StructType([T.StructField(c, types[c]) for c in carry])
    for name, kind in (("repeat", T.IntegerType()), ("fold", T.IntegerType()), ("_y", T.DoubleType()), ("predictions", T.ArrayType(T.DoubleType()))):
        schema = schema.add(name, kind)
    return rows.df.mapInArrow(run, schema)
