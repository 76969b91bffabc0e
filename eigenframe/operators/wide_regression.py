"""Principal-component regression with more predictors than a square matrix allows.

Components come from products of the rows with a few vectors (see
:mod:`eigenframe.plans.products`); all folds of a cross-validation advance in the same
scans, each leaving its own rows out. One more scan gathers the moments of the scores
and the response per fold, another predicts the rows held out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.operators import pca
from eigenframe.operators.pca import PCAModel, Regression, Whole, _fit_very_wide, wide_problem
from eigenframe.operators.rowstage import Features, RowStage, stage_numbers
from eigenframe.plans.dense import fix_signs, nested_fits
from eigenframe.plans.durable import discard
from eigenframe.plans.gram import feature_array
from eigenframe.plans.products import Problem, Rows, leading, scans, tree_sum

HELD_CELLS = 32_000_000  # cells of the vectors of all folds that go through a scan together


@dataclass(frozen=True)
class Validated:
    """What a cross-validation leaves to the final fit: the packed rows, each once, and what its scans found of all of them."""

    rows: Rows
    whole: Whole | None = None
    gram: np.ndarray | None = None  # of (1, scores, y - y0) of the labelled rows


def score_moments(rows: Rows, shift: np.ndarray, y0: float, problems: Sequence[Problem], vectors: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Gram matrix of (1, scores, y - y0) over the labelled rows each problem learns from."""
    layout, at = rows.layout, np.cumsum([0, *[(v.shape[1] + 2) ** 2 for v in vectors]])
    wide = np.concatenate([v / p.divisor[:, None] for p, v in zip(problems, vectors)], axis=1)
    ends = np.cumsum([v.shape[1] for v in vectors])
    offset = np.concatenate([(shift - p.center) @ wide[:, e - v.shape[1] : e] for p, v, e in zip(problems, vectors, ends)])
    places = [(p.key, e - v.shape[1], e) for p, v, e in zip(problems, vectors, ends)]

    def run(batches):
        total = np.zeros(at[-1])
        for x, repeat, fold, piece in layout.blocks(batches, shift, wide.shape[1]):
            y, scores = piece.column(3).to_numpy(zero_copy_only=False), x @ wide + offset
            for i, (key, a, b) in enumerate(places):
                own = layout.takes_part(key, repeat, fold) & np.isfinite(y)
                z = np.column_stack([np.ones(own.sum()), scores[own, a:b], y[own] - y0])
                total[at[i] : at[i + 1]] += (z.T @ z).ravel()
        yield pa.record_batch({"part": pa.array([0], pa.int32()), "r": pa.array([total], pa.list_(pa.float64()))})

    with scans(rows.df.sparkSession, rows.width):
        got = np.array(tree_sum(rows.df.mapInArrow(run, "part int, r array<double>"), ["part"]).first()["r"])
    return [got[a:b].reshape(v.shape[1] + 2, -1) for a, b, v in zip(at, at[1:], vectors)]


def paths(gram: np.ndarray, y0: float, k: int) -> list[np.ndarray]:
    """Least squares on the first 0…k scores, intercept first."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    scatter = gram[1:, 1:] - n * np.outer(mean, mean)
    return nested_fits(scatter[:-1, :-1], scatter[:-1, -1], mean[:-1], mean[-1] + y0, k)


def fold_problems(rows: Rows, shift: np.ndarray, sums: dict, cv, scaling: str) -> list[Problem]:
    """One problem for each fold held out, with the scale of the rows it learns from."""
    out = []
    for key in sorted(k for k in sums if k[1] >= 0):
        mine = {k: v for k, v in sums.items() if k[1] == -1 or (k[0] == key[0] and rows.layout.learns(key[1], np.array(k[1])))}
        labelled = sum(v[0] for k, v in mine.items() if k[1] >= 0)
        n = sum(v[0] for v in mine.values())
        if labelled < max(2, cv.min_train if cv.scheme == "forward" else 0) or (cv.scheme == "forward" and key[1] == 0):
            continue
        off = sum(v[1] for v in mine.values()) / n
        sd = np.sqrt(np.maximum(sum(v[2] for v in mine.values()) - n * off**2, 0.0) / (n - 1))
        out.append(Problem(key, n, *map(np.asarray, stage_numbers(shift + off, sd, scaling))))
    return out


def cross_validate(
    base: DataFrame, held: DataFrame, source: Features, m: int, cv, limit: int, scaling: str, y0: float
) -> tuple[DataFrame, Validated]:
    """(order columns, repeat, fold, _y, predictions) of the rows held out, a prediction for each component count.

    Of one repeat, the fit to all rows is a problem like that of any fold and goes through the same scans.
    """
    carry = list(dict.fromkeys(cv.order_by))
    spare = base.filter("_y is null").withColumns({c: F.lit(None).cast("int") for c in ("repeat", "fold")})
    df = held.unionByName(spare, allowMissingColumns=True)
    forward = cv.scheme == "forward"
    learns = (lambda held_out, fold: (fold >= 0) & (fold < held_out)) if forward else (lambda held_out, fold: fold != held_out)
    rows = Rows(df, feature_array(df, source), m, [F.col("_y"), *[F.col(c) for c in carry]], ("repeat", "fold"), learns)
    folds = cv.repeats * (cv.folds + 2) if cv.folds else m
    rows = rows.packed(limit, folds)  # read by every scan that follows, the last of them the caller's
    shift, sums = rows.centred_sums()
    problems = fold_problems(rows, shift, sums, cv, scaling)
    if not problems:
        raise ValueError("no fold has rows enough to learn from")
    once = cv.repeats == 1 and sum(v[0] for v in sums.values()) > pca.MAX_WIDTH
    whole = wide_problem(shift, sums, m, limit, scaling) if once else None
    at_once = max(1, HELD_CELLS // (m * (limit + 4)))
    out, kept = [], Validated(rows if cv.repeats == 1 else rows.first_repeat())
    for i in range(0, len(problems), at_once):
        predicted, of_all = _predicted(rows, shift, y0, problems[i : i + at_once], limit, df, carry, None if i else whole)
        out.append(predicted)
        kept = of_all or kept
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0], kept


def _predicted(
    rows: Rows, shift: np.ndarray, y0: float, problems: Sequence[Problem], limit: int, df: DataFrame, carry: list[str], whole: Whole | None
) -> tuple[DataFrame, Validated | None]:
    problems = [*problems, *([whole.problem] if whole else [])]
    layout, found = rows.layout, leading(rows, shift, problems, limit)
    if whole:
        found[-1] = replace(found[-1], vectors=fix_signs(found[-1].vectors))
    vectors = [f.vectors[:, : max(1, int((f.eigenvalues > 1e-12 * f.eigenvalues[0]).sum()))] for f in found]
    grams, of_all = score_moments(rows, shift, y0, problems, vectors), None
    if whole:
        of_all = Validated(rows, replace(whole, found=found[-1]), grams[-1])
        problems, vectors, grams = problems[:-1], vectors[:-1], grams[:-1]
    fits = [paths(g, y0, g.shape[0] - 2) for g in grams]
    solved = {}
    for p, v, gammas in zip(problems, vectors, fits):
        path = np.zeros((v.shape[1], len(gammas)))
        for k, g in enumerate(gammas):
            path[:k, k] = g[1:]
        w = v / p.divisor[:, None]
        solved[p.key] = (w, (shift - p.center) @ w, path, np.array([g[0] for g in gammas]))
    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([types[c] for c in carry]).add("repeat", T.IntegerType()).add("fold", T.IntegerType()).add("_y", T.DoubleType())
    schema = schema.add("predictions", T.ArrayType(T.DoubleType()))

    def run(batches):
        for x, repeat, fold, piece in layout.blocks(batches, shift):
            rows, counts, values = [], [], []
            for key in {*zip(repeat.tolist(), fold.tolist())} & solved.keys():
                own = np.flatnonzero((repeat == key[0]) & (fold == key[1]))
                w, offset, path, first = solved[key]
                rows.append(own)
                counts.append(np.full(len(own), len(first)))
                values.append(((x[own] @ w + offset) @ path + first).ravel())
            if rows:
                kept, ends = piece.take(pa.array(np.concatenate(rows))), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(values))
                yield pa.record_batch([*kept.columns[4:], *kept.columns[1:4], lists], names=[*carry, "repeat", "fold", "_y", "predictions"])

    return rows.df.mapInArrow(run, schema), of_all


def final(
    base: DataFrame, source: Features, names: tuple[str, ...], y: str, m: int, k: int, scaling: str, stage: RowStage, y0: float,
    kept: Validated | None = None,
) -> PCAModel:
    """Components of all rows, and least squares of the labelled ones on the scores; ``kept``: what a cross-validation left."""
    rows = kept.rows if kept else Rows(base, feature_array(base, source), m, [F.col("_y")]).packed(k)
    whole = kept.whole if kept and kept.whole else wide_problem(*rows.centred_sums(), m, k, scaling)
    model = _fit_very_wide(base, source, names, m, k, scaling, stage, rows, whole)
    problem = Problem(None, model.n, model.center, model.divisor)
    used = max(1, int((model.eigenvalues > 1e-12 * model.eigenvalues[0]).sum()))
    if kept and kept.gram is not None:
        own = [*range(used + 1), len(kept.gram) - 1]
        gram = kept.gram[np.ix_(own, own)]
    else:
        gram = score_moments(rows, whole.shift, y0, [problem], [model.loadings[:, :used]])[0]
    gammas = paths(gram, y0, used)
    if len(gammas) - 1 < k:  # the rows do not support more components
        model = _fit_very_wide(base, source, names, m, max(1, len(gammas) - 1), scaling, stage, rows, whole)
    if not kept:
        discard(rows.df)
    gamma = gammas[-1]
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    scatter = gram[1:, 1:] - n * np.outer(mean, mean)
    own = [*range(len(gamma) - 1), len(scatter) - 1]
    g = np.concatenate([-gamma[1:], [1.0]])
    sse, tss = float(g @ scatter[np.ix_(own, own)] @ g), float(scatter[-1, -1])
    beta = model.loadings[:, : len(gamma) - 1] @ gamma[1:] / model.divisor
    original = beta @ stage.matrix(m) if stage.active and stage.linear else beta
    return replace(
        model,
        regression=Regression(
            response=y, k=len(gamma) - 1, gamma=tuple(map(float, gamma[1:])), intercept=float(gamma[0]),
            beta=tuple(map(float, original)) if stage.linear else (), beta0=float(gamma[0] - beta @ model.center) if stage.linear else 0.0,
            beta_valid=stage.linear, rmsec=float(np.sqrt(max(sse, 0.0) / n)), r2c=1 - sse / tss if tss > 0 else 0.0,
        ),
    )
