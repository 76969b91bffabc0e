"""Exact order statistics of the rows that each fold leaves to learn from, for all folds together.

Medians do not subtract like moments, but ranks can be searched. Doubles become
integers of the same order; a scan counts, for every fold and column, the training
values up to each of 255 cut points, and the interval that holds the wanted rank is
cut again. Eight scans find any value to its last bit, whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from eigenframe.plans.products import Rows, tree_sum

WAYS = 256
FEW = 16  # folds that are counted one by one
NEAR = 2_000_000  # counts of values near the wanted ones that are looked at together
HELD_CELLS = 8_000_000  # counts of one scan; more folds than that go in turns
_LOWEST, _HIGHEST = np.array([-np.inf, np.inf])


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one, gaps (NaN) come last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(bits & sign, ~bits, bits | sign)


def unordered(i: np.ndarray) -> np.ndarray:
    sign = np.uint64(1) << np.uint64(63)
    return np.where(i & sign, i ^ sign, ~i).astype(np.uint64).view(np.float64)


def _counts(rows: Rows, keys: Sequence, cuts: np.ndarray, center: np.ndarray | None) -> np.ndarray:
    """Training values up to each cut point: (folds, columns, cut points). With a centre, of distances from it."""
    layout, (folds, m, n) = rows.layout, cuts.shape

    def run(batches):
        total = np.zeros((folds, m, n + 1), dtype=np.int64)
        for x, repeat, fold, _ in layout.blocks(batches, np.zeros(m)):
            for f, key in enumerate(keys):
                own = x[layout.takes_part(key, repeat, fold)]
                values = ordered(own if center is None else np.abs(own - center[f]))
                for j in range(m):
                    total[f, j] += np.bincount(np.searchsorted(cuts[f, j], values[:, j]), minlength=n + 1)
        yield pa.record_batch({"part": pa.array([0], pa.int32()), "r": pa.array([total.ravel().astype(float)], pa.list_(pa.float64()))})

    got = tree_sum(rows.df.mapInArrow(run, "part int, r array<double>"), ["part"]).first()
    return np.cumsum(np.array(got["r"]).reshape(folds, m, n + 1), axis=2)[:, :, :-1]


def values_at(rows: Rows, keys: Sequence, ranks: np.ndarray, center: np.ndarray | None = None, ways: int = WAYS) -> np.ndarray:
    """The value of 0-based rank ``ranks[f]`` (or ``ranks[f, column]``) among the rows that fold ``f`` learns from, in each column."""
    ranks = np.broadcast_to(np.asarray(ranks).reshape(len(keys), -1), (len(keys), rows.width))
    m, at_once = rows.width, max(1, HELD_CELLS // (rows.width * ways))
    if len(keys) > at_once:
        parts = range(0, len(keys), at_once)
        return np.concatenate([values_at(rows, keys[i : i + at_once], ranks[i : i + at_once], None if center is None else center[i : i + at_once], ways) for i in parts])
    low = np.full((len(keys), m), ordered(np.array([_LOWEST]))[0])
    high = np.full((len(keys), m), ordered(np.array([_HIGHEST]))[0])
    steps = np.arange(1, ways, dtype=np.uint64)
    while (low < high).any():
        span = high - low
        # low + span · k / ways, without passing 64 bits
        whole, rest = span // np.uint64(ways), span % np.uint64(ways)
        cuts = low[..., None] + whole[..., None] * steps + rest[..., None] * steps // np.uint64(ways)
        upto = _counts(rows, keys, cuts, center)
        first = (upto <= ranks[..., None]).sum(axis=2)  # cut points that lie below the wanted value
        edges = np.concatenate([cuts, high[..., None]], axis=2)
        below = np.concatenate([low[..., None] - np.uint64(1), cuts], axis=2)
        low = np.minimum(np.take_along_axis(below, first[..., None], 2)[..., 0] + np.uint64(1), high)
        high = np.take_along_axis(edges, first[..., None], 2)[..., 0]
        low = np.minimum(low, high)
    return unordered(low)


def _near(rows: Rows, repeat: int, center: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> pa.Table | None:
    """(fold, place, v, n): how often each fold of ``repeat`` has a value whose distance from ``center`` lies from ``low`` to ``high``.

    Values nearer than ``low`` are counted together, with a NULL ``v``. None if that is more than ``NEAR`` rows.
    """
    layout, m = rows.layout, rows.width
    schema = "fold int, place int, v double, n long"

    def run(batches):
        for x, repeats, fold, _ in layout.blocks(batches, np.zeros(m)):
            own = (fold == -1) | (repeats == repeat)
            x, held = x[own], fold[own]
            for j in range(m):
                d = x[:, j] if center is None else np.abs(x[:, j] - center[j])
                less, here = ordered(d) < ordered(low[j : j + 1]), (ordered(d) >= ordered(low[j : j + 1])) & (ordered(d) <= ordered(high[j : j + 1]))
                folds, n = np.unique(held[less], return_counts=True)
                yield _counted(folds, j, np.full(len(folds), np.nan), n)
                pairs, n = np.unique(np.column_stack([held[here].astype(np.float64), x[here, j] + 0.0]), axis=0, return_counts=True)
                yield _counted(pairs[:, 0], j, pairs[:, 1], n)

    found = rows.df.mapInArrow(run, schema).groupBy("fold", "place", "v").agg(F.sum("n").alias("n"))
    got = found.limit(NEAR + 1).toArrow()
    return got if got.num_rows <= NEAR else None


def _counted(fold: np.ndarray, place: int, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(fold.astype(np.int32)), pa.array(np.full(len(fold), place, np.int32)), pa.array(v, mask=np.isnan(v)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["fold", "place", "v", "n"])


def _left_out(near: pa.Table, place: int, folds: np.ndarray, ranks: np.ndarray, center: np.ndarray | None) -> np.ndarray:
    """The wanted value of each fold in one column: the counts of all rows less those of the fold."""
    table = near.filter(pa.compute.equal(near["place"], place))
    fold, n, below = table["fold"].to_numpy(), table["n"].to_numpy(), table["v"].is_null().to_numpy()
    v = table["v"].to_numpy()
    out = np.empty(len(folds))
    values, at = np.unique(v[~below], return_inverse=True)
    less, own = n[below].sum(), dict(zip(fold[below].tolist(), n[below].tolist()))
    count = np.bincount(at, n[~below], len(values)).astype(np.int64)
    order = np.argsort(fold[~below], kind="stable")
    held, at, n = fold[~below][order], at[order], n[~below][order]
    begin, end = np.searchsorted(held, folds), np.searchsorted(held, folds, side="right")
    for c in [None] if center is None else np.unique(center).tolist():
        d = values if c is None else np.abs(values - c)
        steps, step = np.unique(d, return_inverse=True)  # equal distances on both sides are one step
        upto = less + np.cumsum(np.bincount(step, count, len(steps)).astype(np.int64))
        for f in range(len(folds)) if c is None else np.flatnonzero(center == c).tolist():
            mine = np.bincount(step[at[begin[f] : end[f]]], n[begin[f] : end[f]], len(steps)) if end[f] > begin[f] else np.zeros(len(steps))
            out[f] = steps[np.searchsorted(upto - own.get(int(folds[f]), 0) - np.cumsum(mine).astype(np.int64), ranks[f], side="right")]
    return out


def left_out_scales(rows: Rows, keys: Sequence, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray] | None:
    """The same where each fold learns from all rows but its own: the work of a scan does not grow with the folds.

    Rank r among the rows a fold of n rows learns from is one of the ranks r to r + n among
    all of them. The few values there, and how often each fold has them, are read off; so
    for distances, which differ between the medians of two folds by no more than these do.
    None if a repeat has more than ``NEAR`` such counts.
    """
    out = np.empty((2, len(keys), rows.width))
    ways = WAYS if rows.width > 8 else WAYS**2  # half the scans
    for repeat in sorted({k[0] for k in keys}):
        mine = [i for i, k in enumerate(keys) if k[0] == repeat]
        folds, learned = np.array([keys[i][1] for i in mine]), np.array([sizes[i] for i in mine])
        counted = rows.df.filter((F.col("fold") == -1) | (F.col("repeat") == repeat)).count()
        ranks = np.maximum(-(-learned // 2) - 1, 0)
        whole = [(repeat, -2)] * 2  # no fold is held out
        ends = [int(ranks.min()), int(min((ranks + counted - learned).max(), counted - 1))]
        low, high = values_at(rows, whole, np.array(ends), None, ways)
        near = _near(rows, repeat, None, low, high)
        if near is None:
            return None
        median = np.column_stack([_left_out(near, j, folds, ranks, None) for j in range(rows.width)])
        middle = (median.min(axis=0) + median.max(axis=0)) / 2
        reach = 2 * np.abs(median - middle).max(axis=0)
        low, high = values_at(rows, whole, np.array(ends), np.array([middle, middle]), ways)
        slack = reach + 1e-12 * (np.abs(middle) + high)  # distances are rounded
        near = _near(rows, repeat, middle, np.maximum(low - slack, 0.0), high + slack)
        if near is None:
            return None
        out[0, mine] = median
        out[1, mine] = np.column_stack([_left_out(near, j, folds, ranks, median[:, j]) for j in range(rows.width)])
    return out[0], out[1]


def robust_scales(rows: Rows, keys: Sequence, sizes: Sequence[int], left_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Empirical median, and median distance from it, of the rows that each fold learns from.

    ``left_out``: these are all rows of the repeat but those of the fold, and those of no fold.
    """
    if left_out and len(keys) > FEW and (found := left_out_scales(rows, keys, sizes)):
        return found
    ranks = np.array([max(-(-n // 2) - 1, 0) for n in sizes])
    median = values_at(rows, keys, ranks)
    return median, values_at(rows, keys, ranks, median)
