"""Average ranks of several columns over the same rows.

A set of columns is ranked over the rows that have all of them, so a column has a rank
for each set it is in. Bounds from a sample part a column into classes: the bounds
themselves (odd numbers) and what lies between two of them (even ones). Counted in one
scan for every set, classes give the rank of a bound and where the ranks between two
bounds begin. Rows between bounds are dealt by class, one range per task, and ranked
there for all sets at once; a value that many rows share is a bound, so it is never one
task's, and a column whose values are all bounds moves no row. A task packs the cells of
all rows that it sends to one range as bytes, row after row: an exchange moves blocks, not
rows. Neither counting nor dealing looks a value up among the bounds: values are sorted,
and the bounds are looked up among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.plans.ranges import MAX_RANGES

HELD_CELLS = 1 << 21  # cells a task gathers before it deals them
_RAW = -1  # in the place of a set: the column is not ranked yet
FEW_FILES = 32  # ranges for which a task may write a file each
ONE_FILE = 201  # ranges from which on Spark lets a task write one file for all
_BLOCKS = "at int, cells binary"


def classes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The class of every value; NaN counts as past the last bound."""
    n = np.searchsorted(edges, x, side="right")
    return 2 * n - (np.append(edges, np.nan)[n - 1] == x)


@dataclass(frozen=True)
class Ranking:
    """Sets of columns (by number), the bounds of each column, and for each set and column what its classes begin with."""

    sets: list[list[int]]
    edges: list[np.ndarray]
    begins: dict[tuple[int, int], np.ndarray]
    rows: list[int]  # complete rows of each set
    moved: list[bool]  # of each column: some rows lie between bounds

    def after(self, layout: list, now: Sequence[int]) -> list:
        """What a matrix of cells holds once the columns ``now`` are ranked: pairs of a set and a column."""
        kept = [(k, c) for k, c in layout if k != _RAW or c not in now]
        return kept + [(k, c) for c in now for k, some in enumerate(self.sets) if c in some]

    def rank(self, cells: np.ndarray, layout: list, now: Sequence[int]) -> np.ndarray:
        """Columns ``now`` replaced by their ranks, NaN outside of a set. Rows between bounds must be all of one class."""
        at = {key: i for i, key in enumerate(layout)}
        known = [None if not set(now) & set(some) else self._complete(cells, at, k) for k, some in enumerate(self.sets)]
        new = []
        for c in now:
            sets = [k for k, some in enumerate(self.sets) if c in some]
            new += (self._inner if self.moved[c] else self._on_bounds)(cells[:, at[_RAW, c]].copy(), c, sets, [known[k] for k in sets])
        kept = [at[key] for key in layout if key[0] != _RAW or key[1] not in now]
        return np.column_stack([*(cells[:, i] for i in kept), *new]) if now else cells

    def _complete(self, cells: np.ndarray, at: dict, k: int) -> np.ndarray:
        """Rows that have all columns of a set: those with a rank, once one of them is ranked."""
        done = [at[k, c] for c in self.sets[k] if (k, c) in at]
        return ~np.logical_or.reduce([np.isnan(cells[:, i]) for i in done[:1] or [at[_RAW, c] for c in self.sets[k]]])

    def _on_bounds(self, x: np.ndarray, c: int, sets: Sequence[int], known: Sequence[np.ndarray]) -> list[np.ndarray]:
        cls = classes(x, self.edges[c])
        return [np.where(rows, self.begins[k, c][cls], np.nan) for k, rows in zip(sets, known)]

    def _inner(self, x: np.ndarray, c: int, sets: Sequence[int], known: Sequence[np.ndarray]) -> list[np.ndarray]:
        """One sort for all sets; equal values are ranked once."""
        order = np.argsort(x)
        x = x[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
        lengths = np.diff(np.append(first, len(x)))
        cls = classes(x[first], self.edges[c])
        between = cls % 2 == 0
        out = []
        for k, rows in zip(sets, known):
            rows = rows[order]
            n = np.where(between, np.add.reduceat(rows, first, dtype=np.int64) if len(first) else 0, 0)
            rank = self.begins[k, c][cls] + np.where(between, np.cumsum(n) - (n - 1) / 2, 0.0)
            new = np.empty(len(x))
            new[order] = np.where(rows, np.repeat(rank, lengths), np.nan)
            out.append(new)
        return out


def count_classes(plain: DataFrame, sets: Sequence[Sequence[int]], edges: Sequence[np.ndarray]) -> Ranking:
    """One scan: how many complete rows of every set each class holds."""
    sets, place, n = [list(dict.fromkeys(some)) for some in sets], {}, 0
    for k, some in enumerate(sets):
        for c in some:
            place[k, c] = slice(n, n + 2 * len(edges[c]) + 1)
            n = place[k, c].stop

    def run(batches):
        total = np.zeros(n, np.int64)
        for cells in _matrices(batches, len(edges)):
            columns, whole = [cells[:, c].copy() for c in range(len(edges))], {}
            gaps = [np.isnan(x) for x in columns]
            for k, some in enumerate(sets):
                out = np.logical_or.reduce([gaps[c] for c in some])
                known = ~out if out.any() else None
                for c in some:
                    if known is None and c not in whole:
                        whole[c] = _sizes(columns[c], edges[c])
                    total[place[k, c]] += whole[c] if known is None else _sizes(columns[c][known], edges[c])
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["class", "n"])

    total = np.zeros(n, np.int64)
    for r in _rows(plain).mapInArrow(run, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        total[r["class"]] = r["n"]
    sizes = {key: total[at] for key, at in place.items()}
    begins = {key: np.cumsum(n) - n + np.where(np.arange(len(n)) % 2 == 1, (n + 1) / 2, 0.0) for key, n in sizes.items()}
    moved = [any(sizes[k, c][::2].any() for k, some in enumerate(sets) if c in some) for c in range(len(edges))]
    return Ranking(sets, list(edges), begins, [int(sizes[k, some[0]].sum()) for k, some in enumerate(sets)], moved)


def _sizes(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many values each class holds; none is NaN."""
    x = np.sort(x)
    ends = np.empty(2 * len(edges) + 1, np.int64)
    ends[:-1:2], ends[1::2], ends[-1] = np.searchsorted(x, edges, side="left"), np.searchsorted(x, edges, side="right"), len(x)
    return np.diff(ends, prepend=0)


def ranked(plain: DataFrame, ranking: Ranking, order: Sequence[int], finish: Callable[[Iterator[np.ndarray], list], Iterator], schema: str) -> DataFrame:
    """``finish`` of the cells in which all columns that move no row, and then those of ``order``, are ranked.

    It gets an iterator of matrices (a column per entry of the layout, a row per row of the table) and the layout.
    """
    layout = [(_RAW, c) for c in range(len(ranking.edges))]
    now = [c for c in range(len(ranking.edges)) if not ranking.moved[c]]
    df, source = _rows(plain), _matrices
    for c in order:
        if ranking.moved[c]:
            df = _dealt(df.mapInArrow(_deal_by(ranking, source, layout, now, c), _BLOCKS), len(ranking.edges[c]) + 1)
            layout, now, source = ranking.after(layout, now), [c], _ranges

    def last(batches):
        cells = (ranking.rank(m, layout, now) for m in source(batches, len(layout)))
        yield from finish(_gathered(cells), ranking.after(layout, now))

    return df.mapInArrow(last, schema)


def rank_rows(plain: DataFrame, ranking: Ranking) -> DataFrame:
    """(set, ranks): the ranks of the complete rows of each set, in the order of its columns."""

    def finish(matrices, layout):
        at = [[layout.index((k, c)) for c in some] for k, some in enumerate(ranking.sets)]
        for cells in matrices:
            for k, own in enumerate(at):
                ranks = cells[~np.isnan(cells[:, own[0]])][:, own]
                offsets = pa.array(np.arange(0, ranks.size + 1, len(own)), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(ranks.ravel()))
                yield pa.record_batch([pa.array(np.full(len(lists), k), pa.int32()), lists], names=["set", "ranks"])

    return ranked(plain, ranking, range(len(ranking.edges)), finish, "set int, ranks array<double>")


def rank_sums(plain: DataFrame, ranking: Ranking, blocks: Sequence[tuple[Sequence[int], Sequence[int]]]) -> dict[tuple[int, int], np.ndarray]:
    """n, Σx, Σy, Σx², Σy², Σxy of the ranks about their mean, for every pair (x, y) of the block of each set.

    A pair is in one block. The first columns of all blocks are ranked one after the other; each of the
    others needs no more than their ranks and its own values, so rows are dealt for all of those at once.
    """
    first = list(dict.fromkeys(c for xs, _ in blocks for c in xs))
    others = list(dict.fromkeys(c for _, ys in blocks for c in ys))
    moved = [c for c in others if ranking.moved[c]]
    pairs = {pair: i for i, pair in enumerate((x, y) for xs, ys in blocks for x in xs for y in ys)}
    own = {c: [(_RAW, c), *[(k, x) for k, (xs, ys) in enumerate(blocks) if c in ys for x in xs]] for c in moved}
    begin, ids = {}, 0  # numbers of the ranges of each column; the number after them is for sums
    for c in moved:
        begin[c] = ids
        ids += len(ranking.edges[c]) + 1

    def add(total, cells, layout, some):
        at = {key: i for i, key in enumerate(layout)}
        for k, (xs, ys) in enumerate(blocks):
            ys = [y for y in ys if y in some]
            if not ys:
                continue
            z = np.array([cells[:, at[k, c]] for c in (*xs, *ys)])
            z = (z if (known := ~np.isnan(z[0])).all() else z[:, known]) - (ranking.rows[k] + 1) / 2
            x, y, shape = z[: len(xs)], z[len(xs) :], (len(xs), len(ys))
            sums = [np.full(shape, z.shape[1]), x.sum(axis=1)[:, None], y.sum(axis=1), (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1), x @ y.T]
            for i, v in enumerate(sums):
                total[i, [[pairs[x, y] for y in ys] for x in xs]] += np.broadcast_to(v, shape)

    def finish(matrices, layout):
        total = np.zeros((6, len(pairs)))
        still = [c for c in others if c not in moved]
        for cells in matrices:
            add(total, cells, layout, still)
            for c in moved:
                mine = np.column_stack([cells[:, layout.index(key)] for key in own[c]])
                out = np.logical_and.reduce([np.isnan(mine[:, i]) for i in range(1, len(own[c]))])
                mine = mine[~out] if out.any() else mine
                yield _blocks(mine, mine[:, 0].copy(), ranking.edges[c], begin[c])
        yield pa.record_batch([pa.array([ids], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "cells"])

    def last(batches):
        total = np.zeros((6, len(pairs)))
        for at, parts in _runs(batches):
            if at == ids:
                total += sum(parts).reshape(total.shape)
                continue
            c = max((c for c in moved if begin[c] <= at), key=begin.get)
            cells = np.concatenate(parts).reshape(-1, len(own[c]))
            add(total, ranking.rank(cells, own[c], [c]), ranking.after(own[c], [c]), [c])
        yield pa.record_batch([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["v"])

    sent = ranked(plain, ranking, first, finish, _BLOCKS)
    sums = (_dealt(sent, ids + 1) if moved else sent).mapInArrow(last, "v array<double>")
    total = np.zeros(6 * len(pairs))
    for r in sums.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r["i"]] = r["v"]
    return {pair: total.reshape(6, -1)[:, i] for pair, i in pairs.items()}


def _deal_by(ranking: Ranking, source, layout: list, now: Sequence[int], c: int):
    """Ranks the columns ``now`` and sends rows to the ranges of column ``c``."""
    at = ranking.after(layout, now).index((_RAW, c))

    def run(batches):
        for cells in _gathered(ranking.rank(m, layout, now) for m in source(batches, len(layout))):
            yield _blocks(cells, cells[:, at].copy(), ranking.edges[c])

    return run


def _blocks(cells: np.ndarray, x: np.ndarray, edges: np.ndarray, begin: int = 0) -> pa.RecordBatch:
    """The cells of the rows of each range; rows on a bound, or without a value, are dealt out evenly."""
    order = np.argsort(x)
    x = x[order]
    low, high = np.searchsorted(x, edges, side="left"), np.searchsorted(x, edges, side="right")
    starts, ends = np.append(0, high), np.append(low, len(x) - np.isnan(x).sum())
    spread = np.concatenate([*(order[a:b] for a, b in zip(low, high) if a < b), order[ends[-1] :]])
    cuts = np.arange(len(starts) + 1) * len(spread) // len(starts)
    at, packed = [], []
    for i, (a, b) in enumerate(zip(starts, ends)):
        rows = np.append(order[a:b], spread[cuts[i] : cuts[i + 1]])
        if len(rows):
            at.append(begin + i)
            packed.append(cells.take(rows, axis=0).tobytes())
    return pa.record_batch([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=["at", "cells"])


def _dealt(blocks: DataFrame, ids: int) -> DataFrame:
    """Blocks of one range in one task, one range after the other.

    Up to 200 partitions Spark opens a file for each in every task, which costs more than the rows do; some are left empty for that.
    """
    tasks = min(ids if ids <= FEW_FILES else max(ids, ONE_FILE), 2 * MAX_RANGES)
    dealt = blocks.repartitionById(tasks, F.col("at"))
    return dealt if tasks >= ids else dealt.sortWithinPartitions("at")


def _rows(plain: DataFrame) -> DataFrame:
    """A row's cells in one array: Spark measures every column of a batch anew with each row that it adds."""
    return plain.select(F.array(*plain.columns).alias("cells"))


def _matrices(batches, width: int) -> Iterator[np.ndarray]:
    """Rows as they are read."""
    cells = (batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width) for batch in batches)
    return _gathered(m for m in cells if m.size)


def _runs(batches) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks of one number after the other."""
    now, parts = None, []
    for batch in batches:
        for at, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
            if at != now and parts:
                yield now, parts
                parts = []
            now = at
            parts.append(np.frombuffer(cells.as_buffer(), float))
    if parts:
        yield now, parts


def _ranges(batches, width: int) -> Iterator[np.ndarray]:
    """All rows of one range after the other."""
    for _, parts in _runs(batches):
        yield np.concatenate(parts).reshape(-1, width)


def _gathered(matrices: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Small matrices put together."""
    parts, held = [], 0
    for cells in matrices:
        parts.append(cells)
        held += cells.size
        if held >= HELD_CELLS:
            yield np.concatenate(parts) if len(parts) > 1 else cells
            parts, held = [], 0
    if parts:
        yield np.concatenate(parts)
