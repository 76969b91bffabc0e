"""Components of tables too wide for a square matrix, from products of the rows with a few vectors.

The covariance C of a table of m columns is never formed. One scan gives C·V for a
block V of vectors: each row is multiplied with V, and the results with the row again,
summed per task and then in a tree. A block Lanczos process (Golub & Underwood 1977)
grows a basis from such products until the leading components have settled. Several
problems over the same rows, such as the folds of a cross-validation, go through the
same scans: each has its own centre, divisor, vectors and rows to learn from.

What the leading components leave over enters limits by the sums of its eigenvalues,
their squares and cubes. These are traces: exact on the basis found, and estimated by
random vectors on what lies outside of it (Meyer, Musco, Musco & Woodruff 2021).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.plans.durable import stored
from eigenframe.plans.gram import pieces

_FAN = 64  # partial rows one merge adds up
_FIRST_CELLS = 1 << 17  # cells of one (repeat, fold) that the packing scan multiplies up, and of all of them in a task
_FIRST_HELD = 1 << 22
_PART = 1024  # variables in one partial row
_CHUNK = 1 << 18  # cells multiplied at once inside a task: 2 MB, which a core's caches hold between the products
_TASKS = 4  # scans have so many tasks a core: bytes on disk say little about the work of packed rows
PROBES = 64  # random vectors of a trace estimate: its relative error is about the spread of the rest by their root
MAX_PASSES = 60
PREVIEW = 100  # rows of a rough centre
FAR = 100.0  # squared distance of the rough centre, in variances, from which sums are made again
MISSING = "missing cell in a model variable: impute, drop, or use missing='native'"
SETTLED = 1e-10  # of a component: what C·v - λ·v has left, against the first eigenvalue


@dataclass(frozen=True)
class Problem:
    """One set of rows with its scale. ``key`` is the (repeat, fold) held out; None learns from all rows."""

    key: tuple[int, int] | None
    n: int
    center: np.ndarray
    divisor: np.ndarray


@dataclass
class Spectrum:
    """Leading eigenvalues and vectors, and what is known of the others."""

    eigenvalues: np.ndarray
    vectors: np.ndarray  # m × k
    found: np.ndarray  # all values of the basis, falling; those past k have not settled
    basis: np.ndarray  # orthonormal, m × j
    images: np.ndarray  # C times the basis
    closed: bool  # C maps the basis into itself: nothing is left outside that C does not send to zero

    def first(self, k: int) -> Spectrum:
        return replace(self, eigenvalues=self.eigenvalues[:k], vectors=self.vectors[:, :k])


def tree_sum(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the arrays ``r`` of each key; a merge adds up at most 64 rows, up to 262,144 tasks."""
    keys = list(keys)
    types = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in keys)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        cells = table.column("r").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        first = {c: table.column(c).slice(0, 1) for c in (*keys, "task")}
        return pa.table(first | {"r": pa.array([cells.sum(axis=0)], pa.list_(pa.float64()))})

    parts = parts.select(*keys, F.spark_partition_id().cast("long").alias("task"), "r")
    for span in (_FAN, _FAN**2, 1 << 40):
        group = F.floor(F.col("task") / span).alias("_group")
        parts = parts.groupBy(*keys, group).applyInArrow(add, f"{types}, task long, r array<double>")
    return parts.drop("task")


def cells(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column, or of one that packs the cells of each row into bytes."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out, codec = np.empty((len(column), width)), pa.Codec("lz4")
    for row, packed in zip(out, column):
        row[:] = np.frombuffer(codec.decompress(packed.as_buffer(), 8 * width), np.float64)
    return out


def complete_cells(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column as they come from the source: lengths and gaps are checked."""
    if column.null_count:
        raise ValueError(MISSING)
    ends, values = column.offsets.to_numpy(), column.flatten()
    if np.any(np.diff(ends) != width):
        raise ValueError("rows differ in length")
    x = values.to_numpy(zero_copy_only=False).reshape(-1, width)
    if values.null_count or np.isnan(x).any():
        raise ValueError(MISSING)
    return x


@contextmanager
def scans(spark: SparkSession, width: int) -> Iterator[None]:
    """While wide rows are read: batches that caches hold, and tasks by the cores there are."""
    rows, tasks = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.minPartitionNum"
    before, fit = {c: spark.conf.get(c, None) for c in (rows, tasks)}, max(1, _CHUNK // width)
    given = int(before[rows] or 0)
    spark.conf.set(rows, str(min(given, fit) if given > 0 else fit))
    if before[tasks] is None:
        spark.conf.set(tasks, str(_TASKS * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)


@dataclass(frozen=True)
class Layout:
    """What tasks need to know of rows: values first (less ``base``), then repeat and fold."""

    width: int
    learns: Callable[[int, np.ndarray], np.ndarray]
    base: np.ndarray | float = 0.0

    def blocks(self, batches: Iterator[pa.RecordBatch], shift: np.ndarray, also: int = 0) -> Iterator[tuple]:
        """(rows less ``shift``, repeat, fold, place in the batch) of pieces of bounded size."""
        step, off = max(1, _CHUNK // max(1, self.width + also)), shift - self.base
        moved = bool(np.any(off))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                x = cells(piece.column(0), self.width)
                yield x - off if moved else x, piece.column(1).to_numpy(), piece.column(2).to_numpy(), piece

    def takes_part(self, key: tuple[int, int] | None, repeat: np.ndarray, fold: np.ndarray) -> np.ndarray:
        if key is None:
            return np.ones(len(fold), dtype=bool)
        return (fold == -1) | ((repeat == key[0]) & self.learns(key[1], fold))


class Rows:
    """Complete rows as one array column, with the fold each is held out in.

    ``folds`` names the columns (repeat, fold), or is None. Rows with a NULL fold are
    learned from by every problem. ``learns(fold held out, fold of a row)`` says whether
    a row of the same repeat takes part; without it, every row but those held out does.
    """

    def __init__(
        self, df: DataFrame, values: Column, width: int, extra: Sequence[Column] = (), folds: tuple[str, str] | None = None,
        learns: Callable[[int, np.ndarray], np.ndarray] | None = None,
    ):
        keys = [F.coalesce(F.col(c).cast("int"), F.lit(-1)) if folds else F.lit(-1) for c in folds or ("", "")]
        self.df = df.select(values.alias("x"), keys[0].alias("repeat"), keys[1].alias("fold"), *extra)
        self.width = width
        self.layout = Layout(width, learns or (lambda held, fold: fold != held))
        self.known: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] | None = None
        self.start: np.ndarray | None = None  # vectors the packing scan has multiplied the rows with
        self.first: dict[tuple[int, int], np.ndarray] = {}  # X'X·start of each (repeat, fold)

    def packed(self, k: int = 0, folds: int = 1) -> Rows:
        """The same rows written out once, each as bytes, less a rough centre; that one scan checks and adds them up, too.

        The scans that follow read the bytes: nothing of the source is worked out again. With ``k``, the scan also
        multiplies the rows with the vectors the search for ``k`` components starts from, unless they or the ``folds``
        are too many.
        """
        m, base = self.width, self._rough_centre()
        start = starting_block(m, k) if k and m * (k + 6) <= _FIRST_CELLS and folds * m * (k + 6) <= _FIRST_HELD else None
        schema = T.StructType([T.StructField("x", T.BinaryType())])
        for f in self.df.schema.fields[1:]:
            schema = schema.add(f.name, f.dataType)
        schema = schema.add("_sums", T.ArrayType(T.DoubleType()))  # of rows that hold what a task has added up

        def run(batches):
            codec, held, kinds = pa.Codec("lz4"), {}, []
            for batch in pieces(batches, m, _CHUNK):
                x = complete_cells(batch.column(0), m) - base
                _add_up(held, x, batch.column(1).to_numpy(), batch.column(2).to_numpy(), start)
                column = pa.array([codec.compress(pa.py_buffer(row), asbytes=True) for row in x], pa.binary())
                kinds = batch.schema.types[1:]
                yield pa.RecordBatch.from_arrays([column, *batch.columns[1:], pa.nulls(len(x), pa.list_(pa.float64()))], names=schema.names)
            for (repeat, fold), r in held.items():
                keys = [pa.array([v], pa.int32()) for v in (repeat, fold)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.binary()), *keys, *[pa.nulls(1, t) for t in kinds[2:]], pa.array([r], pa.list_(pa.float64()))], names=schema.names
                )

        spark, out = self.df.sparkSession, copy.copy(self)
        try:
            with scans(spark, m):
                both = stored(self.df.mapInArrow(run, schema), "wide", {"parquet.enable.dictionary": "false", "compression": "uncompressed"})
        except Exception:
            lo, hi = self.df.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
            if lo != hi:
                raise ValueError(f"rows differ in length: {lo} to {hi}") from None
            raise
        out.df = both.filter("_sums is null").drop("_sums")
        out.df.stored_at = both.stored_at
        out.layout = replace(self.layout, base=base)
        sums = self._collected(both.filter("_sums is not null").select("repeat", "fold", F.col("_sums").alias("r")))
        out.known = {key: r[:3] for key, r in sums.items()}
        if start is not None:
            out.start, out.first = start, {key: r[3].reshape(-1, m).T for key, r in sums.items()}
        return out

    def first_product(self, shift: np.ndarray, problem: Problem) -> tuple[np.ndarray, np.ndarray] | None:
        """(V, C·V) from what the packing scan has added up: V spans ``start`` in the scale of the problem."""
        if self.start is None or not np.array_equal(shift, self.layout.base):
            return None
        q, r = np.linalg.qr(self.start * problem.divisor[:, None])
        if np.linalg.cond(r) > 1e3:  # scales so different that digits would be lost
            return None
        mine = [key for key in self.known if self.layout.takes_part(problem.key, np.array([key[0]]), np.array([key[1]]))[0]]
        n, sums = (sum(self.known[key][i] for key in mine) for i in (0, 1))
        product = sum(self.first[key] for key in mine)
        off = problem.center - shift
        along = off @ self.start
        about = product - np.outer(sums, along) - np.outer(off, sums @ self.start - n * along)
        return q, np.linalg.solve(r.T, (about / problem.divisor[:, None] / (problem.n - 1)).T).T

    def first_repeat(self) -> Rows:
        """Packed rows of one repeat: each row of the table once, whatever the folds."""
        out = copy.copy(self)
        out.df = self.df.filter("repeat <= 0")
        out.known, out.first = ({k: v for k, v in parts.items() if k[0] <= 0} for parts in (self.known, self.first))
        return out

    def _rough_centre(self) -> np.ndarray:
        """The mean of a few rows; any finite numbers would be correct."""
        first = self.df.select("x").limit(max(1, min(PREVIEW, _CHUNK // self.width))).collect()
        x = np.array([r["x"] for r in first if r["x"] is not None and len(r["x"]) == self.width], float).reshape(-1, self.width)
        mean = x.mean(axis=0) if len(x) else np.zeros(self.width)
        return np.where(np.isfinite(mean), mean, 0.0)

    def centred_sums(self) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]]:
        """A centre and the sums about it: a rough one, or the mean of all rows if digits were lost about the rough one."""
        shift = self._rough_centre() if self.known is None else self.layout.base
        parts = self.sums(shift) if self.known is None else self.known
        n = max(1, sum(p[0] for p in parts.values()))
        off, square = (sum((p[i] for p in parts.values()), np.zeros(self.width)) / n for i in (1, 2))
        if np.any(off**2 > FAR * np.maximum(square - off**2, 0.0) + (1e-9 * (shift + off)) ** 2):
            shift = shift + off
            parts = self.sums(shift)
        return shift, parts

    def sums(self, shift: np.ndarray) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
        """(rows, sums, sums of squares) about ``shift`` of each (repeat, fold)."""
        layout = self.layout

        def run(batches):
            held: dict[tuple[int, int], np.ndarray] = {}
            for x, repeat, fold, _ in layout.blocks(batches, shift):
                _add_up(held, x, repeat, fold)
            for (a, b), r in held.items():
                yield pa.record_batch({"repeat": pa.array([a], pa.int32()), "fold": pa.array([b], pa.int32()), "r": pa.array([r], pa.list_(pa.float64()))})

        return {key: r[:3] for key, r in self._collected(self.df.mapInArrow(run, "repeat int, fold int, r array<double>")).items()}

    def _collected(self, parts: DataFrame) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        m = self.width
        with scans(parts.sparkSession, m):
            got = {(r["repeat"], r["fold"]): np.array(r["r"]) for r in tree_sum(parts, ["repeat", "fold"]).collect()}
        return {k: (int(r[0]), r[1 : m + 1], r[m + 1 : 2 * m + 1], r[2 * m + 1 :]) for k, r in got.items()}

    def apply(self, shift: np.ndarray, problems: Sequence[Problem], vectors: Sequence[np.ndarray]) -> list[np.ndarray]:
        """C·V of each problem, in one scan."""
        m, layout = self.width, self.layout
        wide = np.concatenate([v / p.divisor[:, None] for p, v in zip(problems, vectors)], axis=1)
        widths = [v.shape[1] for v in vectors]
        ends = np.cumsum(widths)
        offset = np.concatenate([(shift - p.center) @ wide[:, e - w : e] for p, e, w in zip(problems, ends, widths)])

        def run(batches):
            total, plain = np.zeros((wide.shape[1], m)), np.zeros(wide.shape[1])
            for x, repeat, fold, _ in layout.blocks(batches, shift, wide.shape[1]):
                y = x @ wide + offset
                for p, e, w in zip(problems, ends, widths):
                    if p.key is not None:
                        y[~layout.takes_part(p.key, repeat, fold), e - w : e] = 0.0
                total += y.T @ x
                plain += y.sum(axis=0)
            total = np.concatenate([total.T, plain[None]])
            for part in range(0, m + 1, _PART):
                cells = total[part : part + _PART].ravel()
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "r": pa.array([cells], pa.list_(pa.float64()))})

        with scans(self.df.sparkSession, m):
            parts = tree_sum(self.df.mapInArrow(run, "part int, r array<double>"), ["part"]).collect()
        rows = np.concatenate([np.array(r["r"]).reshape(-1, wide.shape[1]) for r in sorted(parts, key=lambda r: r["part"])]) if parts else np.zeros((m + 1, wide.shape[1]))
        out = []
        for p, e, w in zip(problems, ends, widths):
            about = rows[:m, e - w : e] - np.outer(p.center - shift, rows[m, e - w : e])
            out.append(about / p.divisor[:, None] / (p.n - 1))
        return out

    def squares(self, shift: np.ndarray, problem: Problem, vectors: np.ndarray) -> np.ndarray:
        """v'Cv of each column of ``vectors``: only sums of squares leave a task."""
        layout, wide = self.layout, vectors / problem.divisor[:, None]
        offset = (shift - problem.center) @ wide

        def run(batches):
            total = np.zeros(wide.shape[1])
            for x, repeat, fold, _ in layout.blocks(batches, shift, wide.shape[1]):
                y = x[layout.takes_part(problem.key, repeat, fold)] @ wide + offset
                total += (y * y).sum(axis=0)
            yield pa.record_batch({"part": pa.array([0], pa.int32()), "r": pa.array([total], pa.list_(pa.float64()))})

        with scans(self.df.sparkSession, self.width):
            return np.array(tree_sum(self.df.mapInArrow(run, "part int, r array<double>"), ["part"]).first()["r"]) / (problem.n - 1)


def _add_up(held: dict, x: np.ndarray, repeat: np.ndarray, fold: np.ndarray, start: np.ndarray | None = None) -> None:
    """Add the rows ``x`` to the (count, sums, sums of squares, products with ``start``) held of each (repeat, fold)."""
    for key in {*zip(repeat.tolist(), fold.tolist())}:
        mine = (repeat == key[0]) & (fold == key[1])
        own = x if mine.all() else x[mine]
        products = [] if start is None else [((own @ start).T @ own).ravel()]
        held[key] = held.get(key, 0.0) + np.concatenate(([len(own)], own.sum(axis=0), np.einsum("ij,ij->j", own, own), *products))


def starting_block(m: int, k: int, seed: int = 0) -> np.ndarray:
    """Random orthonormal vectors from which the search for ``k`` components starts."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(m, min(m, k + 4))))[0]


def _orthonormal(block: np.ndarray, basis: np.ndarray | None, scale: float) -> np.ndarray:
    """What ``block`` adds to ``basis``, as orthonormal columns; directions of rounding size add nothing."""
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    new = u[:, s > 1e-9 * scale]
    if basis is not None and new.size:
        new = new - basis @ (basis.T @ new)
        new = np.linalg.qr(new)[0]
    return new


def leading(rows: Rows, shift: np.ndarray, problems: Sequence[Problem], k: int, seed: int = 0) -> list[Spectrum]:
    """The first ``k`` components of each problem; one scan per step serves all problems that have not settled."""
    m = rows.width
    start = starting_block(m, k, seed)
    known = [rows.first_product(shift, p) if rows.start is not None and rows.start.shape[1] >= start.shape[1] else None for p in problems]
    states: list[dict] = [{"q": None, "w": None, "v": start if f is None else f[0]} for f in known]
    done: list[Spectrum | None] = [None] * len(problems)
    for step in range(1, MAX_PASSES + 1):
        active = [i for i, d in enumerate(done) if d is None]
        images = {i: known[i][1] for i in active if step == 1 and known[i] is not None}
        asked = [i for i in active if i not in images]
        if asked:
            images |= dict(zip(asked, rows.apply(shift, [problems[i] for i in asked], [states[i]["v"] for i in asked])))
        for i, w in images.items():
            s = states[i]
            s["q"] = s["v"] if s["q"] is None else np.concatenate([s["q"], s["v"]], axis=1)
            s["w"] = w if s["w"] is None else np.concatenate([s["w"], w], axis=1)
            inner = s["q"].T @ s["w"]
            theta, turn = np.linalg.eigh((inner + inner.T) / 2)
            theta, turn = np.maximum(theta[::-1], 0.0), turn[:, ::-1]
            size = max(theta[0], 1e-300)
            have = min(k, len(theta))
            off = np.linalg.norm(s["w"] @ turn[:, :have] - (s["q"] @ turn[:, :have]) * theta[:have], axis=0)
            s["v"] = _orthonormal(w, s["q"], size)
            closed = s["v"].shape[1] == 0 or s["q"].shape[1] >= m
            if closed or (have == k and off.max() <= SETTLED * size) or (step == MAX_PASSES and have == k and off.max() <= 1e4 * SETTLED * size):
                done[i] = _spectrum(s, theta, turn, k, closed)
        if all(d is not None for d in done):
            return done  # type: ignore[return-value]
    raise RuntimeError(f"components have not settled after {MAX_PASSES} scans: ask for fewer")


def _spectrum(s: dict, theta: np.ndarray, turn: np.ndarray, k: int, closed: bool) -> Spectrum:
    vectors, values = s["q"] @ turn[:, :k], theta[:k]
    if len(values) < k:  # fewer directions than asked for: any others have no spread
        more = _orthonormal(np.random.default_rng(1).normal(size=(len(vectors), k - len(values))), s["q"], 1.0)
        vectors, values = np.concatenate([vectors, more], axis=1), np.append(values, np.zeros(more.shape[1]))
    return Spectrum(values, vectors, theta, s["q"], s["w"], closed)


def rest_sums(rows: Rows, shift: np.ndarray, problem: Problem, found: Spectrum, total: float, seed: int = 0) -> list[float]:
    """Sums of the eigenvalues past the leading ones, of their squares and of their cubes; ``total`` is the trace of C.

    All are taken of what is left when the leading vectors are projected out, so that
    nothing cancels beside large leading values.
    """
    k, first = len(found.eigenvalues), max(float(found.eigenvalues[0]), 1e-300)
    beyond = found.found[k:][found.found[k:] > 1e-13 * first]
    outside = total - float(found.eigenvalues.sum()) - float(beyond.sum())
    if outside <= 1e-11 * total:
        return [float(np.sum(beyond**i)) for i in (1, 2, 3)]

    def without(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        return block

    turn = np.linalg.svd(found.vectors.T @ found.basis)[2][k:].T  # the rest of the basis
    images = without(found.images @ turn, found.vectors)
    g = np.random.default_rng(seed).choice([-1.0, 1.0], size=(rows.width, PROBES))
    probes = without(rows.apply(shift, [problem], [without(g, found.basis)])[0], found.vectors)
    cubes = rows.squares(shift, problem, np.concatenate([images, probes], axis=1))
    j = images.shape[1]
    squares = float((images**2).sum() + (probes**2).sum() / PROBES)
    return [total - float(found.eigenvalues.sum()), squares, float(cubes[:j].sum() + cubes[j:].sum() / PROBES)]
