"""Packing documents into training sequences by vector best-fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum
of squared piece lengths, which is what block-diagonal attention computes).
Pieces are placed from the longest to the shortest, each into the open sequence
that fits it under every capacity and scores best, either by the norm of what
would be left or by the weighted dot product of demand and room.

A document longer than a sequence is cut into full pieces; what does not fill a
sequence is the first piece. Pieces are dealt by row number to groups of bounded
size, and each group is packed on its own: a group leaves a few sequences short
of full, so the loss is a fraction of a sequence for some thousand pieces,
whatever the size of the corpus. Those short sequences are dealt and packed once
more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices
from eigenframe.llm.tokens import encoder
from eigenframe.plans.durable import stored

SLICE = 1 << 20  # bytes of text encoded at once; what encoding holds beside the word cache follows from it
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _row long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; None: as many documents, and as much attention, as the tokens allow."""

    tokens: int = 2048
    documents: int | None = None
    attention: float | None = None
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)

    @property
    def capacity(self) -> np.ndarray:
        whole = (self.tokens, self.documents or self.tokens, self.attention or float(self.tokens) ** 2)
        return np.array(whole, dtype=np.float64)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, and before them what is left over."""
    head = n % size
    starts = ([0] if head else []) + list(range(head, n, size))
    return [(s, head if s == 0 and head else size) for s in starts]


def pieces_of(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """The pieces of all documents, not yet placed; needs columns doc_id and text.

    A NULL text is an empty one, so every row has at least the piece of its end
    id. Repeated rows and NULL ids are kept as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        coder = encoder(tokenizer)
        for batch in slices(batches, 1, SLICE):
            found: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                data = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(data), size)):
                    values = (doc, k, start, length, zlib.crc32(data[start : start + length].tobytes()), row)
                    for column, value in zip(found, values):
                        column.append(value)
                    row += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = [part.split()[0] for part in PIECES.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(found, types)], names=names)
        coder.rest()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, limits: Limits) -> np.ndarray:
    """The bin of each piece. ``lengths`` must fall; a piece that breaks a capacity alone is an error."""
    capacity = limits.capacity
    weight = np.array(limits.weights) / capacity**2
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1)
    if len(demand) and (demand > capacity).any():
        raise ValueError("a piece exceeds the capacities of a sequence")
    room = np.empty((max(1, len(lengths)), 3))
    number = np.empty(max(1, len(lengths)), dtype=np.int64)
    bins, opened, n = np.empty(len(lengths), dtype=np.int64), 0, 0
    for i, need in enumerate(demand):
        live = room[:n]
        fits = np.flatnonzero((live[:, 0] >= need[0]) & (live[:, 1] >= need[1]) & (live[:, 2] >= need[2]))
        if len(fits):
            left = live[fits] - need
            score = (left * left) @ weight if limits.rule == "norm" else -((live[fits] * need) @ weight)
            at = int(fits[np.argmin(score)])
            room[at] -= need
            bins[i] = number[at]
        else:
            at = n
            room[n], number[n], bins[i] = capacity - need, opened, opened
            n, opened = n + 1, opened + 1
        if (room[at] < 1).any():  # full: nothing fits any more
            n -= 1
            room[at], number[at] = room[n], number[n]
    return bins


def _place(rows: pa.Table, limits: Limits, group: int, level: int) -> pa.Table:
    length = rows.column("length").to_numpy()
    order = np.lexsort((rows.column("_row").to_numpy(), -length))
    bins = np.empty(len(length), dtype=np.int64)
    bins[order] = best_fit(length[order], limits)
    by = np.lexsort((rows.column("_row").to_numpy(), bins))
    ends = np.cumsum(length[by])
    first = np.searchsorted(bins[by], bins[by])
    offset = np.empty(len(length), dtype=np.int64)
    offset[by] = ends - length[by] - (ends - length[by])[first]
    fill = np.bincount(bins, weights=length)[bins]
    return rows.append_column("sequence_id", pa.array((np.int64(level) << 62) | (np.int64(group) << 24) | bins)).append_column("offset", pa.array(offset)).append_column("_fill", pa.array(fill))


def _packed(pieces: DataFrame, limits: Limits, group_rows: int, level: int) -> DataFrame:
    groups = max(1, math.ceil(pieces.count() / group_rows))
    columns = [part.split()[0] for part in PIECES.split(", ")]

    def run(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        return _place(rows.select(columns), limits, key[0].as_py(), level)

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, f"{PIECES}, sequence_id long, offset long, _fill double")


def pack(docs: DataFrame, tokenizer: str, limits: Limits | None = None, group_rows: int = 8192, short: float = 0.97) -> DataFrame:
    """One row per piece of ``docs`` with its sequence and its place there.

    Sequences of a group that are filled below ``short`` are taken apart and
    their pieces packed once more, dealt to new groups. Columns beyond doc_id and
    text are ignored; an empty table gives no rows.
    """
    limits = limits or Limits()
    pieces = stored(pieces_of(docs, tokenizer, limits.tokens), "pieces")
    first = stored(_packed(pieces, limits, group_rows, 0), "packed")
    done = F.col("_fill") >= short * limits.tokens
    names = [part.split()[0] for part in PACKED.split(", ")]
    again = _packed(first.filter(~done).drop("sequence_id", "offset", "_fill"), limits, group_rows, 1)
    return first.filter(done).select(*names).unionByName(again.select(*names))
