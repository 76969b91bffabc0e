"""Token files: ids of whole documents under one canonical, length-limited Huffman code.

Documents are put in ascending doc_id order by ranges, encoded, and kept as raw
segments; their ids are counted over the whole corpus; the code lengths follow from
the counts by package-merge. Each segment is then written on its own. Every
``STRIDE`` ids a checkpoint keeps the bit offset, so that decoding runs through all
stretches of a segment side by side, one table look-up per id.

A file, numbers little-endian:

    magic "EFTK", u32 version, u32 vocabulary, u8 code length of each id (0: unused)
    segments, each: u32 documents, u32 ids, u64 bits' bytes, u64 start of the segment in
        its range, documents x (u8 id is known, i64 doc_id, u64 ids),
        ceil(ids / STRIDE) x u64 bit offset, bits (big-endian 32-bit words)
    magic "END.", u64 segments

Files get their names when they are closed, and a table lists them: what a lost or
doubled attempt leaves behind is never on it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eigenframe.llm.common import shared_uri, slices
from eigenframe.llm.tokens import encoder
from eigenframe.plans.durable import stored

MAGIC, END, VERSION = b"EFTK", b"END.", 1
STRIDE = 128
LONGEST = 18  # bits of a code word, for vocabularies of up to 2**18 ids
SEGMENT = 1 << 18  # ids of a segment, unless one document has more
DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ids", "<u8")])


class Damaged(ValueError):
    """A token file that is cut short or does not decode to its own checkpoints."""


# -- the code ---------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids do not fit codes of {longest} bits")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < len(leaves))
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.int64)
    for row in reversed(is_leaf):
        n = int(row[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: by length, then by id, each the one before plus one."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for k in order.tolist():
        code <<= int(lengths[k]) - last
        last = int(lengths[k])
        codes[k], code = code, code + 1
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical(lengths)
        self.top = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.top - self.lengths[order])
        self.table_id = np.zeros(1 << self.top, dtype=np.uint32)
        self.table_bits = np.ones(1 << self.top, dtype=np.int64)
        self.table_id[: spans.sum()] = np.repeat(order, spans)
        self.table_bits[: spans.sum()] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offsets of the checkpoints, and the bits."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        if len(ids) and not bits.all():
            raise ValueError("an id without a code")
        value = self.codes[ids] << (64 - bits - (at & 31)).astype(np.uint64)
        word, n = at >> 5, int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)  # exact: below 2**53
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        return at[::STRIDE].astype("<u8"), (high + low).astype(">u4").tobytes()

    def decode(self, n: int, offsets: np.ndarray, bits: bytes) -> np.ndarray:
        """``n`` ids; every stretch from its checkpoint, all together."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        words = np.concatenate([np.frombuffer(bits, dtype=">u4"), np.zeros(STRIDE * self.top // 32 + 3, dtype=">u4")]).astype(np.uint64)
        window = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = offsets.astype(np.int64), np.empty((STRIDE, len(offsets)), dtype=np.uint32)
        last, mask = len(window) - 1, np.uint64((1 << self.top) - 1)
        for step in range(STRIDE):
            word = np.minimum(at >> 5, last)
            key = (window[word] >> (64 - self.top - (at & 31)).astype(np.uint64)) & mask
            out[step] = self.table_id[key]
            at = at + self.table_bits[key]
        if not np.array_equal(at[:-1], offsets[1:].astype(np.int64)):
            raise Damaged("a stretch does not end at the next checkpoint")
        return out.T.reshape(-1)[:n]


# -- files ------------------------------------------------------------------


def write_segment(code: Code, docs: list[int | None], counts: np.ndarray, start: int, ids: np.ndarray) -> bytes:
    offsets, bits = code.encode(ids)
    table = np.zeros(len(docs), dtype=DOC)
    table["known"] = [d is not None for d in docs]
    table["doc_id"] = [d or 0 for d in docs]
    table["ids"] = counts
    return struct.pack("<IIQQ", len(docs), len(ids), len(bits), start) + table.tobytes() + offsets.tobytes() + bits


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise Damaged("the file is cut short")
    return data


def read_file(stream: BinaryIO) -> Iterator[tuple[list[int | None], np.ndarray, int, np.ndarray]]:
    """(doc ids, ids of each, start in its range, all ids) of each segment, from front to back."""
    if _exactly(stream, 4) != MAGIC:
        raise Damaged("not a token file")
    version, vocabulary = struct.unpack("<II", _exactly(stream, 8))
    if version != VERSION:
        raise Damaged(f"version {version}")
    code, seen = Code(np.frombuffer(_exactly(stream, vocabulary), dtype=np.uint8)), 0
    while True:
        head = _exactly(stream, 12)
        if head[:4] == END:
            if struct.unpack("<Q", head[4:])[0] != seen:
                raise Damaged("segments are missing")
            return
        documents, n, size, start = struct.unpack("<IIQQ", head + _exactly(stream, 12))
        table = np.frombuffer(_exactly(stream, documents * DOC.itemsize), dtype=DOC)
        offsets = np.frombuffer(_exactly(stream, -(-n // STRIDE) * 8), dtype="<u8")
        docs = [d if k else None for k, d in zip(table["known"].tolist(), table["doc_id"].tolist())]
        yield docs, table["ids"].astype(np.int64), start, code.decode(n, offsets, _exactly(stream, size))
        seen += 1


RAW = "part int, seq int, start long, docs array<long>, counts array<long>, ids binary"


def raw_segments(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Segments of ids in ascending doc_id order (NULL first, equal ids by a hash of their text)."""
    wide = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids, held, names = [], 0, []
        coder = encoder(tokenizer)

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, ids, held, names
            counts = [len(x) for x in ids]
            row = [[part], [seq], [start], [names], [counts], [np.concatenate(ids).astype(wide).tobytes()]]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            seq, start, ids, held, names = seq + 1, start + held, [], 0, []
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, types)], names=[x.split()[0] for x in RAW.split(", ")])

        for batch in slices(batches, 1):
            for doc, found in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                if ids and held + len(found) + 1 > SEGMENT:
                    yield flush()
                ids.append(np.append(found, np.uint32(end_id)))
                names.append(doc)
                held += len(found) + 1
        if ids:
            yield flush()
        coder.rest()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    ranged = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    return ranged.select("doc_id", "text").mapInArrow(run, RAW)


def global_counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all segments; the driver gets one row for each id of the vocabulary at most."""
    wide = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts += np.bincount(np.frombuffer(data.as_buffer(), dtype=wide), minlength=vocabulary)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], names=["id", "n"])

    found = raw.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(vocabulary, dtype=np.int64)
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


FILES = "file string, part int, seq int, documents long, ids long"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write token files of ``docs`` (doc_id, text) below ``folder``; the table of files, already made, with ``base``.

    ``base`` counts the ids of all ranges before the file's. A NULL text is empty, so
    each row has at least its end id; rows with a NULL or repeated id are kept. Other
    columns are ignored. An empty table makes no files.
    """
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size()
    raw = stored(raw_segments(docs, tokenizer, end_id), "raw-ids")
    lengths = code_lengths(global_counts(raw, vocabulary))
    wide = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        code = Code(shared.value)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, at, documents, ids, segments = None, (0, 0), 0, 0, 0
        hidden = name = ""

        def close() -> pa.RecordBatch:
            out.write(END + struct.pack("<Q", segments))
            out.close()
            store.move(hidden, name)
            row = (name, first[0], first[1], documents, ids)
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types)], names=[x.split()[0] for x in FILES.split(", ")])

        for batch in batches:
            for part, seq, start, names, counts, data in zip(*(batch.column(i) for i in range(6))):
                here = (part.as_py(), seq.as_py())
                if out is not None and here != (at[0], at[1] + 1):
                    yield close()
                    out = None
                if out is None:
                    first, documents, ids, segments = here, 0, 0, 0
                    tag = uuid.uuid4().hex
                    hidden, name = f"{root}/.{tag}", f"{root}/{here[0]:07d}-{here[1]:07d}-{tag}.eftk"
                    out = store.open_output_stream(hidden, compression=None)
                    out.write(MAGIC + struct.pack("<II", VERSION, vocabulary) + shared.value.tobytes())
                found = np.frombuffer(data.as_buffer(), dtype=wide)
                of_each = np.array(counts.as_py(), dtype=np.uint64)
                out.write(write_segment(code, names.as_py(), of_each, start.as_py(), found))
                at, documents, ids, segments = here, documents + len(of_each), ids + len(found), segments + 1
        if out is not None:
            yield close()

    files = stored(raw.mapInArrow(run, FILES), "token-files")
    totals = files.groupBy("part").agg(F.sum("ids").alias("n"))  # a row per range
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return stored(files.join(bases, F.col("part") == F.col("_part")).drop("_part"), "token-files")


def read(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files, and with ``with_ids`` its ids.

    Each file is one task's work, a segment at a time. ``start`` counts the ids of all documents before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base, documents in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for docs, counts, start, ids in read_file(stream):
                        ends = np.cumsum(counts)
                        data = memoryview(ids.astype("<u4").tobytes())
                        cuts = list(zip(((ends - counts) * 4).tolist(), (ends * 4).tolist()))
                        crc = [zlib.crc32(data[a:b]) for a, b in cuts]
                        columns = [pa.array(docs, pa.int64()), pa.array(base + start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64))))
                            names.append("ids")
                        seen += len(docs)
                        yield pa.record_batch(columns, names=names)
                if seen != documents:
                    raise Damaged(f"{name}: {seen} documents instead of {documents}")

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    spread = files.select("file", "base", "documents").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and read them back."""
    folder = shared_uri(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder, end_id), folder, with_ids)
