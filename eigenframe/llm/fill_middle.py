"""Fill-in-the-middle: a text is cut in three, and its middle moves to the end behind markers.

Texts stay UTF-8 bytes. Cuts between words are found on bytes, where white space is
always one byte; cuts between characters are numbers of code points. A sparse index
of exceptions turns one into the other: it holds only the characters of more than one
byte, with the bytes they take beyond one. A cut is then found by one search among
the exceptions and an addition, and pure ASCII needs no index at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.llm.common import slices, text_bytes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Rules:
    """What is transformed, and how; all choices follow from a hash of ``seed`` and the document's id."""

    seed: int = 42
    rate: int = 50  # texts of a hundred that are transformed
    spm: int = 80  # of a hundred transformed ones, those with the suffix first
    unit: str = "word"  # cuts between words, each with the white space before it; or "character"
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")  # before prefix, suffix, middle

    def __post_init__(self):
        if self.unit not in ("word", "character"):
            raise ValueError(f"unit is word or character, not {self.unit!r}")
        if len(set(self.markers)) < 3 or any(a in b for a in self.markers for b in self.markers if a is not b):
            raise ValueError("markers must differ, and none may hold another")


class Exceptions:
    """The characters of more than one byte in UTF-8 ``data``, and what follows from them."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)  # where such a character begins
        first = data[self.byte]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.before = np.concatenate(([0], np.cumsum(excess)))  # bytes beyond one, of the first k exceptions
        self.char = self.byte - self.before[:-1]
        self.chars = len(data) - int(self.before[-1])

    def to_chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each cut, given in bytes; a cut must not fall inside a character."""
        return cuts - self.before[np.searchsorted(self.byte, cuts)]

    def to_bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut, given in code points."""
        return cuts + self.before[np.searchsorted(self.char, cuts)]


def word_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets behind the units of ``data``: words with the white space before them, and white space at the end."""
    space = _SPACE[data]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and space[-1] else ends


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four numbers of 32 bits; a NULL id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def transformed(text: bytes, doc_id: int | None, rules: Rules) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    data = np.frombuffer(text, dtype=np.uint8)
    index = Exceptions(data)
    ends = word_ends(data) if rules.unit == "word" else None
    n = index.chars if ends is None else len(ends)
    h1, h2, h3, h4 = draws(doc_id, rules.seed)
    marks = [m.encode() for m in rules.markers]
    if not n or h3 % 100 >= rules.rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    units = np.sort([h1 % (n + 1), h2 % (n + 1)])
    if ends is None:
        chars, cuts = units, index.to_bytes(units)
    else:
        cuts = np.append(0, ends)[units]
        chars = index.to_chars(cuts)
    a, b = cuts.tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    spm = h4 % 100 < rules.spm
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return n, "spm" if spm else "psm", int(chars[0]), int(chars[1] - chars[0]), output


def fill_in_middle(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    ``n`` is the number of units of the whole text, ``form`` plain, psm or spm. A plain
    text is its own output, and its two lengths are NULL: an empty or NULL text, one that
    holds a marker, and those the rate leaves out. Repeated rows and ids give a row
    each and the same cuts; rows without an id share one draw. A prefix, middle or
    suffix may be empty. Columns beyond doc_id and text are ignored, and an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            rows = [(i, *transformed(t, i, rules)) for i, t in zip(ids, text_bytes(batch.column(1)))]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return out.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: str | Column, form: str | Column, rules: Rules = Rules()) -> Column:
    """The text that ``fill_in_middle`` was given, from what it made of it."""
    whole, kind = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    p, s, m = rules.markers
    middle, head = part(whole, m, 2), part(whole, m, 1)
    psm = F.concat(part(part(head, s, 1), p, 2), middle, part(head, s, 2))
    spm = F.concat(part(head, p, 2), middle, part(part(head, p, 1), s, 2))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(whole)
