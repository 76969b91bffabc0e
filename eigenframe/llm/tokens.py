"""Token ids of whole texts, by a byte-level BPE file of the ``tokenizers`` library.

The library's pre-tokeniser never joins the characters on both sides of a border
between a non-space and a space, so a text in which every white space stands
alone may be encoded word by word (each with the space before it). Words repeat:
each distinct one goes through the library once per worker, and ids are put
together by array gathers. A word of letters with marks behind them is put together
from both, which the pre-tokeniser parts too. Texts with longer runs of white space, or with white
space beyond ASCII, go through the library whole, and so do texts that hold the string of
an added token (such as ``<|endoftext|>``, which the library gives its own id). Both
ways give the library's ids, with its own settings.

The words remembered are bounded: when there are ``remember`` of them they become the
older generation, from which words still in use move back into the younger one, so
frequent words are learned once while rare ones come and go. A task that ends calls
``rest``.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from eigenframe.llm.common import release

#: Texts that must be encoded whole: white space in runs, at an end, or of another kind; the marker \x01.
IRREGULAR = (
    r"(^|[ \t-\r])([ \t-\r]|$)|[\t\x0b-\r\x1c-\x1f\x01]|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_MARKS = string.punctuation  # ASCII


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str, remember: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember, self.known, self.older, self.marks = remember, {}, {}, {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """An array of unsigned 32-bit ids for each text; a NULL is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False)
        for token in self.added:
            whole = whole | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        plain = np.flatnonzero(~whole)
        if len(plain):
            for at, ids in zip(plain.tolist(), self._by_words(texts.take(pa.array(plain)))):
                out[at] = ids
        rest = np.flatnonzero(whole).tolist()
        for k in range(0, len(rest), 64):
            some = rest[k : k + 64]
            found = self.tokenizer.encode_batch_fast([texts[i].as_py() for i in some], add_special_tokens=False)
            for at, e in zip(some, found):
                out[at] = np.array(e.ids, dtype=np.uint32)
        return out

    def _by_words(self, texts: pa.Array) -> list[np.ndarray]:
        marked = pc.binary_join_element_wise(pa.scalar("\x01"), pc.replace_substring(texts, "\n", " \n"), "")
        split = pc.split_pattern(marked, " ")
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        ids = self._look_up(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        pool, starts = np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(lengths) - lengths
        each = lengths[which]
        ends = np.cumsum(each)
        at = np.repeat(starts[which] - (ends - each), each) + np.arange(int(ends[-1]))
        edges = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.split(pool[at], edges[1:-1])

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as bytes."""
        if len(self.known) > self.remember:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = list(map(known.get, words))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        for i in gaps if older else ():
            if (ids := older.get(words[i])) is not None:
                known[words[i]] = out[i] = ids
        first, plain, parted = [], {}, {}
        for i in gaps:
            if out[i] is None:
                w = words[i]
                letters = w.rstrip(_MARKS)
                if w[:1] == "\x01":  # of a text: no space before it
                    first.append(w)
                elif letters is not w and letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
                    parted[i] = letters  # the pre-tokeniser always parts letters and marks
                    if letters not in known:
                        plain[letters] = None
                else:
                    plain[w] = None
        for w, e in zip(first, self.tokenizer.encode_batch_fast([w[1:] for w in first], add_special_tokens=False)):
            known[w] = np.array(e.ids, dtype=np.uint32).tobytes()
        spaced = list(plain)
        for k in range(0, len(spaced), 2000):
            self._learn(spaced[k : k + 2000])
        for i in gaps:
            if out[i] is None:
                letters = parted.get(i)
                out[i] = known[words[i]] if letters is None else known[letters] + self._marks(words[i][len(letters) :])
        return out

    def rest(self) -> None:
        """Between tasks the older words go: a worker lives on, and its next task may be another stage's."""
        self.older = {}
        release()

    def _marks(self, marks: str) -> bytes:
        """Ids of a run of marks that follows a letter."""
        ids = self.marks.get(marks)
        if ids is None:
            if len(self.marks) > 10_000:
                self.marks.clear()
            ids = np.array(self.tokenizer.encode(marks, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
            self.marks[marks] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        units = [w if w[:1] == "\n" else " " + w for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(units)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.cumsum(pc.binary_length(pa.array(units, pa.string())).to_numpy().astype(np.int64))
        covered = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(covered, ends) + 1
        if not np.array_equal(covered[cut - 1], ends):
            raise AssertionError("a token spans two words")
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (cut * 4).tolist()):
            self.known[w], at = data[at:end], end
