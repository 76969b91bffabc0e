import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents, rows

from eigenframe.llm import packing, token_files
from eigenframe.llm.tokens import Encoder, encoder

PARTS = st.lists(st.sampled_from(["a", "Be", "é", " ", "  ", "\n", "\n\n", "'s", "!", "12", "\t", "　", "漢字", "\x01", "😀", "\x1c", "the", ".", "<|endoftext|>", "<|endof"]), max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS.map("".join), max_size=6))
def test_ids_equal_the_library(texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [x.tolist() for x in encoder(path).encode(pa.array(texts, pa.string()))]
    assert got == [x.ids for x in unaltered(path).encode_batch(texts, add_special_tokens=False)]


def test_strings_of_added_tokens_have_the_librarys_ids(bpe):
    got = encoder(bpe).encode(pa.array(["x<|endoftext|>", "<|endoftext|> a b", "a <|endoftext|"]))
    assert got[0].tolist() == [87, 50256] and got[1].tolist()[0] == 50256 and 50256 not in got[2]


def test_few_remembered_words_give_the_same_ids(bpe):
    texts = [" ".join(f"w{i % 7}x{i * k % 91}" for i in range(60)) for k in range(12)]
    small, want = Encoder(bpe, remember=20), unaltered(bpe).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [small.encode(pa.array([t]))[0].tolist() for t in texts] == [x.ids for x in want]
    assert len(small.known) <= 20 + 91 and len(small.older) <= 20 + 91


@lru_cache(maxsize=1)
def unaltered(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(bpe, text):
    return [*unaltered(bpe).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


# -- Huffman ----------------------------------------------------------------


def huffman_cost(counts):
    import heapq

    heap, cost = sorted(counts), 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, longest):
    """The least cost over all rising length vectors that satisfy Kraft's inequality."""
    counts = sorted(counts, reverse=True)

    def search(i, low, room):
        if i == len(counts):
            return 0
        best = float("inf")
        for n in range(low, longest + 1):
            if room >= 2.0**-n:
                best = min(best, counts[i] * n + search(i + 1, n, room - 2.0**-n))
        return best

    return search(0, 1, 1.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=2, max_size=7), st.integers(3, 4))
def test_code_lengths_are_optimal(counts, longest):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts, longest)
    assert ((lengths == 0) == (counts == 0)).all() and lengths.max(initial=0) <= longest
    used = counts[counts > 0]
    if len(used) > 1:
        assert (counts * lengths).sum() == limited_cost(used.tolist(), longest)
        assert (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1


def test_without_a_limit_it_is_huffman():
    counts = np.random.RandomState(0).zipf(1.3, 3000).clip(1, 10**6)
    assert (counts * token_files.code_lengths(counts, 40)).sum() == huffman_cost(counts.tolist())


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_codec_round_trip(n):
    rng = np.random.RandomState(n)
    ids = rng.zipf(1.2, n).clip(1, 999).astype(np.uint32)
    code = token_files.Code(token_files.code_lengths(np.bincount(ids, minlength=1000)))
    offsets, bits = code.encode(ids)
    assert code.decode(n, offsets, bits).tolist() == ids.tolist()
    if n > 500:
        broken = bytearray(bits)
        broken[3] ^= 0xFF
        with pytest.raises(token_files.Damaged):
            code.decode(n, offsets + np.uint64(1), bytes(broken))


def test_token_files_round_trip(spark, bpe):
    docs = odd_documents(spark)
    out = token_files.round_trip(docs, bpe, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted((r[0] for r in rows()), key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in out] == np.concatenate(([0], np.cumsum([r["n_tokens"] for r in out])[:-1])).tolist()
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"]) for r in out)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in out) == sorted((str(r[0]), crc(ids_of(bpe, r[1]))) for r in rows())


def test_token_files_of_nothing(spark, bpe):
    assert token_files.round_trip(no_documents(spark), bpe).collect() == []


def test_cut_token_file_is_an_error(tmp_path):
    code = token_files.Code(token_files.code_lengths(np.array([3, 2, 1])))
    segment = token_files.write_segment(code, [5], np.array([3]), 0, np.array([0, 1, 2]))
    head = token_files.MAGIC + np.array([1, 3], dtype="<u4").tobytes() + code.lengths.astype(np.uint8).tobytes()
    whole = head + segment + token_files.END + np.array([1], dtype="<u8").tobytes()
    import io

    assert [x[3].tolist() for x in token_files.read_file(io.BytesIO(whole))] == [[0, 1, 2]]
    for end in (2, len(head) + 5, len(whole) - 3):
        with pytest.raises(token_files.Damaged):
            list(token_files.read_file(io.BytesIO(whole[:end])))


# -- packing ----------------------------------------------------------------


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)]
    assert packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def plain_best_fit(lengths, limits):
    bins, out = [], []
    weight = np.array(limits.weights) / limits.capacity**2
    for n in lengths:
        need = np.array([n, 1, float(n) ** 2])
        fits = [(((room - need) ** 2 @ weight) if limits.rule == "norm" else -((room * need) @ weight), i) for i, room in enumerate(bins) if (room >= need).all()]
        if fits:
            i = min(fits)[1]
            bins[i] = bins[i] - need
        else:
            i = len(bins)
            bins.append(limits.capacity - need)
        out.append(i)
    return out, bins


@pytest.mark.parametrize("limits", [packing.Limits(100), packing.Limits(100, documents=3), packing.Limits(100, attention=4000.0, rule="dot")])
def test_best_fit_respects_every_capacity(limits):
    rng = np.random.RandomState(5)
    lengths = np.sort(rng.randint(1, 60, 400))[::-1]
    got = packing.best_fit(lengths, limits)
    plain, _ = plain_best_fit(lengths, limits)
    tokens, docs, cost = (np.bincount(got, w) for w in (lengths, np.ones(400), lengths.astype(float) ** 2))
    assert tokens.max() <= 100 and docs.max() <= limits.capacity[1] and cost.max() <= limits.capacity[2]
    assert abs(len(set(got.tolist())) - len(set(plain))) <= 1


def test_a_piece_beyond_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([50]), packing.Limits(100, attention=100.0))


@pytest.mark.parametrize("group_rows", [4, 8192])
def test_pack(spark, bpe, group_rows):
    out = packing.pack(odd_documents(spark), bpe, group_rows=group_rows).collect()
    want = []
    for d, t, *_ in rows():
        ids = ids_of(bpe, t)
        want += [(str(d), k, s, n, crc(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted((str(r[0]), *r[1:5]) for r in out) == sorted(want)
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    if group_rows > 100:
        assert len(places) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_pack_nothing(spark, bpe):
    assert packing.pack(no_documents(spark), bpe).collect() == []
