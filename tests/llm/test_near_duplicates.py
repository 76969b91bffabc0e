import random

import numpy as np
import pytest
import xxhash
from odd import no_documents, odd_documents, rows, words

from eigenframe.llm import simhash, spans
from eigenframe.llm.components import components


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "repeats"])
def test_components(spark, kind):
    rng = random.Random(kind)
    pairs = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(i, i + 1) for i in rng.sample(range(150), 150)],
        "star": [(500, i) for i in range(100)],
        "repeats": [(1, 2), (2, 1), (1, 2), (3, 3), (-4, 2)],
    }[kind]
    df = spark.createDataFrame([*pairs, (None, 5)], "x long, y long")
    got = components(df, "x", "y").collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == union_find(pairs)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ["", " \x0b", "A", "a b c d", "A b\nC d e f g", "é É a b c", words(300, 5)]:
        assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def plain_groups(docs):
    fps = [(d, plain_fingerprint(t)) for d, t in docs]
    root = union_find([(i, j) for i in range(len(fps)) for j in range(i + 1) if (fps[i][1] ^ fps[j][1]).bit_count() <= 4])
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted((str(d), f, str(least.get(root[i]))) for i, (d, f) in enumerate(fps))


def varied(n):
    """Copies of a few texts with some words changed: long chains of close fingerprints."""
    rng, out = random.Random(3), []
    base = [words(150, s).split() for s in range(3)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = rng.choice("xyz") * 4
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("cell_rows,blocks", [(8192, None), (3, 5), (7, 8)])
def test_near_groups(spark, cell_rows, blocks):
    docs = varied(90)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash.near_groups(df, cell_rows=cell_rows, blocks=blocks).collect()
    assert sorted((str(r[0]), r[1] & (1 << 64) - 1, str(r[2])) for r in got) == plain_groups(docs)


def test_near_groups_of_odd_documents(spark):
    got = simhash.near_groups(odd_documents(spark)).collect()
    assert sorted((str(r[0]), r[1] & (1 << 64) - 1, str(r[2])) for r in got) == plain_groups([r[:2] for r in rows()])
    assert simhash.near_groups(no_documents(spark)).collect() == []


def test_first_of_each(spark):
    docs = odd_documents(spark)
    got = simhash.first_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(str(r["doc_id"]) for r in got.collect())
    groups = {}
    for d, f, c in plain_groups([r[:2] for r in rows()]):
        groups.setdefault((c, f) if c == "None" else c, []).append(d)
    assert kept == sorted(c if isinstance(c, str) else c[0] for c in groups)
    assert simhash.first_of_each(no_documents(spark)).collect() == []


@pytest.mark.parametrize("n", [2, 5, 40, 300])
def test_close_forest_spans_what_is_close(n):
    rng = np.random.RandomState(n)
    fp = np.unique(np.uint64(0xDEADBEEF) ^ (np.uint64(1) << rng.randint(0, 12, n).astype(np.uint64)) ^ (np.uint64(1) << rng.randint(0, 64, n).astype(np.uint64)))
    found = simhash.close_forest(fp, 2)
    pairs = [(int(x), int(y)) for a, b in found for x, y in zip(a, b)]
    every = [(int(x), int(y)) for x in fp for y in fp if x < y and int(x ^ y).bit_count() <= 2]
    assert len(pairs) < len(fp) and union_find(pairs) == union_find(every)


# -- spans ------------------------------------------------------------------


def test_sentences_cover_the_text():
    for _, text, *_ in rows():
        ends, counts = spans.sentences(text or "")
        assert sum(counts) == len((text or "").split())
        assert ends == sorted(set(ends)) and (not ends or ends[-1] == len(text))


def test_a_pasted_passage_is_cut_alike():
    passage = words(70, 9)
    a, b = (set(x[0] for x in spans.spans(f"{words(13, s)} lead {passage} tail {words(13, s + 1)}")) for s in (10, 20))
    assert len(a & b) >= 3


def test_remove_repeats(spark):
    passage, own = words(60, 30), [words(80, s) for s in range(40, 46)]
    docs = [(i, f"{own[i]} {passage} {own[i][::-1]}") for i in range(5)] + [(5, own[5]), (6, None), (7, ""), (None, passage), (8, passage + "\n" + words(60, 50) + "\n" + passage)]
    df = spark.createDataFrame([(d, t, "keep") for d, t in docs], "doc_id long, text string, h string")
    got = {r["doc_id"]: r for r in spans.remove_repeats(df).collect()}
    assert len(got) == len(docs) and all(r["h"] == "keep" for r in got.values())
    assert got[0]["text"] == docs[0][1] and got[0]["removed_words"] == 0  # the first keeps it
    middle = " ".join(passage.split()[15:50])
    for i in range(1, 5):
        assert middle not in " ".join(got[i]["text"].split()) and got[i]["removed_words"] >= 40
        assert all(w in got[i]["text"] for w in own[i].split()[:60])
    assert got[5]["text"] == own[5] and got[6]["text"] is None and got[7]["text"] == ""
    assert got[None]["text"] == "" and got[None]["removed_words"] == 60
    assert middle not in " ".join(got[8]["text"].split())


def test_remove_repeats_like_a_plain_loop(spark):
    docs = [(d, t) for d, t in varied(40)]
    seen, want = {}, {}
    for d, t in sorted(docs):
        found, here = spans.spans(t), set()
        cover = []
        for h, a, b in found:
            if seen.get(h, d) != d or h in here:
                cover.append((a, b))
            here.add(h)
        for h in here:
            seen.setdefault(h, d)
        want[d] = spans.without(t, cover)[0] if cover else t
    got = spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_remove_repeats_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = spans.remove_repeats(docs)
    assert got.columns == [*docs.columns, "removed_sentences", "removed_words"]
    out = got.collect()
    assert len(out) == len(rows()) and sum(r["text"] is None for r in out) == 2
    assert spans.remove_repeats(no_documents(spark)).collect() == []


def test_rows_without_an_id_are_documents_of_their_own(spark):
    passage = words(60, 30)
    docs = [f"{words(80, s)}\n{passage}\n{words(80, s + 1)}" for s in (60, 70, 80)]
    got = [r["removed_words"] for r in spans.remove_repeats(spark.createDataFrame([(None, t) for t in docs], "doc_id long, text string")).collect()]
    assert sorted(n >= 40 for n in got) == [False, True, True] and min(got) == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_are_told_apart(spark, doc_id):
    passage, seen = words(60, 90), {}
    for i in range(100_000):  # two texts whose hashes agree in 24 bits
        text = f"{passage if i % 2 else words(60, 91)}\nlast {i}."
        other = seen.setdefault(xxhash.xxh64_intdigest(text, 42) & 0xFFFFFF, (i, text))
        if (i - other[0]) % 2:
            break
    lone, repeated = sorted((text, other[1]), key=lambda t: passage in t)
    docs = [(1, passage), (doc_id, lone), (doc_id, repeated)]
    got = {r["text"]: r["removed_words"] for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[lone] == 0 and got[passage] == 0 and repeated not in got


def unspaced(n, seed, letters, marks):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) + (rng.choice(marks) if marks and rng.random() < 0.08 else "") for _ in range(n))


@pytest.mark.parametrize(
    "first,last,marks", [(0x4E00, 0x9FFF, "，。？"), (0x4E00, 0x9FFF, ""), (0x3041, 0x3096, "、。"), (0x0E01, 0x0E2E, ""), (0x0E01, 0x0E2E, " ")],
    ids=["han", "han without marks", "kana", "thai", "thai phrases"],
)
def test_repeats_in_scripts_without_spaces(spark, first, last, marks):
    letters = [chr(c) for c in range(first, last + 1)]
    passage, own = unspaced(400, 1, letters, marks), [unspaced(300, s, letters, marks) for s in range(2, 8)]
    docs = [(i, own[2 * i] + passage + own[2 * i + 1]) for i in range(3)]
    for _, t in docs:
        ends, counts = spans.sentences(t)
        assert ends == sorted(set(ends)) and ends[-1] == len(t) and len(ends) == len(counts) > 10
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == docs[0][1]
    for i in (1, 2):
        assert passage[100:300] not in got[i] and len(got[i]) < len(docs[i][1]) - 250
        assert own[2 * i][:200] in got[i] and own[2 * i + 1][100:].rstrip() in got[i]


def test_latin_spans_beside_unspaced_text():
    plain = words(200, 5)
    alone, beside = ({x[0] for x in spans.spans(t)} for t in (plain, plain + "\n数据数据。数据数据。"))
    assert alone <= beside
    assert spans.spans("abc。def。ghi jkl。" * 20)  # full-width marks inside words of other scripts
