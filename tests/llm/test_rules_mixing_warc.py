import hashlib
import io
import math
import re
from collections import Counter

import numpy as np
import pytest
from odd import no_documents, odd_documents, rows, words
from pyspark.sql import functions as F

from eigenframe.llm import divergence, mixing, warc
from eigenframe.llm.common import shared_uri

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# -- divergence -------------------------------------------------------------


def plain_base(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), symbols, dup, len(covered), failed)


EXTRA = [
    (20, "a b a b a b a b\nx\nx\n\n\nx", "en", "a"), (21, "x y z " * 40, "en", "a"), (22, words(70, 3) + "\n" + words(70, 3), "en", "b"),
    (23, "#a *b $c %d &e |f <g >h\x0b\x0cq w", None, "a"), (24, " ".join("w%d" % (i % 60) for i in range(100)), "de", "b"),
]


def more(spark):
    extra = [(d, t, la, s, 1, 0.5, 7, 8, 9, 10, 11) for d, t, la, s in EXTRA]
    return odd_documents(spark).union(spark.createDataFrame(extra, odd_documents(spark).schema))


def test_base_rules(spark):
    docs = more(spark)
    got = divergence.judge(docs, divergence.learn(docs)).collect()
    want = sorted((str(d), *plain_base(t)) for d, t, *_ in [*rows(), *EXTRA])
    assert sorted((str(r["doc_id"]), *[r[c] for c in divergence.BASE], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_distance(spark):
    rng = np.random.RandomState(0)
    cases = [(rng.randint(0, 9, 5).tolist(), rng.dirichlet(np.ones(5)).tolist()) for _ in range(10)] + [([0, 0], [0.5, 0.5]), ([3, 1], [0.75, 0.25]), ([1, 0], [0.0, 1.0])]
    for counts, q in cases:
        n = sum(counts)
        row = spark.range(1).select(divergence.distance(F.array(*[F.lit(c) for c in counts]), F.lit(n), q).alias("d")).first()
        if not n:
            assert row["d"] == 1
            continue
        p, q = np.array(counts) / n, np.array(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        assert row["d"] == pytest.approx(math.sqrt(max(0, (kl(p) + kl(q)) / 2)), abs=1e-7)


def test_references_and_verdicts(spark):
    rng = np.random.RandomState(5)
    def text(common, rare, n=150):
        return " ".join(rng.choice(common) if rng.rand() < 0.4 else "".join(rng.choice(list(rare), 6)) for _ in range(n)) + "."
    clean = [(i, text(["the", "of", "and"], "abcdefgh"), "en") for i in range(30)] + [(100 + i, text(["der", "und"], "mnopqrs"), "de") for i in range(30)]
    junk = [(200, " ".join("xk%d|" % i for i in range(120)), None), (201, " ".join("Q%d!!" % i for i in range(120)).upper(), None)]
    docs = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")
    refs = divergence.learn(docs)
    assert [r.lang for r in refs] == ["de", "en"]
    assert {"der", "und"} <= set(refs[0].words) and {"the", "of", "and"} <= set(refs[1].words)
    assert all(sum(r.classes) == pytest.approx(1) and sum(r.shares) == pytest.approx(1) for r in refs)
    got = {r["doc_id"]: r for r in divergence.judge(docs, refs).collect()}
    assert sum(not r["kept"] for d, r in got.items() if d < 200) == 0
    assert not got[200]["kept"] and not got[201]["kept"]
    plan = divergence.judge(docs, refs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("inline", [1, 16])
def test_small_languages_are_held_against_themselves(spark, monkeypatch, inline):
    monkeypatch.setattr(divergence, "INLINE", inline)
    rng = np.random.RandomState(6)
    def text(common, rare, n=150):
        return " ".join(rng.choice(common) if rng.rand() < 0.4 else "".join(rng.choice(list(rare), 6)) for _ in range(n)) + "."
    big = [(i, text(["the", "of", "and"], "abcdefgh", 900), "en") for i in range(120)]
    small = [(1000 + i, text(["og", "er"], "klmnop"), "no") for i in range(5)] + [(1010 + i, text(["ja", "ei", "on"], "qrstu"), "fi") for i in range(5)]
    lone = [(1020, text(["ka", "te"], "vwxyz"), "mi"), (1021, text(["og", "er"], "klmnop"), None)]
    junk = [(2000, " ".join("xk%d|" % i for i in range(120)), "mi"), (2001, text(["zu", "zo"], "abc"), "no"), (2002, text(["zu", "zo"], "abc"), None)]
    docs = spark.createDataFrame(big + small + lone + junk, "doc_id long, text string, lang string")
    rules = divergence.Rules(least_words=700)
    refs = divergence.learn(docs, rules)
    assert [r.lang for r in refs] == ["en", "fi", "no"]
    got = {r["doc_id"]: r["kept"] for r in divergence.judge(docs, refs, rules).collect()}
    assert {d for d, kept in got.items() if not kept} == {2000, 2001, 2002}


def test_divergence_without_documents(spark):
    assert divergence.learn(no_documents(spark)) == []
    assert divergence.judge(no_documents(spark), []).collect() == []


# -- mixing -----------------------------------------------------------------


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * left / open_ > most * sizes[s]} if open_ else set()
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * left / open_ for s in names}
        full |= over


def sized(n, seed):
    rng = np.random.RandomState(seed)
    sources = [None, "", "Z", "a", "é", "b", "c"]
    return [(i, words(int(rng.randint(1, 60)) if rng.rand() > 0.1 else 0, int(rng.randint(1e6))), sources[int(rng.choice(7, p=[0.34, 0.06, 0.1, 0.2, 0.1, 0.1, 0.1]))]) for i in range(n)]


@pytest.mark.parametrize("group_rows", [16, 1024])
def test_mix(spark, group_rows):
    data = sized(400, 1)
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.decide(df, group_rows=group_rows).collect()
    again = mixing.decide(df.repartition(5), group_rows=group_rows).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(t.split())
    targets = plain_targets(sizes)
    taken, copies = Counter(), Counter()
    for r in got:
        assert r["size"] == len(data[r["doc_id"]][1].split()) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
        copies[r["source"]] += r["copies"]
    n = Counter(s for *_, s in data)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(3, 0.01 * targets[s]), s
        assert abs(copies[s] - n[s] * targets[s] / sizes[s]) <= 4, s


def test_flight_keeps_both_sums():
    rng = np.random.RandomState(2)
    for n in (0, 1, 2, 3, 50, 300):
        p, x = rng.uniform(0, 1, n), rng.randint(0, 40, n).astype(float)
        out = mixing.flight(p, x)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ x == pytest.approx(p @ x, abs=1e-5)
        assert set(np.unique(mixing.settle(p, x))) <= {0.0, 1.0}
    equal = mixing.flight(np.full(30, 0.5), np.full(30, 7.0))
    assert equal.sum() == pytest.approx(15)


def test_flight_keeps_expectations():
    x = np.array([1.0, 2, 3, 5, 8, 13, 21, 34])
    mean = np.mean([mixing.flight(np.full(8, 0.4), x + 1e-7 * k) > 0.5 for k in range(600)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.15


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    got = mixing.decide(docs).collect()
    assert len(got) == len(rows())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert Counter(str(r["doc_id"]) for r in mixed.collect()) == Counter(str(r["doc_id"]) for r in got for _ in range(r["copies"]))
    assert mixing.mixed(no_documents(spark)).collect() == [] and mixing.decide(no_documents(spark)).collect() == []


# -- WARC -------------------------------------------------------------------

PAGES = [
    (1, "http://a/1", "x" * 1000), (2, "http://a/2", "x" * 1000), (3, "http://a/é ü", "x" * 1000), (4, None, "y" * 999), (5, "u", "y" * 999),
    (6, "u", None), (7, "u", ""), (8, "u\r\nWARC-Type: evil", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "x" * 1000), (9, "u", "é" * 600), (9, "v", "é" * 600),
    (10, "u", "é" * 600), (10, "w", "é" * 600), (11, "u", "long " * 300_000), (None, "u", "z" * 2000), (None, "u", "z" * 2000),
]


def plain_records():
    out, best = [], {}
    for p, _, h in PAGES:
        if h and len(h.encode()) >= 1000 and p is not None:
            best[h] = max(best.get(h, p), p)
    for p, _, h in PAGES:
        data = (h or "").encode()
        first = best.get(h) if len(data) >= 1000 else None
        revisit = first is not None and first != p
        out.append((str(p), len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", str(first if revisit else None)))
    return sorted(out)


@pytest.mark.parametrize("archive_bytes", [1 << 28, 500])
def test_round_trip(spark, archive_bytes):
    pages = spark.createDataFrame([(*p, "extra", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int").repartition(3)
    folder = shared_uri(spark, "warc")
    archives = warc.write(pages, folder, archive_bytes=archive_bytes)
    got = warc.read(archives, folder, payloads=True).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in got) == plain_records()
    for r in got:
        if r["record_type"] == "response":
            assert len(r["payload"]) == r["payload_bytes"] and hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
        else:
            assert r["payload"] is None
    assert all("\r" not in r["url"] for r in got)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_members_are_framed_and_verified():
    one, two = (warc.record(i, "u", b"p" * i, warc._sha1(b"p" * i), None, False) for i in (5, 200_000))
    assert [warc.parse(m)["payload_bytes"] for m in warc.members(io.BytesIO(one + two + one))] == [5, 200_000, 5]
    with pytest.raises(warc.Damaged):
        list(warc.members(io.BytesIO(one + two[:-20])))
    member = next(warc.members(io.BytesIO(one)))
    for broken in (member.replace(b"ppppp", b"ppqpp"), member[:-1], member.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"x" + member):
        with pytest.raises(warc.Damaged):
            warc.parse(broken)
    bad = bytearray(one)
    bad[len(bad) // 2] ^= 0xFF
    with pytest.raises(warc.Damaged):
        [warc.parse(m) for m in warc.members(io.BytesIO(bytes(bad)))]
