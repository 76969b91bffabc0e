import random
import re

import numpy as np
import pytest
from odd import no_documents, odd_documents, rows, words
from pyspark.sql import functions as F

from eigenframe.llm import near_copies, simhash
from eigenframe.llm.near_copies import Bands, first_of_each, links_within, shingle_hashes, similarity


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def plain_groups(texts, least=0.8):
    """Components of all pairs, whatever the candidates; texts without a word together."""
    sets, parent = plain_sets(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both >= least * (len(sets[i]) + len(sets[j]) - both)):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(text, rng, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


def corpus():
    rng = random.Random(4)
    base = [words(rng.randrange(60, 400), 100 + i) for i in range(60)]
    near = [edited(t, rng, len(t.split()) * k // 300) for t in base[:25] for k in (1, 4, 9)]
    chain = [words(200, 999)]
    for _ in range(6):
        chain.append(edited(chain[-1], rng, 3))
    boiler = [words(90, 5) + " " + words(60, 700 + i) for i in range(20)]  # about 0.4 alike
    return base + near + chain + boiler + [base[3], base[3].upper(), "one two", "One  two", "", None, " \n", "a b c d e", "a b c d e f"]


@pytest.mark.parametrize("cell_rows", [1024, 3])
def test_one_of_each_group(spark, cell_rows):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    kept = {r["doc_id"] for r in first_of_each(df, cell_rows=cell_rows).collect()}
    groups = plain_groups(texts)
    assert {groups[i] for i in kept} == set(groups) and kept >= set(groups)  # nothing clean is lost, each group has its first
    missed = len(kept) - len(set(groups))
    assert missed <= 0.02 * (len(texts) - len(set(groups)))


def test_bands_only_add_and_every_link_is_verified(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(4)
    found = near_copies.links(df.filter("text is not null")).collect()
    sets = plain_sets(texts)
    for a, b in found:
        both = len(sets[a] & sets[b])
        assert both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)


def test_chance_of_a_shared_band():
    rng, bands = np.random.default_rng(0), Bands(16, 6)
    for share, low, high in ((0.8, 0.97, 1), (0.3, 0, 0.06)):
        hits = 0
        for _ in range(200):
            n = 400
            common = int(round(2 * n * share / (1 + share)))
            pool = rng.integers(0, 1 << 64, 2 * n - common, dtype=np.uint64)
            a, b = pool[:n], pool[n - common :]
            assert abs(similarity(np.sort(a), np.sort(b)) - share) < 0.01
            hits += bool((bands.keys(a) == bands.keys(b)).any())
        assert low <= hits / 200 <= high


@pytest.mark.parametrize("memory", [64 << 20, 0])
def test_links_span_what_all_pairs_connect(monkeypatch, memory):
    monkeypatch.setattr(near_copies, "_BITS", memory)
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(14), rng.randrange(8, 14))), dtype=np.uint64) for _ in range(60)]
    parent = {i: i for i in range(60)}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links_within(list(range(60)), sets, 0.7):
        assert similarity(sets[a], sets[b]) >= 0.7 and root(a) != root(b)
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a in range(60) for b in range(a) if similarity(sets[a], sets[b]) >= 0.7)


def test_simhash_is_that_of_the_operator():
    for t in corpus():
        h = shingle_hashes((t or "").encode(), 4)
        assert (near_copies.simhash_of(h) if len(h) else 0) == simhash.fingerprint((t or "").encode(), 4)


def test_odd_documents(spark):
    names = ["text_key", "gone_id", "gone_node", "_text_key", "node", "group", "_id", "kind"]
    df = odd_documents(spark).withColumns({c: F.lit(i) for i, c in enumerate(names)})
    out = first_of_each(df)
    assert out.columns == df.columns
    got = out.collect()
    texts = [t for _, t, *_ in rows()]
    assert len(got) == len(set(plain_groups(texts)))
    assert all([r[c] for c in names] == list(range(len(names))) for r in got)
    assert sorted(str(r["doc_id"]) for r in got if r["text"] and len(r["text"]) > 300) == sorted(["1", "2", "None", "-8"])
    assert first_of_each(no_documents(spark)).count() == 0
