import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents, rows
from pyspark.sql import functions as F

from eigenframe.llm import audit
from eigenframe.llm.audit import Rules

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(docs, rules):
    """The definition on (lang, source, text), with Python's integers, every term of every pair."""
    count, df, out = defaultdict(Counter), Counter(), []
    for lang, source, text in docs:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(SMALL))
        count[lang, source].update(found)
        df.update((lang, t) for t in set(found))
    for lang in {k for k, _ in count}:
        kept = [t for (k, t), n in df.items() if k == lang and n >= rules.least_documents]
        whole = sum((count[k] for k in count if k[0] == lang), Counter())

        def probability(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def price(p, q):
            return (p - q) ** 2 // (p + q)

        q, sources = probability(whole), {s: probability(count[lang, s]) for k, s in count if k == lang}
        for s, p in sources.items():
            pairs = [(-sum(price(p[t], o[t]) for t in kept), i.encode(), i) for i, o in sources.items() if i != s]
            terms = [(-price(p[t], q[t]), t.encode(), t) for t in kept if count[lang, s][t] and p[t] > q[t]]
            out += [(lang, s, "pair", i, -v, r) for r, (v, _, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, r) for r, (v, _, t) in enumerate(sorted(terms)[: rules.top], 1)]
    return sorted(out)


def corpus(seed=0):
    rng = random.Random(seed)
    words = ["The", "the", "cat", "dog's", "é", "É", "数据", "x1y", "ßß", "a", " b", "\x7f", "zebra", "of", "in", "on", "un", "sur"]
    out = [(lang, source, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for lang in ("en", "fr", None) for source in ("a", "b", "é", "z", None) for _ in range(8)]
    return out + [("en", "empty", None), ("en", "blank", " 123 "), ("xx", "alone", "one two"), ("yy", "a", "w"), ("yy", "b", None), ("en", "a", "the " * 3000)]


@pytest.mark.parametrize("rules", [Rules(least_documents=3), Rules(), Rules(least_documents=1, top=2, block=4)])
def test_groups(spark, rules):
    docs = corpus() + [(la, s, t) for _, t, la, s, *_ in rows()]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("n", "id", "value", "term", "block", "_row")})
    assert sorted(tuple(r) for r in audit.audit(df, rules).collect()) == plain(docs, rules)


def test_odd_documents(spark):
    got = audit.audit(odd_documents(spark), Rules(least_documents=2)).collect()
    assert sorted(map(tuple, got)) == plain([(la, s, t) for _, t, la, s, *_ in rows()], Rules(least_documents=2))


def test_no_documents(spark):
    out = audit.audit(no_documents(spark))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


COUNTS = st.dictionaries(st.integers(0, 60), st.integers(1, 10**12), max_size=25)


@settings(max_examples=200, deadline=None)
@given(COUNTS, COUNTS, st.integers(61, 80))
def test_merge(a, b, terms):
    def arrays(c):
        return np.array(sorted(c), dtype=np.int64), np.array([c[k] for k in sorted(c)], dtype=np.int64)

    over = [sum(c.values()) + 2 * terms for c in (a, b)]
    p, q = ({k: 1 + 10**9 * (c.get(k, 0) + 2) // o for k in range(terms)} for c, o in zip((a, b), over))
    want = sum((p[k] - q[k]) ** 2 // (p[k] + q[k]) for k in set(a) | set(b))
    for x, y, ox, oy in ((a, b, *over), (b, a, *over[::-1])):
        assert audit.merged(arrays(x), arrays(y), ox, oy) == (want, len(set(a) | set(b)))
    ids, counts = audit.unpack(audit.pack(*arrays(a)), len(a))
    assert (ids == arrays(a)[0]).all() and (counts == arrays(a)[1]).all()


def test_billionths_are_exact(spark):
    cases = [(0, 0, 1), (5, 10, 3), (10**12 + 7, 10**13 + 1, 10**6), (9 * 10**14, 4 * 10**15, 10**9), (2**33, 2**34, 12345)]
    df = spark.createDataFrame(cases, "n long, total long, terms long")
    want = [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in cases]
    assert [r[0] for r in df.select(audit.billionths(F.col("n"), F.col("total"), F.col("terms"))).collect()] == want
    assert [int(audit.probabilities(np.array([n]), t + 2 * v)[0]) for n, t, v in cases] == want
