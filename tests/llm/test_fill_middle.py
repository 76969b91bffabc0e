import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import no_documents, odd_documents, rows

from eigenframe.llm import fill_middle
from eigenframe.llm.fill_middle import Exceptions, Rules

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.lists(st.sampled_from(["a", "Be", "é", "ß", " ", "  ", "\n", "\t", "　", "漢字", "😀", "\x85", "<P", "<", "S>", "<M>", "\x0b"]), max_size=14).map("".join)


def plain(text, doc_id, rules=Rules()):
    """Straight from the definition, on code points."""
    text = text or ""
    units = UNITS.findall(text) if rules.unit == "word" else list(text)
    n = len(units)
    digits = hashlib.sha256(f"{rules.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in rules.markers) or h3 % 100 >= rules.rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = rules.markers
    if h4 % 100 < rules.spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(-5, 200), st.sampled_from([Rules(), Rules(seed=7, rate=100, spm=50), Rules(unit="character", rate=100, markers=("⟨a⟩", "⟨b⟩", "⟨c⟩"))]))
def test_one_text(text, doc_id, rules):
    got = fill_middle.transformed(text.encode(), doc_id, rules)
    assert (*got[:4], got[4].decode()) == plain(text, doc_id, rules)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_cuts_turn_into_each_other(text):
    index = Exceptions(np.frombuffer(text.encode(), dtype=np.uint8))
    chars = np.arange(len(text) + 1)
    in_bytes = np.array([len(text[:k].encode()) for k in chars])
    assert index.chars == len(text)
    assert (index.to_bytes(chars) == in_bytes).all() and (index.to_chars(in_bytes) == chars).all()


@pytest.mark.parametrize("rules", [Rules(), Rules(rate=100), Rules(rate=100, spm=0), Rules(rate=100, unit="character")])
def test_documents(spark, rules):
    out = fill_middle.fill_in_middle(odd_documents(spark), rules)
    got = out.withColumn("back", fill_middle.restored("output", "form", rules)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted([(r["doc_id"], *r[1:6], r["back"]) for r in got], key=key) == sorted(((d, *plain(t, d, rules), t or "") for d, t, *_ in rows()), key=key)
    if rules.rate == 100:
        assert {r["form"] for r in got} >= {"plain", "psm" if rules.spm == 0 else "spm"}


def test_no_documents(spark):
    out = fill_middle.fill_in_middle(no_documents(spark))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == 0


def test_a_text_larger_than_a_slice(spark):
    text = ("añb 漢\t" * 900_000)[:-1]
    docs = spark.createDataFrame([(k, text) for k in (1, 2, 3, 4)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, Rules(rate=100)).withColumn("back", fill_middle.restored("output", "form"))
    want = {k: plain(text, k, Rules(rate=100)) for k in (1, 2, 3, 4)}
    for r in out.collect():
        assert tuple(r[1:6]) == want[r["doc_id"]] and r["back"] == text


def test_rules_are_checked():
    with pytest.raises(ValueError):
        Rules(unit="line")
    with pytest.raises(ValueError):
        Rules(markers=("<P>", "<P>x", "<M>"))
