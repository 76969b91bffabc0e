"""Columns of a table that are called like those the operators add for themselves."""

import pytest
from odd import odd_documents
from pyspark.sql import functions as F

import corpus_pipeline
from eigenframe.llm import mixing, simhash, spans

NAMES = (
    "_n _all _mk _row_k _time _times _place k n i mix_key mix_key_2 mix_total mix_rows mix_place mix_times mix_time _span_id _span_key _cover "
    "_cover_id _cover_key _cut span_doc span_key cover_doc cover_key cover_at span_cut _text_key text_key best_id best_key _best_id _gone_words "
    "gone_words gone_sentences at owner a b node"
).split()
KEEPING = {
    "mixed": mixing.mixed,
    "first_of_each": simhash.first_of_each,
    "remove_repeats": lambda d: spans.remove_repeats(d, names=("cut_sentences", "cut_words")),
    "substring_stage": lambda d: corpus_pipeline.substring_dedup(d.sparkSession, d, ""),
}


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay(spark, name):
    docs = odd_documents(spark)
    more = docs.withColumns({c: F.lit(at) for at, c in enumerate(NAMES)})
    out = KEEPING[name](more)
    got, plain = out.collect(), KEEPING[name](docs).collect()
    assert out.columns[: len(more.columns)] == more.columns
    assert all([r[c] for c in NAMES] == list(range(len(NAMES))) for r in got)
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(str((r["doc_id"], r["text"])) for r in plain)
