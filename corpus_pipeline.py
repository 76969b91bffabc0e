"""From raw documents to packed training sequences: five stages, each a table.

Each stage takes what the one before kept and gives the columns of ``documents``; the
last gives the pieces of sequences. Extra columns travel along, and rows with NULLs,
empty or very long texts, repeated ids and repeated rows are handled as the operators'
docstrings say. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.llm import mixing, near_copies, packing, quality, spans
from eigenframe.llm.common import WORD, remainder, table
from eigenframe.plans.durable import stored
from eigenframe.roles import unique_name

ACCEPT = 0.3  # the least quality score that stays


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned on ``labels``, does not reject.

    Labels whose crc32(doc_id) is a multiple of five are left for testing.
    """
    measured = stored(quality.with_statistics(docs), "statistics")
    model = quality.fit(measured, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return docs.filter(quality.score_text(F.col("text"), spark, model) >= ACCEPT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: SimHash and band candidates, each link verified."""
    return near_copies.first_of_each(docs, words=5, least=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; a text of which no word is left goes."""
    names = (unique_name("gone_sentences", docs.columns), unique_name("gone_words", docs.columns))
    cut = spans.remove_repeats(docs, names=names)
    gone = F.col(names[1])
    left = cut.filter((gone == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        n_chars = F.when(gone > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: never, once or twice."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None  # models and tokenizers are beyond SQL; tests/llm compares with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
