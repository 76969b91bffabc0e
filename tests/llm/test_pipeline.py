from collections import Counter

import corpus_pipeline
import pytest
from odd import no_documents, odd_documents
from pyspark.sql import functions as F

import __spark_entry__ as entry
from eigenframe.llm import queries
from eigenframe.plans.durable import stored

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_survive(spark, make):
    docs = stored(make(spark), "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stored(stages["quality_classifier"](spark, docs, SF), "a")
    kept = good.join(labels, "doc_id").groupBy("quality").count()
    shares = {r["quality"]: r["count"] for r in kept.collect()}
    total = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert shares[1] >= 0.99 * total[1] and shares.get(0, 0) <= 0.1 * total[0]
    unique = stored(stages["simhash_near_dedup"](spark, good, SF), "b")
    assert unique.count() < good.count()
    assert unique.groupBy(F.lower(F.trim("text"))).count().filter("count > 1").count() == 0
    cut = stored(stages["substring_dedup"](spark, unique, SF), "c")
    assert cut.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    mixed = stored(stages["mixing"](spark, cut, SF), "d")
    assert max(Counter(r["doc_id"] for r in mixed.select("doc_id").collect()).values()) == 2
    packed = stages["best_fit_packing"](spark, mixed, SF)
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.avg("n")).first()
    assert fill[0] == 2048 and fill[1] > 2000
