"""The plans are the ones we mean: narrow scoring, pruned scans, pushed filters, no row moved for fold edges."""

import re

import pytest

from checks.models import given
from eigenframe.operators import regression, rows, scoring
from eigenframe.operators.pca import fit_pca
from eigenframe.plans.ranges import with_range

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def read_schemas(text):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_scoring_is_narrow_and_pruned(items):
    text = plan(scoring.with_outside(scoring.score(items, given(), ["l_orderkey"]), given()))
    assert "Exchange" not in text and "Python" not in text
    assert read_schemas(text) == [{"l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}]


def test_array_scoring_is_narrow(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    model = fit_pca(df, "embedding", 2)
    text = plan(scoring.score(df, model, ["vec_id"]))
    assert "Exchange" not in text and "MapInArrow" in text and "label" not in text


def test_numeric_filter_reaches_the_scan(spark):
    df = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(rows.filter_rows(df, "o_totalprice", ">=", 1000).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_totalprice,1000.0)" in text


def test_fold_edges_move_no_rows(items):
    key = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    text = plan(regression.assign_folds(items, regression.CV(5, order_by=key)))
    assert "Exchange" not in text and "Window" not in text
    assert "Exchange" not in plan(rows.exclude_rows(items, "3-9", key))


def test_ranges_are_a_constant_search(items):
    text = plan(with_range(items, ["l_orderkey", "l_linenumber", "l_partkey"], 100))
    assert "Exchange" not in text and "from_json" not in text
