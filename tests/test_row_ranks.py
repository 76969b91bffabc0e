"""Ranks of several columns over the same rows, and sums of their products."""

import re

import numpy as np
import pandas as pd
import pytest

from eigenframe.operators import diagnostics
from eigenframe.plans import row_ranks


def _table(spark, gaps, rows=240, seed=5):
    rng = np.random.default_rng(seed)
    s = rng.normal(size=rows)
    pdf = pd.DataFrame(
        {
            "s": s, "t": np.round(s + rng.normal(size=rows), 1), "_v0": np.round(rng.normal(size=rows) * 40), "_v1": s**3 - rng.random(rows),
            "_v2": rng.integers(0, 2, rows) + 0.0, "_v3": np.full(rows, 4.0), "_v4": np.where(rng.random(rows) < 0.6, -0.0, rng.normal(size=rows)),
        }
    )
    for c in gaps:
        pdf.loc[rng.random(rows) < 0.3, c] = np.nan
    return pdf, spark.createDataFrame(pdf).replace(float("nan"), None).repartition(5)


@pytest.mark.parametrize("group_rows", [4_000_000, 640])
@pytest.mark.parametrize("gaps", [["_v0", "_v2", "_v4"], ["s", "t", "_v0", "_v1", "_v2", "_v3", "_v4"]])
def test_rank_correlations_of_pairs_with_gaps(spark, monkeypatch, gaps, group_rows):
    monkeypatch.setattr(row_ranks, "HELD_CELLS", 400)
    pdf, df = _table(spark, gaps)
    names = ["a", "b", "c", "d", "e"]
    got = {(v, c): (n, r) for v, c, n, r in diagnostics._correlate_ranks(df, ["s", "t"], names, group_rows)}
    assert len(got) == 10
    for i, v in enumerate(names):
        for c in ("s", "t"):
            both = pdf[[c, f"_v{i}"]].dropna()
            want = 0.0 if v == "d" else both.rank().corr().iloc[0, 1]
            assert got[v, c][0] == len(both) and abs(got[v, c][1] - want) < 1e-12


def test_rank_correlations_of_few_or_no_pairs(spark):
    schema = "s double, _v0 double, _v1 double"
    got = diagnostics._correlate_ranks(spark.createDataFrame([(1.0, 2.0, None), (3.0, 1.0, None), (2.0, 5.0, 1.0)], schema), ["s"], ["a", "b"])
    assert got == [("a", "s", 3, -0.5), ("b", "s", 1, 0.0)]
    assert diagnostics._correlate_ranks(spark.createDataFrame([], schema), ["s"], ["a", "b"]) == [("a", "s", 0, 0.0), ("b", "s", 0, 0.0)]


def test_rank_correlations_move_blocks_of_rows(spark, monkeypatch):
    """No window over rows, and an exchange for each score and one for all variables."""
    _, df = _table(spark, ["_v0", "_v1"])
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    df = df.withColumnsRenamed({"_v0": "a", "_v1": "b"})
    out = diagnostics.score_correlations(df, ["s", "t"], ["a", "b"], method="spearman")
    assert out.count() == 4
    assert all("Window" not in plan for plan in plans)
    assert sum(plan.count("REPARTITION_BY_NUM") - plan.count("RoundRobinPartitioning") for plan in plans) <= 3
    pdf, _ = _table(spark, ["_v0", "_v1"])
    sets = [["s", "t", "_v2"], ["s", "_v0"]]
    rows = diagnostics._ranks_of(df.withColumnRenamed("a", "_v0"), sets, 240, 640).collect()
    for k, some in enumerate(sets):
        mine = np.array(sorted(r["ranks"] for r in rows if r["set"] == k))
        want = pdf[some].dropna().rank().sort_values(some).to_numpy()
        assert np.array_equal(mine, want)


def test_rank_correlations_of_many_ranges_open_one_file_a_task(spark, monkeypatch):
    """A file for each of some dozens of ranges in each task took longer than the rows; and a row reaches Python as one array."""
    pdf, df = _table(spark, ["_v0"], rows=400)
    plans, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    got = {(v, c): (n, r) for v, c, n, r in diagnostics._correlate_ranks(df, ["s"], ["a", "b"], 50)}
    plan = plans[-1]
    dealt = [int(n) for n in re.findall(r"(\d+)\)?, REPARTITION_BY_NUM", plan)]
    assert max(dealt) > row_ranks.FEW_FILES and all(n <= row_ranks.FEW_FILES or n >= row_ranks.ONE_FILE for n in dealt)
    assert "Sort [at" not in plan and "Project [array(" in plan
    for i, v in enumerate(["a", "b"]):
        both = pdf[["s", f"_v{i}"]].dropna()
        assert got[v, "s"][0] == len(both) and abs(got[v, "s"][1] - both.rank().corr().iloc[0, 1]) < 1e-12
