"""A fitted model watching a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.operators.pca import PCAModel
from eigenframe.operators.scoring import score, with_outside


def score_stream(stream: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """The expressions of batch scoring; no state, so any output mode and trigger will do."""
    return with_outside(score(stream, model, keep), model)


def share_outside(scored: DataFrame, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and the share outside the model per tumbling window; rows later than ``late`` are dropped."""
    flagged = scored.withWatermark(ts, late) if scored.isStreaming else scored
    return (
        flagged.groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(F.col("outside").cast("double")).alias("share_outside"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "share_outside")
    )
