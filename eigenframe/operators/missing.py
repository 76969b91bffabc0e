"""Dropping and filling missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.operators.profile import categorical_profile
from eigenframe.plans.quantiles import quantiles
from eigenframe.plans.ranges import GROUP_ROWS, fill_along


def nan_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL is the only missing value inside the library."""
    real = [c for c in cols if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in real}) if real else df


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with every selected cell present; it is an error if there are none."""
    kept = nan_to_null(df, cols).dropna(subset=list(cols))
    if kept.isEmpty():
        raise ValueError("every row has a missing cell")
    return kept


def impute(df: DataFrame, cols: Sequence[str], strategy: str) -> DataFrame:
    """``error``, ``drop``, ``mean``, ``median``, ``zero`` or ``native`` (leave the gaps to the model)."""
    clean = nan_to_null(df, cols)
    if strategy == "native":
        return clean
    if strategy == "drop":
        return drop_incomplete(df, cols)
    if strategy == "error":
        missing = F.raise_error(F.lit("missing cell in a model variable"))
        return clean.withColumns({c: F.coalesce(F.col(c), missing.cast("double")) for c in cols})
    if strategy == "zero":
        return clean.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})
    if strategy == "mean":
        row = clean.agg(*[F.avg(c).alias(c) for c in cols]).first()
        value = {c: row[c] for c in cols}
    elif strategy == "median":
        value = {c: q[0] for c, q in quantiles(clean, cols, [0.5]).items()}
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    # A column without any value is filled with 0.
    return clean.withColumns({c: F.coalesce(F.col(c), F.lit(float(value[c] or 0.0))) for c in cols})


def guard_regression(strategy: str) -> None:
    """Means and medians of all rows would leak held-out rows into training."""
    if strategy in ("mean", "median"):
        raise ValueError(f"'{strategy}' imputation leaks between folds: drop rows or use 'zero' or 'native'")


def fill(
    df: DataFrame,
    strategy: str,
    cols: Sequence[str],
    value=None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``mean``, ``median``, ``mode``, ``forward``, ``backward`` or ``constant``.

    Mean and median fall back to the mode for columns that are not numeric; a
    column without any value stays as it is.
    """
    if strategy in ("forward", "backward"):
        if not order_by:
            raise ValueError(f"'{strategy}' needs order_by")
        return fill_along(nan_to_null(df, cols), cols, order_by, partition_by, strategy == "backward", group_rows)
    if strategy == "constant":
        return df.fillna({c: value for c in cols})
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    clean = nan_to_null(df, cols)
    values: dict[str, object] = {}
    if strategy == "mean" and numeric:
        row = clean.agg(*[F.avg(c).alias(c) for c in numeric]).first()
        values = {c: row[c] for c in numeric}
    elif strategy == "median" and numeric:
        values = {c: q[0] for c, q in quantiles(clean, numeric, [0.5]).items()}
    elif strategy not in ("mean", "median", "mode"):
        raise ValueError(f"unknown strategy {strategy!r}")
    rest = [c for c in cols if c not in values]
    if rest:
        for r in categorical_profile(clean, rest).select("column", "mode").collect():
            values[r["column"]] = r["mode"]
    return clean.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast("double" if c in numeric and strategy != "mode" else df.schema[c].dataType))
            for c, v in values.items()
            if v is not None
        }
    )


def drop_sparse_then_fill(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], share: float = 0.5, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Rows with at least ``share`` of the cells, then forward fill, then complete rows only."""
    enough = nan_to_null(df, cols).dropna(thresh=int(len(cols) * share), subset=list(cols))
    return fill(enough, "forward", cols, order_by=order_by, partition_by=partition_by).dropna(subset=list(cols))
