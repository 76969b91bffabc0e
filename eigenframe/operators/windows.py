"""Lags, rolling statistics and ranks; hot series are cut into overlapping chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.plans.ranges import GROUP_ROWS, running_total, sliding

TRADING_DAYS = 252


def lag_columns(cols: Sequence[str], lags: int) -> list[str]:
    """Lag-major names: all variables at lag 0, then at lag 1 …"""
    return [f"{c}_lag{lag}" for lag in range(lags) for c in cols]


def lag_embed(
    df: DataFrame,
    cols: Sequence[str],
    lags: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    label: str | None = None,
    label_mode: str = "first",
    keep: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Row i holds x[i] … x[i+L-1]; the last L-1 rows of a series have no window and go.

    ``label`` adds ``label_mode`` (first, last, majority with ties to the one
    seen first) of the window as ``window_label``.
    """
    if lags < 1:
        raise ValueError("at least one lag")
    carried = dict.fromkeys([*partition_by, *order_by, *keep, *cols, *([label] if label else [])])
    s = sliding(df.select(*carried), order_by, partition_by, after=lags - 1, group_rows=group_rows)
    w = s.window
    out = {f"{c}_lag{lag}": (F.lead(c, lag).over(w) if lag else F.col(c)) for lag in range(lags) for c in cols}
    out["_full"] = F.lead(F.lit(1), lags - 1).over(w) if lags > 1 else F.lit(1)
    if label:
        out["window_label"] = _window_label(label, label_mode, lags, w)
    wide = s.finish(s.frame.withColumns(out)).filter("_full is not null")
    extra = ["window_label"] if label else []
    return wide.select(*dict.fromkeys([*partition_by, *order_by, *keep]), *extra, *lag_columns(cols, lags))


def _window_label(label: str, mode: str, lags: int, w) -> Column:
    if mode == "first":
        return F.col(label)
    if mode == "last":
        return F.lead(label, lags - 1).over(w) if lags > 1 else F.col(label)
    if mode != "majority":
        raise ValueError(f"unknown label mode {mode!r}")
    seen = F.collect_list(label).over(w.rowsBetween(0, lags - 1))
    kinds = F.transform(
        F.array_distinct(seen),
        lambda v: F.struct(
            F.size(F.filter(seen, lambda u: u == v)).alias("n"), (-F.array_position(seen, v)).alias("first"), v.alias("v")
        ),
    )
    return F.array_max(kinds)["v"]


def autocorrelation(
    df: DataFrame,
    col: str,
    max_lag: int,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``(series…, lag, r)``: mean product at each lag over the population variance; 1 at lag 0.

    A lag as long as the series or longer has no row.
    """
    by = list(partition_by)
    s = sliding(df.select(*by, *order_by, col), order_by, by, after=max_lag, group_rows=group_rows)
    later = F.array(*[F.struct(F.lit(k).alias("lag"), (F.lead(col, k).over(s.window) if k else F.col(col)).alias("y")) for k in range(max_lag + 1)])
    rows = s.finish(s.frame.withColumn("_later", later)).select(*by, F.col(col).alias("x"), F.inline("_later"))
    # Σ(x-m)(y-m) = Σxy - m(Σx + Σy) + n·m², summed about a rough centre so nothing cancels.
    whole = df.agg(F.avg(col).alias("m"), F.var_pop(col).alias("v")).first()
    base = whole["m"] or 0.0
    x, y = F.col("x") - F.lit(base), F.col("y") - F.lit(base)
    per = rows.filter("y is not null").groupBy(*by, "lag").agg(
        F.count("*").alias("n"), F.sum(x * y).alias("xy"), F.sum(x + y).alias("xs")
    )
    if by:
        mean = df.groupBy(*by).agg((F.avg(col) - F.lit(base)).alias("_m"), F.var_pop(col).alias("_v"))
        joined = per.join(mean, [per[c].eqNullSafe(mean[c]) for c in by], "inner")
        m, v = F.col("_m"), F.col("_v")
    else:
        joined, m, v = per, F.lit(0.0), F.lit(whole["v"] or 0.0)
    cov = (F.col("xy") - m * F.col("xs") + F.col("n") * m * m) / F.col("n")
    r = F.when(F.col("lag") == 0, 1.0).otherwise(F.coalesce(F.try_divide(cov, v), F.lit(0.0)))
    return joined.select(*[per[c] for c in by], "lag", r.alias("r"))


def returns(
    df: DataFrame,
    col: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    kinds: Sequence[str] = ("simple", "log", "difference"),
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Change against the row before: relative, logarithmic, absolute; NULL on the first row."""
    s = sliding(df, order_by, partition_by, before=1, group_rows=group_rows)
    prev = F.lag(col).over(s.window)
    now = F.col(col)
    table = {
        "simple": F.try_divide(now - prev, prev),
        "log": F.when((now > 0) & (prev > 0), F.ln(now) - F.ln(prev)),
        "difference": now - prev,
    }
    return s.finish(s.frame.withColumns({f"{col}_{k}": table[k] for k in kinds}))


def rolling(
    df: DataFrame,
    col: str,
    size: int,
    stat: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``mean``, ``sd``, ``volatility`` (sd × √252) or ``ratio`` (value over its mean); full windows only."""
    s = sliding(df, order_by, partition_by, before=size - 1, group_rows=group_rows)
    w = s.window.rowsBetween(-(size - 1), 0)
    value = {
        "mean": F.avg(col).over(w),
        "sd": F.stddev_samp(col).over(w),
        "volatility": F.stddev_samp(col).over(w) * F.sqrt(F.lit(float(TRADING_DAYS))),
        "ratio": F.try_divide(F.col(col), F.avg(col).over(w)),
    }[stat]
    full = F.count(col).over(w) >= size
    return s.finish(s.frame.withColumn(name or f"{col}_{stat}{size}", F.when(full, value)))


def average_rank(
    df: DataFrame, col: str, name: str = "rank", partition_by: Sequence[str] = (), group_rows: int = GROUP_ROWS
) -> DataFrame:
    """1-based ranks, ties sharing their mean; NULL cells get none.

    Values are counted before they are ranked, so a value that fills a third of
    the table is one row while ranks are made.
    """
    by = list(partition_by)
    ranked = rank_table(df, col, name, by, group_rows).withColumnsRenamed({c: f"_k_{c}" for c in (*by, col)})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by] + [F.col(col) == F.col(f"_k_{col}")]
    return df.join(ranked, same, "left").drop(*[f"_k_{c}" for c in (*by, col)])


def rank_table(
    df: DataFrame,
    col: str,
    name: str,
    partition_by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    at_most: int | None = None,
) -> DataFrame:
    """``(series…, value, rank)`` with one row per distinct value."""
    by = list(partition_by)
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    ranked = running_total(counted, F.col("_n"), [col], by, "_before", group_rows, at_most)
    return ranked.select(*by, col, (F.col("_before") + (F.col("_n") + 1) / 2).cast("double").alias(name))


def diagonal_average(
    windows: DataFrame, cols: Sequence[str], lags: int, position: str, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Series rebuilt from lagged windows: the mean over all windows that hold a time step.

    ``position`` is the 0-based place of the window's first row.
    """
    entries = F.array(
        *[
            F.struct((F.col(position) + lag).alias("t"), *[F.col(f"{c}_lag{lag}").alias(c) for c in cols])
            for lag in range(lags)
        ]
    )
    long = windows.select(*partition_by, F.inline(entries))
    return long.groupBy(*partition_by, "t").agg(*[F.avg(c).alias(c) for c in cols])
