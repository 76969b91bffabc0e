"""Reports built on the profile: one small table in, one small table out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.functions.parsing import finite
from eigenframe.functions.stats import array_sum, let
from eigenframe.operators.aggregate import column_stats
from eigenframe.operators.profile import (
    PROFILE_SCHEMA,
    categorical_profile,
    correlations,
    distribution,
    duplicate_count,
    missing_report,
    numeric_profile,
    outlier_counts,
    sparse_rows,
)
from eigenframe.operators.rows import check_key
from eigenframe.plans.durable import discard, stored
from eigenframe.plans.gram import feature_array
from eigenframe.plans.quantiles import quantiles
from eigenframe.roles import Roles

_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
NEAR_CONSTANT = 0.001  # spread relative to the level of the column
HIGH_R = 0.95
ISSUE = "severity string, category string, column string, other string, value double"
ADVICE = "priority string, category string, column string, value double"


@dataclass(frozen=True)
class Profile:
    """Per-column rows and the few table-level numbers the reports need.

    Everything here is bounded by the number of columns (pairs for ``pairs``).
    """

    columns: DataFrame
    pairs: DataFrame
    rows: int
    duplicates: int
    sparse: int

    @property
    def totals(self) -> dict:
        t = self.columns.agg(
            F.sum("missing").alias("missing"),
            F.sum("rows").alias("cells"),
            F.count_if(F.col("type") == "numeric").alias("numeric"),
            F.count("*").alias("columns"),
        ).first()
        pct = 100.0 * t["missing"] / t["cells"] if t["cells"] else 0.0
        return {"missing_pct": pct, "numeric": t["numeric"], "columns": t["columns"]}


def profile(df: DataFrame, roles: Roles) -> Profile:
    """Profile features, targets and categories; a handful of scans, whatever the number of columns."""
    spark = df.sparkSession
    numeric, text = list(roles.features), list(roles.categorical)
    both = numeric + text
    # A dozen scans: what the columns are made from is worked out once.
    kept = None
    if both and all(isinstance(df.schema[c].dataType, _PLAIN) for c in both):
        df = kept = stored(df.select(*dict.fromkeys(both)), "profile")
    frames = []
    if numeric:
        lazy = numeric_profile(df, numeric)
        prof = spark.createDataFrame(lazy.collect(), lazy.schema)  # one row per column, used three times
        shapes = distribution(df, numeric, prof)
        found = outlier_counts(df, numeric, prof).filter("reportable").drop("reportable")
        frames.append(
            prof.join(shapes, "column").join(found, "column", "left")
            .withColumn("type", F.lit("numeric")).withColumn("mode", F.lit(None).cast("string"))
        )
    if text:
        frames.append(categorical_profile(df, text).withColumn("type", F.lit("categorical")))
    names = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
    rows = []
    for frame in frames:
        full = frame.withColumn("missing_pct", 100.0 * F.col("missing") / F.greatest("rows", F.lit(1)))
        have = set(full.columns)
        rows += full.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in names]).collect()
    columns = spark.createDataFrame([tuple(r) for r in rows], PROFILE_SCHEMA).fillna({"outliers": 0})
    pairs = correlations(df, numeric).filter(F.abs("r") > HIGH_R) if len(numeric) > 1 else None
    held = pairs.collect() if pairs is not None else []
    out = Profile(
        columns,
        spark.createDataFrame([tuple(r) for r in held], "x string, y string, r double"),
        df.count(),
        int(duplicate_count(df, both).first()[0]),
        sparse_rows(df, both, []).count(),
    )
    if kept is not None:
        discard(kept)
    return out


def _constant() -> Column:
    """Every present value the same; an empty column is empty, not constant."""
    present = F.col("rows") > F.col("missing")
    return present & F.when(F.col("type") == "numeric", F.col("min") == F.col("max")).otherwise(F.col("unique") == 1)


def _near_constant() -> Column:
    level = F.abs("mean")
    ok = (F.col("type") == "numeric") & (level > 0) & ~_constant()
    return F.coalesce(ok & (F.col("sd") < NEAR_CONSTANT * level), F.lit(False))


def issues(p: Profile) -> DataFrame:
    """Findings as rows ``(severity, category, column, other, value)``."""
    spark, t = p.columns.sparkSession, p.totals
    none = F.lit(None).cast("string")
    table = []
    if p.sparse:
        table.append(("warning", "structure", None, None, float(p.sparse)))
    if t["missing_pct"] > 10:
        table.append(("error" if t["missing_pct"] > 20 else "warning", "missing", None, None, t["missing_pct"]))
    if p.duplicates:
        table.append(("info", "duplicate", None, None, float(p.duplicates)))

    def per_column(cond: Column, severity: str, category: str, value: Column) -> DataFrame:
        return p.columns.filter(F.coalesce(cond, F.lit(False))).select(
            F.lit(severity).alias("severity"), F.lit(category).alias("category"), "column", none.alias("other"),
            value.cast("double").alias("value"),
        )

    out = spark.createDataFrame(table, ISSUE)
    found = [
        per_column(F.col("missing_pct") > 50, "error", "missing", F.col("missing_pct")),
        per_column(F.col("outliers") > 0, "info", "outlier", F.col("outliers")),
        per_column(_constant(), "warning", "variance", F.lit(0.0)),
        per_column(_near_constant(), "info", "variance", F.col("sd") / F.abs("mean")),
        per_column(
            (F.col("type") == "numeric") & F.col("dist_type").isNotNull() & (F.col("dist_type") != "normal"),
            "info", "distribution", F.col("skewness"),
        ),
        p.pairs.select(
            F.lit("warning").alias("severity"), F.lit("correlation").alias("category"), F.col("x").alias("column"),
            F.col("y").alias("other"), F.col("r").alias("value"),
        ),
    ]
    for f in found:
        out = out.unionByName(f)
    return out


def recommendations(p: Profile) -> DataFrame:
    """What to do about it, as rows ``(priority, category, column, value)``."""
    spark, t = p.columns.sparkSession, p.totals
    table = []
    if t["missing_pct"] > 10:
        table.append(("high", "missing", None, t["missing_pct"]))
    if p.duplicates:
        table.append(("medium", "duplicate", None, float(p.duplicates)))
    if t["numeric"] < 3:
        table.append(("high", "columns", None, float(t["numeric"])))
    out = spark.createDataFrame(table, ADVICE)
    numeric = p.columns.filter(F.col("type") == "numeric")
    total = numeric.agg(F.sum(F.col("sd") * F.col("sd")).alias("v"), F.count("sd").alias("n")).first()

    def per_column(cond: Column, priority: str, category: str, value: Column) -> DataFrame:
        return numeric.filter(F.coalesce(cond, F.lit(False))).select(
            F.lit(priority).alias("priority"), F.lit(category).alias("category"), "column", value.cast("double").alias("value")
        )

    width = F.col("max") - F.col("min")
    found = [
        per_column(F.col("outliers") > 0, "medium", "outlier", F.col("outliers")),
        per_column((width > 1000) | (width < 0.01), "high", "scaling", width),
        per_column((F.abs("skewness") > 1) & (F.col("unique") > 2), "medium", "distribution", F.col("skewness")),
    ]
    if total["v"] and total["n"] >= 2:
        share = F.col("sd") * F.col("sd") / F.lit(total["v"])
        found.append(per_column(share > 0.5, "high", "dominant", 100 * share))
    for f in found:
        out = out.unionByName(f)
    return out


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))


def dataset_score(p: Profile) -> DataFrame:
    """0 to 100 for the whole table."""
    t = p.totals
    dup = 100.0 * p.duplicates / p.rows if p.rows else 0.0
    cells = max(p.rows * t["numeric"], 1)
    score = (
        F.lit(100.0)
        - 0.5 * F.lit(t["missing_pct"])
        - 0.5 * 100.0 * F.count_if(_constant()) / F.greatest(F.count("*"), F.lit(1))
        - 0.3 * F.lit(dup)
        - 5.0 * F.count_if(F.col("missing_pct") > 50)
        - 0.2 * 100.0 * F.coalesce(F.sum("outliers"), F.lit(0)) / cells
        - (20.0 if t["numeric"] < 3 else 0.0)
    )
    return p.columns.agg(_clamp(score).alias("score"))


def column_scores(p: Profile) -> DataFrame:
    share = 100.0 * F.col("outliers") / F.greatest("rows", F.lit(1))
    flat = F.when(_constant(), 15.0).when(_near_constant(), 10.0).otherwise(0.0)
    return p.columns.select("column", _clamp(100.0 - 0.5 * F.col("missing_pct") - 0.3 * share - flat).alias("score"))


def readiness(df: DataFrame, roles: Roles) -> DataFrame:
    """Checks before a fit as ``(level, check, column, value)``; any ERROR means not ready."""
    spark = df.sparkSession
    feats = [*roles.features, *roles.targets, *roles.categorical]
    miss = missing_report(df, feats)
    stats = column_stats(df, list(roles.features)) if roles.features else None
    n, k = df.count(), len(roles.features)
    total = miss.agg(F.sum("missing").alias("m"), F.sum("rows").alias("c")).first()
    rows = []
    if n < 2:
        rows.append(("ERROR", "rows", None, float(n)))
    if k < 2:
        rows.append(("ERROR", "numeric_columns", None, float(k)))
    else:
        rows.append(("WARNING" if k < 3 else "INFO", "numeric_columns", None, float(k)))
    for name, cols in (("categorical_columns", roles.categorical), ("target_columns", roles.targets)):
        if cols:
            rows.append(("INFO", name, None, float(len(cols))))
    if total["m"]:
        rows.append(("INFO", "missing", None, 100.0 * total["m"] / total["c"]))
    if n > 10_000:
        rows.append(("INFO", "large", None, float(n)))
    if roles.id_col:
        key = check_key(df, roles.id_col).first()
        rows.append(("INFO", "row_names", roles.id_col, None))
        for what in ("repeated", "blank"):
            if key[what]:
                rows.append(("WARNING", f"row_names_{what}", roles.id_col, float(key[what])))
    out = spark.createDataFrame(rows, "level string, check string, column string, value double")
    out = out.unionByName(
        miss.filter("percent > 50").select(F.lit("WARNING").alias("level"), F.lit("missing").alias("check"), "column", F.col("percent").alias("value"))
    )
    if stats is not None:
        out = out.unionByName(
            stats.filter(F.col("min") == F.col("max")).select(
                F.lit("WARNING").alias("level"), F.lit("constant").alias("check"), "column", F.lit(None).cast("double").alias("value")
            )
        )
    return out


def validate_file(df: DataFrame, roles: Roles, strict: bool = False) -> DataFrame:
    """Errors and warnings per column, with the verdict repeated on every row."""
    cols = list(roles.features)
    miss = missing_report(df, cols)
    stats = column_stats(df, cols)
    level = (
        F.when(F.col("n") == 0, "error")
        .when((F.col("n") > 1) & (F.col("var_pop") < 1e-10), "warning")
        .when(F.col("percent") > 50, "warning")
    )
    what = F.when(F.col("n") == 0, "all_missing").when((F.col("n") > 1) & (F.col("var_pop") < 1e-10), "no_variance").otherwise("mostly_missing")
    found = miss.join(stats, "column").select("column", level.alias("level"), what.alias("finding"), "percent").filter("level is not null")
    bad = found.agg(F.count_if(F.col("level") == "error").alias("e"), F.count("*").alias("w")).first()
    ok = bad["e"] == 0 and not (strict and bad["w"])
    return found.withColumn("valid", F.lit(ok))


def scale_advice(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The widest and narrowest column, their ratio, and whether closure or sparsity explains it."""
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    zeros = clean.agg(*[(F.count_if(F.col(c) == 0) / F.greatest(F.count(c), F.lit(1))).alias(c) for c in cols])
    share = zeros.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("zeros")) for c in cols])))
    stats = column_stats(clean, cols).filter("n >= 2 and sd > 0").join(share, "column")
    stats = stats.withColumn("max_z", (F.col("max") - F.col("mean")) / F.col("sd"))
    edge = stats.agg(
        F.min_by(F.struct("column", "sd", "zeros", "max_z"), F.struct("sd", "column")).alias("lo"),
        F.max_by(F.struct("column", "sd"), F.struct("sd", "column")).alias("hi"),
        F.count("*").alias("k"),
    )
    closed = closed_composition(df, cols).first()
    ratio = F.when(F.col("k") < 2, 1.0).otherwise(F.col("hi.sd") / F.col("lo.sd"))
    return edge.select(
        F.col("hi.column").alias("widest"),
        F.col("lo.column").alias("narrowest"),
        ratio.alias("ratio"),
        F.when(ratio > 100, "very different").when(ratio > 10, "different").otherwise("similar").alias("scales"),
        F.lit(bool(closed["closed"])).alias("closed"),
        (F.col("lo.zeros") >= 0.9).alias("mostly_zero"),
        F.when(F.col("lo.zeros") >= 0.9, F.col("lo.max_z")).alias("max_z"),
    )


def closed_composition(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whether rows add up to a constant: no negatives, no 0/1 column, spread under 1 % of the median sum."""
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    some = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    negative = F.coalesce(F.least(*[F.col(c) for c in cols], F.lit(0.0)) < 0, F.lit(False))
    head = clean.agg(
        F.coalesce(F.bool_or(negative), F.lit(False)).alias("negative"),
        *[F.coalesce(F.bool_and(F.col(c).isin(0.0, 1.0)) & F.bool_or(F.col(c) == 1), F.lit(False)).alias(f"b{i}") for i, c in enumerate(cols)],
        F.count_if(some).alias("n"),
        F.min(F.when(some, total)).alias("lo"),
        F.max(F.when(some, total)).alias("hi"),
    ).first()
    binary = any(head[f"b{i}"] for i in range(len(cols)))
    mid = None
    if head["n"] >= 2 and not head["negative"] and not binary:
        sums = clean.filter(some).select(total.alias("s"))
        # the upper of the two middle sums
        n = head["n"]
        mid = quantiles(sums, ["s"], [(n // 2 + 0.5) / n], how="lower")["s"][0]
    closed = bool(mid and mid > 0 and (head["hi"] - head["lo"]) / mid < 0.01)
    return df.sparkSession.createDataFrame([(closed, mid if closed else None)], "closed boolean, total double")


def continuity(df: DataFrame, features) -> DataFrame:
    """Per row, mean squared successive difference over sample variance; gaps and flat rows give NULL."""

    def ratio(x: Column) -> Column:
        n = F.size(x)
        bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        steps = F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda a, b: (a - b) * (a - b))
        spread = let(
            array_sum(x) / n, lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - 1)
        )
        return F.when((n >= 2) & ~bad, let(spread, lambda s: F.when(s > 0, array_sum(steps) / (n - 1) / s)))

    return df.withColumn("ratio", let(feature_array(df, features), ratio))


def axis_report(df: DataFrame, features) -> DataFrame:
    """Is the order of the variables an axis? Median ratio over rows; 2 is what chance gives."""
    per_row = continuity(df.select(feature_array(df, features).alias("x")), "x").select("ratio", F.size("x").alias("m"))
    m = per_row.agg(F.max("m").alias("m")).first()["m"] or 0
    mid = quantiles(per_row, ["ratio"], [0.5])["ratio"][0]
    return df.sparkSession.createDataFrame(
        [(int(m), mid, bool(mid is not None and m >= 3 and mid <= 0.5), 2.0 / mid if mid else None)],
        "variables int, ratio double, continuous boolean, factor double",
    )


def header_spacing(names: Sequence[str]) -> dict:
    """Whether headers are numbers on an evenly spaced axis (metadata only)."""
    values = []
    for name in names:
        try:
            values.append(float(name))
        except ValueError:
            continue
    numeric = len(names) > 0 and len(values) >= max(2, 0.9 * len(names))
    if not numeric:
        return {"numeric": False, "uniform": False, "distinct_steps": 0}
    steps = sorted(b - a for a, b in zip(values, values[1:]))
    distinct = 1 + sum(abs(b - a) >= 1e-6 * max(abs(a), abs(b)) for a, b in zip(steps, steps[1:]) if a or b)
    one_way = steps[0] > 0 or steps[-1] < 0
    return {"numeric": True, "uniform": one_way and distinct == 1, "distinct_steps": distinct}


def response_advisory(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Responses that look like labels: at most 10 distinct values, ten or more rows for each."""
    parts = df.agg(
        *[F.struct(F.lit(c).alias("response"), F.count(c).alias("observed"), F.count("*").alias("total"), F.count_distinct(c).alias("unique")).alias(f"s{i}") for i, c in enumerate(targets)]
    )
    out = parts.select(F.inline(F.array(*parts.columns)))
    return out.withColumn("categorical", (F.col("unique") <= 10) & (F.col("unique") * 10 <= F.col("observed")))


def responses(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Target columns with observed and total rows."""
    return response_advisory(df, targets).select("response", "observed", "total")
