"""Column types, profiles, missing cells, outliers, duplicates and correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenframe.functions.parsing import NA_WORDS, finite, is_blank, is_missing, is_number, trimmed
from eigenframe.functions.stats import pearson
from eigenframe.plans.durable import discard, stored
from eigenframe.plans.quantiles import quantiles
from eigenframe.plans.ranges import dense_index
from eigenframe.roles import Roles, suffix_role

EXPRESSION_PAIRS = 6  # column pairs up to which correlations are plain aggregates
# Bins of a distribution, and the step of magnitude below.
BINS = 10
JUMP = 100.0  # magnitude step that marks a value as a likely slip
PROFILE_SCHEMA = (
    "column string, type string, rows long, missing long, missing_pct double, unique long, mean double, "
    "median double, sd double, min double, max double, q1 double, q3 double, iqr double, skewness double, "
    "kurtosis double, mode string, dist_type string, outliers long"
)


def _long(df: DataFrame, cols: Sequence[str], aggs: dict) -> DataFrame:
    """One aggregate job over all columns, one row per column."""
    wide = df.agg(*[F.struct(*[f(F.col(c)).alias(n) for n, f in aggs.items()]).alias(f"s{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"s{i}.{n}").alias(n) for n in aggs]) for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*items)))


# --- types ---------------------------------------------------------------------------


def infer_roles(df: DataFrame, id_col: str | None = None, targets: Sequence[str] = (), decimal: str = ".") -> Roles:
    """Roles of an all-text table: header suffixes first, then all values of each column.

    One value that is neither a number nor missing makes a column a category, so
    no text is lost, wherever it stands.
    """
    cols = [c for c in df.columns if c != id_col]
    odd = df.agg(
        *[F.count_if(~is_missing(F.col(f"`{c}`")) & ~is_number(F.col(f"`{c}`"), decimal)).alias(f"o{i}") for i, c in enumerate(cols)]
    ).first()
    feats, cats, targs = [], [], []
    for i, c in enumerate(cols):
        role = suffix_role(c)
        if role == "target" or c in targets:
            targs.append(c)
        elif role == "category" or odd[f"o{i}"]:
            cats.append(c)
        else:
            feats.append(c)
    return Roles(tuple(feats), tuple(cats), tuple(targs), id_col, None, tuple(df.columns))


def column_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``numeric``, ``categorical``, ``text`` or ``empty`` from all values of each column."""
    said = df.select(*[F.when(~is_blank(F.col(c)), trimmed(F.col(c))).alias(c) for c in cols])
    stats = _long(
        said,
        cols,
        {"total": F.count, "numeric": lambda c: F.count_if(is_number(c, na=())), "unique": F.count_distinct},
    )
    few = (F.col("unique") < 0.2 * F.col("total")) | (F.col("unique") < 20)
    kind = (
        F.when(F.col("total") == 0, "empty")
        .when(F.col("numeric") > 0.9 * F.col("total"), "numeric")
        .when(few, "categorical")
        .otherwise("text")
    )
    return stats.select("column", kind.alias("type"))


def classify_new(df: DataFrame, col: str) -> DataFrame:
    """A derived column is numeric if it holds at least one value and all of them parse."""
    said = F.when(~is_blank(F.col(col)), F.col(col))
    return df.agg(F.count(said).alias("n"), F.bool_and(is_number(said, na=())).alias("all_numbers")).select(
        F.lit(col).alias("column"),
        F.when((F.col("n") > 0) & F.coalesce("all_numbers", F.lit(False)), "numeric").otherwise("text").alias("type"),
    )


# --- missing -------------------------------------------------------------------------


def _gap(df: DataFrame, col: str) -> Column:
    c = F.col(f"`{col}`")
    if isinstance(df.schema[col].dataType, T.StringType):
        return is_missing(c, NA_WORDS, any_case=True)
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing cells and their share per column."""
    flags = df.select(*[_gap(df, c).alias(c) for c in cols])
    return _long(flags, cols, {"missing": F.count_if, "rows": lambda _c: F.count("*")}).withColumn(
        "percent", F.when(F.col("rows") > 0, 100.0 * F.col("missing") / F.col("rows")).otherwise(0.0)
    )


def missing_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Cells, missing cells, their share, and rows with at least one gap."""
    per_row = sum((F.when(_gap(df, c), 1).otherwise(0) for c in cols), F.lit(0))
    return (
        df.select(per_row.alias("m"))
        .agg(
            (F.count("*") * len(cols)).alias("cells"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("missing"),
            F.count_if(F.col("m") > 0).alias("rows_with_gaps"),
        )
        .withColumn("percent", F.when(F.col("cells") > 0, 100.0 * F.col("missing") / F.col("cells")).otherwise(0.0))
    )


def missing_by_row(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, sum((F.when(_gap(df, c), 1).otherwise(0) for c in cols), F.lit(0)).alias("missing"))


def missing_pattern(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], **kw) -> DataFrame:
    """Where the gaps of a column sit: none, top, bottom, systematic (equal steps) or random.

    Positions are numbered once for all columns. Steps are equal when the span
    divides by their number and every gap lies on the grid that gives, which needs
    no look at neighbouring rows.
    """
    # Numbering reads its rows several times, and the numbers are read twice: both are worked out once.
    gaps = stored(df.select(*order_by, *[_gap(df, c).alias(f"_g_{c}") for c in cols]), "gaps")
    placed = stored(dense_index(gaps, order_by, name="_pos", **kw).drop(*order_by), "placed")
    discard(gaps)
    where = placed.select("_pos", *[F.when(F.col(f"_g_{c}"), F.col("_pos")).alias(c) for c in cols])
    ends = _long(where, cols, {"n": F.count, "first": F.min, "last": F.max})
    rows = F.lit(where.count())
    found = {r["column"]: r for r in ends.collect()}
    grid = []
    for i, c in enumerate(cols):
        n, first, last = found[c]["n"], found[c]["first"], found[c]["last"]
        step = (last - first) // (n - 1) if n > 2 and (last - first) % (n - 1) == 0 else 0
        ok = F.bool_and((F.col(c) - first) % step == 0) if step > 1 else F.lit(False)
        grid.append(F.struct(F.lit(c).alias("column"), F.lit(n).alias("n"), F.lit(first).cast("long").alias("first"), F.lit(last).cast("long").alias("last"), ok.alias("even")).alias(f"s{i}"))
    table = where.agg(*grid)
    kind = (
        F.when(F.col("n") == 0, "none")
        .when(F.col("last") == F.col("n") - 1, "top")
        .when(F.col("first") == rows - F.col("n"), "bottom")
        .when((F.col("n") > 2) & F.col("even"), "systematic")
        .otherwise("random")
    )
    return table.select(F.inline(F.array(*table.columns))).select("column", kind.alias("pattern"))


# --- profiles ------------------------------------------------------------------------


def sample_skew(g1: Column, n: Column, sd: Column) -> Column:
    out = g1 * n * n / ((n - 1) * (n - 2))
    return F.when((n < 3) | (sd == 0), F.lit(0.0)).otherwise(out)


def sample_kurtosis(g2: Column, n: Column, sd: Column) -> Column:
    lead = n * n * (n + 1) * (g2 + 3) / ((n - 1) * (n - 2) * (n - 3))
    return F.when((n < 4) | (sd == 0), F.lit(0.0)).otherwise(lead - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))


def _moment_rows(clean: DataFrame, cols: list[str]) -> DataFrame:
    """n, extremes, mean, population deviation and the moment ratios g1 and g2 of every column.

    Power sums about a rough centre need a quarter of the aggregate buffers that
    separate moment functions do. If the centre turns out to be far off the mean
    the sums are made again about the mean.
    """
    head = clean.limit(2000).agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = {c: head[c] or 0.0 for c in cols}
    for attempt in range(2):
        aggs = []
        for i, c in enumerate(cols):
            d = F.col(c) - F.lit(float(shift[c]))
            power = [d, d * d, d * d * d, d * d * d * d]
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
            aggs += [F.sum(p).alias(f"s{i}_{k}") for k, p in enumerate(power)]
        row = clean.agg(F.count("*").alias("rows"), *aggs).first()
        out, far = [], False
        for i, c in enumerate(cols):
            n = row[f"n{i}"]
            if not n:
                out.append((c, row["rows"], 0, None, None, None, None, None, None))
                continue
            a, b, t, f = (row[f"s{i}_{k}"] / n for k in range(4))
            var = max(b - a * a, 0.0)
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo == hi:
                out.append((c, row["rows"], n, lo, 0.0, lo, hi, None, None))
                continue
            if attempt == 0 and a * a > 1e4 * var:
                shift[c], far = shift[c] + a, True
            m3 = t - 3 * a * b + 2 * a**3
            m4 = f - 4 * a * t + 6 * a * a * b - 3 * a**4
            g1, g2 = (m3 / var**1.5, m4 / var**2 - 3) if var > 0 else (None, None)
            out.append((c, row["rows"], n, shift[c] + a, var**0.5, lo, hi, g1, g2))
        if not far:
            break
    return clean.sparkSession.createDataFrame(
        out, "column string, rows long, n long, mean double, sd double, min double, max double, g1 double, g2 double"
    )


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts, moments, quartiles and shape of every numeric column, one row each."""
    cols = list(cols)
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    stats = _moment_rows(clean, cols)
    # Distinct values as one plain aggregate over (column, value), not one expansion per column.
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in cols])
    pairs = clean.select(F.inline(entries)).distinct().groupBy("column").agg(F.count("v").alias("u")).collect()
    unique = {r["column"]: r["u"] for r in pairs}
    q = quantiles(clean, cols, [0.25, 0.5, 0.75], distinct=unique)
    quart = df.sparkSession.createDataFrame(
        [(c, unique.get(c, 0), *q[c]) for c in cols], "column string, unique long, q1 double, median double, q3 double"
    )
    n, sd = F.col("n").cast("double"), F.col("sd")
    return (
        stats.join(F.broadcast(quart), "column")  # one row per column
        .withColumn("missing", F.col("rows") - F.col("n"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .withColumn("skewness", F.when(n > 0, F.coalesce(sample_skew(F.col("g1"), n, sd), F.lit(0.0))))
        .withColumn("kurtosis", F.when(n > 0, F.coalesce(sample_kurtosis(F.col("g2"), n, sd), F.lit(0.0))))
        .select(
            "column", "rows", "missing", "unique", "mean", "median", "sd", "min", "max", "q1", "q3", "iqr", "skewness",
            "kurtosis",
        )
    )


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the values present; counted before anything moves."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.when(~_gap(df, c), trimmed(F.col(c))).alias("value")) for c in cols
    ]
    return df.select(F.inline(F.array(*entries))).groupBy("column", "value").agg(F.count("*").alias("n"))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, missing, distinct values, most frequent value (smallest on ties) and its count."""
    there = F.col("value").isNotNull()
    return (
        value_counts(df, cols)
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("missing"),
            F.count("value").alias("unique"),
            F.min_by("value", F.when(there, F.struct(-F.col("n"), F.col("value")))).alias("mode"),
            F.max(F.when(there, F.col("n"))).alias("mode_count"),
        )
    )


def _ends(clean: DataFrame, cols: Sequence[str], prof: DataFrame | None) -> dict[str, dict]:
    """Count and extremes per column, from a profile if there is one."""
    if prof is not None:
        rows = prof.select("column", (F.col("rows") - F.col("missing")).alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi"))
    else:
        rows = _long(clean, cols, {"n": F.count, "lo": F.min, "hi": F.max})
    return {r["column"]: r.asDict() for r in rows.collect()}


def histogram(df: DataFrame, cols: Sequence[str], prof: DataFrame | None = None) -> DataFrame:
    """Ten equal bins per column, the largest value in the last; constant columns have none."""
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    ends = _ends(clean, cols, prof)
    entries = []
    for c in cols:
        lo, hi = ends[c]["lo"], ends[c]["hi"]
        if lo is None or hi <= lo:
            continue
        at = F.floor((F.col(c) - lo) / ((hi - lo) / BINS))
        at = F.when(at.isNotNull(), F.least(at, F.lit(BINS - 1))).cast("int")  # least() skips NULLs
        entries.append(F.struct(F.lit(c).alias("column"), at.alias("bin")))
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, bin int, n long")
    return (
        clean.select(F.inline(F.array(*entries))).filter("bin is not null").groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )


def distribution(df: DataFrame, cols: Sequence[str], prof: DataFrame | None = None) -> DataFrame:
    """Shape of each column: normal, left-skewed, right-skewed, bimodal, unknown, or NULL if too short."""
    prof = numeric_profile(df, cols) if prof is None else prof
    bins = histogram(df, cols, prof).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    at = lambda i: F.coalesce(F.try_element_at("h", F.lit(i)), F.lit(0))
    peaks = sum(
        (F.when((at(i) > at(i - 1)) & (at(i) > at(i + 1)), 1).otherwise(0) for i in range(1, BINS - 1)), F.lit(0)
    )
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    kind = (
        F.when(F.col("rows") - F.col("missing") < 10, F.lit(None))
        .when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1.0), "normal")
        .when(skew > 1, "right-skewed")
        .when(skew < -1, "left-skewed")
        .when(F.col("h").isNull(), F.lit(None))
        .when(peaks >= 2, "bimodal")
        .otherwise("unknown")
    )
    return prof.join(bins, "column", "left").select("column", kind.alias("dist_type"))


# --- outliers, sparse rows, duplicates ------------------------------------------------------


def _jumps(clean: DataFrame, cols: Sequence[str], prof: DataFrame | None) -> dict[str, list[float]]:
    """Per column, the extreme values that stand a hundredfold clear of their neighbour."""
    ends = _ends(clean, cols, prof)
    usable = [c for c in cols if ends[c]["n"] >= 4 and ends[c]["lo"] < ends[c]["hi"]]
    if not usable:
        return {}
    second = clean.agg(
        *[F.max(F.when(F.col(c) < ends[c]["hi"], F.col(c))).alias(f"h{i}") for i, c in enumerate(usable)],
        *[F.min(F.when(F.col(c) > ends[c]["lo"], F.col(c))).alias(f"l{i}") for i, c in enumerate(usable)],
    ).first()
    out = {}
    for i, c in enumerate(usable):
        pairs = [(ends[c]["hi"], second[f"h{i}"]), (ends[c]["lo"], second[f"l{i}"])]
        hits = [e for e, nxt in pairs if nxt != 0 and abs(e) >= JUMP * abs(nxt)]
        if hits:
            out[c] = hits
    return out


def outliers(df: DataFrame, cols: Sequence[str], keep: Sequence[str], prof: DataFrame | None = None) -> DataFrame:
    """Rows ``(keep…, column, value)`` whose value is a hundredfold step beyond the next one in."""
    clean = df.select(*keep, *[finite(F.col(c)).alias(f"_v_{c}") for c in cols])
    hits = _jumps(clean.select(*[F.col(f"_v_{c}").alias(c) for c in cols]), cols, prof)
    if not hits:
        return clean.select(*keep, F.lit("").alias("column"), F.lit(0.0).alias("value")).limit(0)
    entries = [
        F.when(F.col(f"_v_{c}").isin(*v), F.struct(F.lit(c).alias("column"), F.col(f"_v_{c}").alias("value")))
        for c, v in hits.items()
    ]
    any_hit = F.array_compact(F.array(*entries))
    return clean.select(*keep, F.inline(any_hit))


def outlier_counts(df: DataFrame, cols: Sequence[str], prof: DataFrame | None = None) -> DataFrame:
    """Outliers per column and whether they are few enough to report (<= 1 % of rows or <= 3 cells)."""
    found = outliers(df, cols, [], prof).groupBy("column").agg(F.count("*").alias("outliers"))
    n = df.count()
    return found.withColumn("reportable", (F.col("outliers") * 100.0 <= n) | (F.col("outliers") <= 3))


def sparse_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows with no value, or fewer than half of what the (upper) median row has."""
    filled = df.select(*keep, sum((F.when(_gap(df, c), 0).otherwise(1) for c in cols), F.lit(0)).alias("filled"))
    if len(cols) < 4:
        return filled.limit(0)
    counts = filled.groupBy("filled").count().orderBy("filled").collect()  # at most one row per column count
    total, seen, mid = sum(r["count"] for r in counts), 0, 0
    for r in counts:
        seen += r["count"]
        if seen > total // 2:
            mid = r["filled"]
            break
    return filled.filter((F.col("filled") == 0) | (2 * F.col("filled") < mid))


def _digest(cols: Sequence[str]) -> Column:
    """A fixed-size stand-in for the whole content of a row."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}), 256)


def duplicate_rows(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every later exact copy of a row; ``order_by`` must identify rows.

    The first of each kind is found by a pre-aggregated minimum over a digest,
    then removed by key, so a row copied a billion times is never one group.
    """
    tagged = df.select(*dict.fromkeys([*order_by, *keep]), _digest(cols).alias("_d"))
    firsts = tagged.groupBy("_d").agg(F.min(F.struct(*order_by)).alias("_first"))
    firsts = firsts.select(F.col("_d").alias("_fd"), *[F.col(f"_first.`{c}`").alias(f"_f{i}") for i, c in enumerate(order_by)])
    same = F.col("_d") == F.col("_fd")  # keys may hold NULLs
    for i, c in enumerate(order_by):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_f{i}"))
    return tagged.join(firsts, same, "left_anti").drop("_d")


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return (
        df.select(F.unhex(_digest(cols)).alias("_d")).groupBy("_d").count()
        .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    )


# --- correlations -----------------------------------------------------------------------


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(x, y, r)`` for x < y in column order; pairs with a gap are skipped, no variance gives 0."""
    cols = list(cols)
    clean = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if len(pairs) > EXPRESSION_PAIRS:
        place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
        both = pair_correlations(clean, cols, cols)
        return both.filter(place[F.col("x")] < place[F.col("y")]).select("x", "y", "r")
    aggs = []
    for p, (i, j) in enumerate(pairs):
        r = pearson(F.col(cols[i]), F.col(cols[j]))
        aggs.append(F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), r.alias("r")).alias(f"s{p}"))
    wide = clean.agg(*aggs)
    return wide.select(F.inline(F.array(*wide.columns)))


def pair_correlations(
    clean: DataFrame, xs: Sequence[str], ys: Sequence[str], least: int = 2, centre: float | None = None
) -> DataFrame:
    """``(x, y, n, r)`` of every x with every y: pairwise sums as products of values and masks.

    Six small matrices per task, added up by cell; gaps only cost the pairs they
    are in. Sums are taken about ``centre``, or else about the mean of each column.
    """
    p, q = len(xs), len(ys)
    names = list(dict.fromkeys([*xs, *ys]))
    if centre is None:
        means = clean.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(names)]).first()
        shift = np.array([means[f"a{i}"] or 0.0 for i in range(len(names))])
    else:
        shift = np.full(len(names), centre)
    at_x, at_y = [names.index(c) for c in xs], [names.index(c) for c in ys]

    def partial(batches):
        total = np.zeros((6, p, q))
        for b in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - shift
            w = np.isfinite(z).astype(float)
            z = np.where(w > 0, z, 0.0)
            x, wx, y, wy = z[:, at_x], w[:, at_x], z[:, at_y], w[:, at_y]
            total += np.stack([wx.T @ wy, x.T @ wy, wx.T @ y, (x * x).T @ wy, wx.T @ (y * y), x.T @ y])
        i, j = (v.ravel() for v in np.indices((p, q)))
        cols = {k: pa.array(total[n].ravel()) for n, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **cols})

    parts = clean.select(*names).mapInArrow(
        partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    )
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.greatest("n", F.lit(1.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # What is left of a sum of squares after rounding is not spread.
    near = lambda at: F.element_at(F.array(*[F.lit(float(s)) for s in shift[at]]), F.col("i" if at is at_x else "j") + 1)
    dust = lambda s, at: F.greatest(1e-12 * F.col(s), 1e-28 * n * near(at) * near(at))
    flat = (vx <= dust("sxx", at_x)) | (vy <= dust("syy", at_y))
    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(F.abs(vx) * F.abs(vy)))
    label = lambda many, c: F.element_at(F.array(*[F.lit(v) for v in many]), F.col(c) + 1)
    return sums.select(
        label(xs, "i").alias("x"),
        label(ys, "j").alias("y"),
        F.col("n").cast("long").alias("n"),
        F.when((F.col("n") < least) | flat, 0.0)
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))))
        .alias("r"),
    )
