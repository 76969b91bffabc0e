"""Column transforms: a pass of statistics where one is needed, then plain expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eigenframe.functions.parsing import is_blank, to_number, trimmed
from eigenframe.roles import stem, unique_name

MAX_LEVELS = 20  # values one-hot encoding spreads over columns
MAX_PARTS = 20  # columns a split may make
FLAT = 1e-10

# Word lists in the order their levels rise.
LEVEL_ORDERS = (
    ("low", "medium", "high"),
    ("low", "med", "high"),
    ("very low", "low", "medium", "high", "very high"),
    ("small", "medium", "large"),
    ("xs", "s", "m", "l", "xl", "xxl"),
    ("poor", "fair", "good", "very good", "excellent"),
    ("never", "rarely", "sometimes", "often", "always"),
    ("strongly disagree", "disagree", "neutral", "agree", "strongly agree"),
    ("cold", "warm", "hot"),
    ("none", "mild", "moderate", "severe"),
    ("primary", "secondary", "tertiary"),
    ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"),
    ("mon", "tue", "wed", "thu", "fri", "sat", "sun"),
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    ("lav", "middels", "høy"),
    ("lav", "middels", "høg"),
    ("svært lav", "lav", "middels", "høy", "svært høy"),
    ("svært lav", "lav", "middels", "høg", "svært høg"),
    ("liten", "middels", "stor"),
    ("dårlig", "middels", "god", "svært god", "utmerket"),
    ("aldri", "sjelden", "av og til", "ofte", "alltid"),
    ("aldri", "sjeldan", "av og til", "ofte", "alltid"),
    ("helt uenig", "uenig", "nøytral", "enig", "helt enig"),
    ("heilt ueinig", "ueinig", "nøytral", "einig", "heilt einig"),
    ("ingen", "mild", "moderat", "alvorlig"),
    ("ingen", "mild", "moderat", "alvorleg"),
    ("kald", "lunken", "varm", "het"),
    ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag"),
    ("måndag", "tysdag", "onsdag", "torsdag", "fredag", "laurdag", "søndag"),
    ("man", "tir", "ons", "tor", "fre", "lør", "søn"),
    ("januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember"),
    ("jan", "feb", "mar", "apr", "mai", "jun", "jul", "aug", "sep", "okt", "nov", "des"),
)


def _stats(df: DataFrame, cols: Sequence[str], *fns: Callable) -> dict[str, list]:
    row = df.agg(*[f(c).alias(f"s{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(fns)]).first()
    return {c: [row[f"s{i}_{j}"] for j in range(len(fns))] for i, c in enumerate(cols)}


# --- arithmetic ------------------------------------------------------------------------

_MATH: dict[str, tuple[Callable[[Column], Column], Callable[[float], bool] | None]] = {
    "log": (F.ln, lambda lo: lo > 0),
    "sqrt": (F.sqrt, lambda lo: lo >= 0),
    "square": (lambda c: c * c, None),
}


def math_transform(df: DataFrame, kind: str, cols: Sequence[str]) -> DataFrame:
    """``log``, ``sqrt`` or ``square``; a column with a value outside the domain stays as it is."""
    fn, inside = _MATH[kind]
    ok = list(cols)
    if inside:
        low = _stats(df, cols, F.min)
        ok = [c for c in cols if low[c][0] is not None and inside(low[c][0])]
    return df.withColumns({c: fn(F.col(c).cast("double")) for c in ok}) if ok else df


def strict_transform(df: DataFrame, kind: str, cols: Sequence[str]) -> DataFrame:
    """As above plus ``reciprocal``; a value outside the domain fails the job."""
    bad = {
        "log": lambda c: c <= 0,
        "sqrt": lambda c: c < 0,
        "square": lambda _c: F.lit(False),
        "reciprocal": lambda c: F.abs(c) < FLAT,
    }[kind]
    fn = _MATH[kind][0] if kind in _MATH else lambda c: 1.0 / c
    out = {}
    for name in cols:
        c = F.col(name).cast("double")
        fail = F.raise_error(F.lit(f"{kind}: column {name} holds a value outside its domain")).cast("double")
        out[name] = F.when(bad(c), fail).otherwise(fn(F.when(~bad(c), c)))
    return df.withColumns(out)


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1; fewer than two values or no spread: unchanged."""
    s = _stats(df, cols, F.count, F.avg, F.stddev_pop)
    ok = {c: v for c, v in s.items() if v[0] >= 2 and v[2] >= FLAT}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(sd) for c, (_n, m, sd) in ok.items()}) if ok else df


def minmax(df: DataFrame, cols: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    s = _stats(df, cols, F.min, F.max)
    ok = {c: v for c, v in s.items() if v[0] is not None and v[1] > v[0]}
    return df.withColumns(
        {c: F.lit(low) + (F.col(c) - F.lit(float(a))) / F.lit(float(b - a)) * (high - low) for c, (a, b) in ok.items()}
    ) if ok else df


def zscore_filter(df: DataFrame, cols: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Rows without any |z| above the threshold (sample deviation)."""
    s = _stats(df, cols, F.avg, F.stddev_samp)
    far = [F.abs((F.col(c) - F.lit(m)) / F.lit(sd)) > threshold for c, (m, sd) in s.items() if sd]
    if not far:
        return df
    hit = far[0]
    for f in far[1:]:
        hit = hit | f
    return df.filter(~F.coalesce(hit, F.lit(False)))


# --- bins --------------------------------------------------------------------------------


def equal_bins(df: DataFrame, cols: Sequence[str], bins: int = 5, labels: Sequence[str] = ()) -> DataFrame:
    """``Bin_1`` … of equal width (or the given labels); constant columns stay."""
    s = _stats(df, cols, F.min, F.max)
    n = len(labels) or bins
    out = {}
    for c, (lo, hi) in s.items():
        if lo is None or hi <= lo:
            continue
        at = F.floor((F.col(c) - F.lit(float(lo))) / F.lit((hi - lo) / n))
        at = F.when(at >= n, F.lit(n - 1)).otherwise(at).cast("int")  # NULL stays NULL
        out[c] = (
            F.element_at(F.array(*[F.lit(x) for x in labels]), at + 1)
            if labels
            else F.concat(F.lit("Bin_"), (at + 1).cast("string"))
        )
    return df.withColumns(out) if out else df


def edge_bins(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str], name: str) -> DataFrame:
    """Half-open bins ``[e0, e1)``, ``[e1, e2)`` … between fixed edges; outside them NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin")
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = F.when((F.col(col) >= lo) & (F.col(col) < hi), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


# --- categories -------------------------------------------------------------------------------


def sort_labels(values: Sequence[str]) -> list[str]:
    """By number if all are numbers, else as text."""
    try:
        return sorted(values, key=lambda v: (_finite(v), v))
    except ValueError:
        return sorted(values)


def _finite(text: str) -> float:
    value = float(text)
    if math.isnan(value):
        raise ValueError(text)
    return value


def levels(df: DataFrame, col: str, limit: int) -> list[str] | None:
    """The distinct values of a column, or None if there are more than ``limit``."""
    rows = df.filter(~is_blank(F.col(col))).select(trimmed(F.col(col)).alias("v")).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [r["v"] for r in rows]


def one_hot(df: DataFrame, cols: Sequence[str], drop: bool = False, max_levels: int = MAX_LEVELS) -> DataFrame:
    """One 0/1 column per value; a column of more than ``max_levels`` values is an error."""
    for c in cols:
        found = levels(df, c, max_levels)
        if found is None:
            raise ValueError(f"{c}: more than {max_levels} values")
        if not found:
            continue
        taken = list(df.columns)
        flags = {}
        for v in sort_labels(found):
            name = unique_name(f"{stem(c)}_{v}", [*taken, *flags])
            flags[name] = F.when(trimmed(F.col(c)) == v, 1).otherwise(0)
        df = df.withColumns(flags)
        df = df.drop(c) if drop else df
    return df


def ordinal(df: DataFrame, col: str, order: Sequence[str] = (), drop: bool = False, limit: int = 10_000) -> DataFrame:
    """Codes 0, 1, … by the given order, values not named after it in label order; blanks stay blank."""
    found = levels(df, col, limit)
    if found is None:
        raise ValueError(f"{col}: more than {limit} values")
    if not found:
        return df
    placed = [v for v in dict.fromkeys(order) if v in found]
    placed += sort_labels([v for v in found if v not in placed])
    codes = F.create_map(*[x for i, v in enumerate(placed) for x in (F.lit(v), F.lit(i))])
    out = df.withColumn(unique_name(f"{stem(col)}_code", df.columns), F.try_element_at(codes, trimmed(F.col(col))))
    return out.drop(col) if drop else out


def suggest_order(df: DataFrame, col: str, limit: int = 1000) -> list[str]:
    """A known order of levels, sizes, days … that holds all values, else label order."""
    found = levels(df, col, limit)
    if found is None:
        raise ValueError(f"{col}: more than {limit} values")
    if len(found) > 1:
        for known in LEVEL_ORDERS:
            if all(v.lower() in known for v in found):
                return sorted(found, key=lambda v: (known.index(v.lower()), v))
    return sort_labels(found)


# --- text ------------------------------------------------------------------------------------


def split_column(df: DataFrame, col: str, delimiter: str, drop: bool = False) -> DataFrame:
    """``stem_1``, ``stem_2`` …; unchanged if the delimiter never occurs."""
    if not delimiter:
        raise ValueError("a delimiter is needed")
    parts = F.split(F.col(col).cast("string"), re.escape(delimiter), -1)
    cells = F.when(~is_blank(F.col(col)), parts)
    widest = df.agg(F.max(F.size(cells))).first()[0] or 0
    if widest > MAX_PARTS:
        raise ValueError(f"{col}: {widest} parts, more than {MAX_PARTS}")
    if widest <= 1:
        return df
    names: list[str] = []
    for i in range(widest):
        names.append(unique_name(f"{stem(col)}_{i + 1}", [*df.columns, *names]))
    out = df.withColumns({n: F.coalesce(F.get(cells, i), F.lit("")) for i, n in enumerate(names)})
    return out.drop(col) if drop else out


def combine_columns(
    df: DataFrame, cols: Sequence[str], separator: str = " ", name: str = "", drop: bool = False
) -> DataFrame:
    """Cells joined with a separator, blanks kept as blanks."""
    if len(cols) < 2 or len(set(cols)) < len(cols):
        raise ValueError("combining needs two or more different columns")
    new = unique_name(name or "_".join(cols), df.columns)
    out = df.withColumn(new, F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return out.drop(*cols) if drop else out


# --- compositions ---------------------------------------------------------------------------


def _row_sum(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def replace_zeros(df: DataFrame, cols: Sequence[str], delta: float | None = None) -> DataFrame:
    """Zeros become ``delta`` and the other parts shrink so that every row total is kept.

    Martín-Fernández, Barceló-Vidal & Pawlowsky-Glahn (2003). A zero without a
    delta, a row of zeros, or a delta that would use up the row fails the job.
    """
    xs = [F.col(c).cast("double") for c in cols]
    zeros = _row_sum([F.when(x == 0, 1).otherwise(0) for x in xs])
    total = _row_sum(xs)
    if delta is None or delta <= 0:
        stop = F.raise_error(F.lit("a part is zero and no replacement was given")).cast("double")
        return df.withColumns({c: F.when(x == 0, stop).otherwise(x) for c, x in zip(cols, xs)})
    staged = df.withColumn("_zeros", zeros).withColumn("_total", total)
    bad = (F.col("_zeros") > 0) & (F.col("_total") <= delta * F.col("_zeros"))
    stop = F.raise_error(F.lit("the replacement would use up a whole row")).cast("double")
    keep = F.when(bad, stop).when(F.col("_zeros") > 0, 1 - F.try_divide(delta * F.col("_zeros"), F.col("_total"))).otherwise(1.0)
    staged = staged.withColumn("_keep", keep)
    fixed = {c: F.when(x == 0, F.when(F.col("_keep") <= 1, F.lit(float(delta)))).otherwise(x * F.col("_keep")) for c, x in zip(cols, xs)}
    return staged.withColumns(fixed).drop("_zeros", "_total", "_keep")


def clr(df: DataFrame, cols: Sequence[str], delta: float | None = None, drop: bool = False) -> DataFrame:
    """Centred log-ratio (Aitchison 1982) of complete, non-negative parts, as ``x_clr``."""
    if len(cols) < 2 or len(set(cols)) < len(cols):
        raise ValueError("a composition needs two or more different parts")
    part = {}
    for c in cols:
        x = F.col(c).cast("double")
        stop = F.raise_error(F.lit(f"part {c} is missing or negative")).cast("double")
        part[f"_p_{c}"] = F.when(x.isNull() | F.isnan(x) | (x < 0), stop).otherwise(x)
    staged = replace_zeros(df.withColumns(part), list(part), delta)
    staged = staged.withColumns({p: F.ln(p) for p in part})
    staged = staged.withColumn("_mean", _row_sum([F.col(p) for p in part]) / len(cols))
    names: list[str] = []
    for c in cols:
        names.append(unique_name(f"{c}_clr", [*df.columns, *names]))
    out = staged.withColumns({n: F.col(f"_p_{c}") - F.col("_mean") for n, c in zip(names, cols)}).drop("_mean", *part)
    return out.drop(*cols) if drop else out


def closure(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Extremes and mean of the row sums, and whether they are one constant (within 1 %)."""
    total = _row_sum([F.col(c).cast("double") for c in cols])
    s = df.select(total.alias("s")).agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"), F.avg("s").alias("mean_sum"))
    spread = F.try_divide(F.col("max_sum") - F.col("min_sum"), F.col("mean_sum"))
    return s.withColumn("closed", F.coalesce((F.col("mean_sum") > 0) & (spread < 0.01), F.lit(False)))


# --- power transforms ------------------------------------------------------------------------


def box_cox(x: Column, lam: Column | float) -> Column:
    """Box & Cox (1964), x > 0."""
    p = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(p == 0, F.ln(x)).otherwise(F.try_divide(F.pow(x, p) - 1, p))


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """Yeo & Johnson (2000), any x."""
    p = lam if isinstance(lam, Column) else F.lit(float(lam))
    up, down = F.greatest(x, F.lit(0.0)), F.greatest(-x, F.lit(0.0))
    pos = F.when(p == 0, F.log1p(up)).otherwise(F.try_divide(F.pow(up + 1, p) - 1, p))
    neg = F.when(p == 2, -F.log1p(down)).otherwise(-F.try_divide(F.pow(down + 1, 2 - p) - 1, 2 - p))
    return F.when(x >= 0, pos).when(x < 0, neg)


def power_transform(df: DataFrame, kind: str, cols: Sequence[str], lam: float | None = None) -> DataFrame:
    """``box-cox`` or ``yeo-johnson``; without λ it is fitted by maximum likelihood.

    Box–Cox leaves a column with a value <= 0 as it is.
    """
    fn = {"box-cox": box_cox, "yeo-johnson": yeo_johnson}[kind]
    low = _stats(df, cols, F.count, F.min)
    out = {}
    for c in cols:
        n, lo = low[c]
        if not n or (kind == "box-cox" and lo <= 0):
            continue
        out[c] = fn(F.col(c).cast("double"), best_lambda(df, c, kind) if lam is None else lam)
    return df.withColumns(out) if out else df


def best_lambda(df: DataFrame, col: str, kind: str, lo: float = -5.0, hi: float = 5.0, points: int = 33) -> float:
    """λ of highest profile likelihood: a grid per scan, each one narrower, then a parabola."""
    fn = {"box-cox": box_cox, "yeo-johnson": yeo_johnson}[kind]
    x = df.select(F.col(col).cast("double").alias("x")).filter("x is not null")
    xc = F.col("x")
    jac = F.ln(xc) if kind == "box-cox" else F.signum(xc) * F.log1p(F.abs(xc))
    left, right = lo, hi
    best = 0.0
    for _ in range(4):
        step = (right - left) / (points - 1)
        grid = [left + i * step for i in range(points)]
        tried = x.select("x", jac.alias("j"), F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("i", "g"))
        rows = (
            tried.groupBy("i").agg(F.count("*").alias("n"), F.sum("j").alias("j"), F.var_pop(fn(xc, F.col("g"))).alias("v")).collect()
        )
        like = [-math.inf] * points
        for r in rows:
            if r["v"] is not None and math.isfinite(r["v"]) and r["v"] > 0:
                like[r["i"]] = -0.5 * r["n"] * math.log(r["v"]) + (grid[r["i"]] - 1) * r["j"]
        top = max(range(points), key=like.__getitem__)
        best = grid[top]
        if 0 < top < points - 1 and math.isfinite(like[top - 1] + like[top + 1]):
            a, b, c = like[top - 1 : top + 2]
            if a - 2 * b + c < 0:
                best += 0.5 * step * (a - c) / (a - 2 * b + c)
        left, right = max(lo, best - step), min(hi, best + step)
    return best


def transform(df: DataFrame, kind: str, cols: Sequence[str], **options) -> DataFrame:
    """One door to every column transform."""
    cols = list(cols)
    table: dict[str, Callable[[], DataFrame]] = {
        "log": lambda: math_transform(df, "log", cols),
        "sqrt": lambda: math_transform(df, "sqrt", cols),
        "square": lambda: math_transform(df, "square", cols),
        "standardise": lambda: standardise(df, cols),
        "minmax": lambda: minmax(df, cols, **options),
        "bin": lambda: equal_bins(df, cols, **options),
        "onehot": lambda: one_hot(df, cols, **options),
        "ordinal": lambda: ordinal(df, cols[0], **options),
        "split": lambda: split_column(df, cols[0], **options),
        "combine": lambda: combine_columns(df, cols, **options),
        "clr": lambda: clr(df, cols, **options),
        "box-cox": lambda: power_transform(df, "box-cox", cols, **options),
        "yeo-johnson": lambda: power_transform(df, "yeo-johnson", cols, **options),
    }
    if kind not in table:
        raise ValueError(f"unknown transform {kind!r}")
    return table[kind]()


def month_first(c: Column, languages: Sequence[Sequence[str]] = LEVEL_ORDERS[13:15]) -> Column:
    """``"March 2021"`` to the first day of that month; month names in any of the given lists."""
    month = F.lower(F.trim(F.regexp_extract(c, r"^\s*(\D+?)\.?\s*[0-9]{4}\s*$", 1)))
    year = F.regexp_extract(c, r"([0-9]{4})\s*$", 1).try_cast("int")
    nr = F.coalesce(*[F.nullif(F.array_position(F.array(*[F.lit(m) for m in names]), month), F.lit(0)) for names in languages])
    return F.make_date(year, nr.cast("int"), F.lit(1))


def label_order(col: str) -> list[Column]:
    """Sort keys that put numeric labels by value, then text."""
    return [to_number(F.col(col), na=()).asc_nulls_last(), F.col(col)]
