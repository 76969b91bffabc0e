"""What scores say about groups and metadata, and summaries of a model."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenframe.functions.parsing import finite, is_blank
from eigenframe.operators.pca import PCAModel
from eigenframe.operators.profile import pair_correlations
from eigenframe.operators.transforms import MAX_LEVELS, levels, sort_labels
from eigenframe.plans.dense import t_two_sided
from eigenframe.plans.durable import stored
from eigenframe.plans.ranges import GROUP_ROWS, MAX_RANGES
from eigenframe.plans.row_ranks import count_classes, rank_rows, rank_sums

# Chi-square with two degrees of freedom at each level.
CHI2 = {0.90: 4.605, 0.95: 5.991, 0.99: 9.210}
FEW_VALUES = 1024  # values of a column that may all be bounds of its ranks


def ellipses(df: DataFrame, group: str, x: str, y: str, level: float = 0.95) -> DataFrame:
    """Confidence ellipse of each group of three or more points; the angle is taken modulo π.

    Groups without a label and groups on a line are left out.
    """
    if level not in CHI2:
        raise ValueError(f"levels are {sorted(CHI2)}")
    # Unfolding one struct keeps what x and y are computed from out of the six aggregates.
    point = F.struct(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y"))
    pts = df.select(F.col(group).alias("group"), F.inline(F.array(point)))
    pts = pts.dropna(subset=["x", "y"]).filter(~is_blank(F.col("group")))
    g = pts.groupBy("group").agg(
        F.count("*").alias("n"),
        F.avg("x").alias("center_x"),
        F.avg("y").alias("center_y"),
        F.var_samp("x").alias("a"),
        F.covar_samp("x", "y").alias("b"),
        F.var_samp("y").alias("c"),
    ).filter("n >= 3")
    half = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, 2) + F.pow("b", 2))
    g = g.withColumn("l1", (F.col("a") + F.col("c")) / 2 + half).withColumn("l2", (F.col("a") + F.col("c")) / 2 - half)
    turn = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    chi = CHI2[level]
    return g.filter(F.col("l2") > 1e-12 * F.col("l1")).select(
        "group", "n", "center_x", "center_y",
        F.sqrt(chi * F.col("l1")).alias("major"),
        F.sqrt(chi * F.col("l2")).alias("minor"),
        F.when(turn < 0, turn + math.pi).otherwise(turn).alias("angle"),
    )


def indicator_columns(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[str, str]]:
    """``name_value`` for every value of the categorical columns (few values each)."""
    out = {}
    for c in cols:
        found = levels(df, c, 50 * MAX_LEVELS)
        if found is None:
            raise ValueError(f"{c} has too many values to correlate one by one")
        out |= {f"{c}_{v}": (c, v) for v in sort_labels(found)}
    return out


def score_correlations(
    df: DataFrame,
    scores: Sequence[str],
    numeric: Sequence[str] = (),
    categorical: Sequence[str] = (),
    method: str = "pearson",
) -> DataFrame:
    """``(variable, component, n, r, p)``: every variable against every score.

    Pairs with a gap or an infinity go; fewer than three pairs give r = p = 0.
    Variables come in falling order of their correlation with the first score.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    marks = indicator_columns(df, categorical)
    base = df.select(
        *[finite(F.col(c)).alias(c) for c in scores],
        *[finite(F.col(c)).alias(f"_v{i}") for i, c in enumerate(numeric)],
        *[F.when(F.trim(F.col(c)) == v, 1.0).otherwise(0.0).alias(f"_v{i + len(numeric)}") for i, (c, v) in enumerate(marks.values())],
    )
    names = [*numeric, *marks]
    found: list[tuple] = []
    spark = df.sparkSession
    if method == "pearson":
        found += _correlate(base, scores, range(len(names)), names)
    else:
        found += _correlate_ranks(base, list(scores), names)
    first = {v: r for v, c, _n, r in found if c == scores[0]}
    place = {v: k for k, v in enumerate(sorted(names, key=lambda v: (-first[v], v)))}
    rows = [(place[v], v, c, n, float(r), _p(spark, r, n)) for v, c, n, r in found]
    return spark.createDataFrame(rows, "place int, variable string, component string, n long, r double, p double")


def _correlate_ranks(base: DataFrame, scores: list[str], names: Sequence[str], group_rows: int = GROUP_ROWS) -> list[tuple]:
    """As :func:`_correlate`, of ranks made after the pairs with gaps are gone."""
    counts = base.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in base.columns]).first()
    whole = all(counts[c] == counts["rows"] for c in scores)
    full = [i for i in range(len(names)) if counts[f"_v{i}"] == counts["rows"]]
    rest = [i for i in range(len(names)) if i not in full]
    # Variables without gaps share one ranking of the scores, each of the others ranks them anew; so does each score with gaps.
    sets = [(some, many) for some in ([scores] if whole else [[c] for c in scores]) for many in [full, *[[i] for i in rest]] if many]
    plain, at, bounds = _plain(base, [[*some, *[f"_v{i}" for i in many]] for some, many in sets], counts["rows"], group_rows)
    ranking = count_classes(plain, [[at[c] for c in (*some, *[f"_v{i}" for i in many])] for some, many in sets], bounds)
    sums = rank_sums(plain, ranking, [([at[c] for c in some], [at[f"_v{i}"] for i in many]) for some, many in sets])
    pairs = [(i, c, sums[at[c], at[f"_v{i}"]]) for i in ([*full, *rest] if whole else range(len(names))) for c in scores]
    return [(names[i], c, int(s[0]), _r_of_sums(*s.tolist())) for i, c, s in pairs]


def _r_of_sums(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> float:
    """Pearson's r of ranks from sums about their mean; fewer than three pairs, or ranks without spread, give 0."""
    mean = (n + 1) / 2
    vx, vy = sxx - sx * sx / max(n, 1), syy - sy * sy / max(n, 1)
    if n < 3 or any(v <= max(1e-12 * s, 1e-28 * n * mean * mean) for v, s in ((vx, sxx), (vy, syy))):
        return 0.0
    return max(-1.0, min(1.0, (sxy - sx * sy / n) / math.sqrt(vx * vy)))


def _ranks_of(base: DataFrame, sets: Sequence[Sequence[str]], rows: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(set, ranks): for each set of columns, the average ranks of its complete rows, in the order of the columns."""
    plain, at, bounds = _plain(base, sets, rows, group_rows)
    plain = stored(plain, "columns")
    out = rank_rows(plain, count_classes(plain, [[at[c] for c in some] for some in sets], bounds))
    out.stored_at = plain.stored_at
    return out


def _plain(base: DataFrame, sets: Sequence[Sequence[str]], rows: int, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, dict[str, int], list[np.ndarray]]:
    """The columns of all sets as doubles, their numbers, and bounds that leave a task few enough rows."""
    columns = list(dict.fromkeys(c for some in sets for c in some))
    plain = base.select(*[(F.col(c) + 0.0).alias(f"x{i}") for i, c in enumerate(columns)])
    cells = rows * max(len(columns), sum(map(len, sets)))  # a row has a rank for each set
    bounds = _bounds_of(plain, min(MAX_RANGES, math.ceil(cells / max(16, group_rows)) or 1), rows)
    return plain, {c: i for i, c in enumerate(columns)}, bounds


def _bounds_of(plain: DataFrame, ranges: int, rows: int) -> list[np.ndarray]:
    """Rising bounds of each column from a sample: all its values if they are few. Ranks never depend on them."""
    wanted = max(4096, 32 * ranges)
    picked = plain.sample(fraction=wanted / rows, seed=7) if wanted < rows else plain
    out = []
    for cells in picked.limit(4 * wanted).toArrow().columns:
        x = cells.to_numpy()
        x = np.sort(x[~np.isnan(x)])
        values = np.unique(x)
        out.append(values if len(values) <= FEW_VALUES and len(x) > 2 * len(values) else np.unique(x[len(x) // ranges :: max(1, len(x) // ranges)]))
    return out


def _correlate(df: DataFrame, scores: Sequence[str], many, names: Sequence[str]) -> list[tuple]:
    """One row per variable and score (few of either), in that order."""
    label = {f"_v{i}": names[i] for i in many}
    rows = pair_correlations(df, list(label), list(scores), 3).collect()
    got = {(label[r["x"]], r["y"]): (r["n"], r["r"]) for r in rows}
    return [(v, c, *got[(v, c)]) for v in label.values() for c in scores]


def _p(spark, r: float, n: int) -> float:
    if n < 3:
        return 0.0
    if abs(r) >= 1 - 1e-15:
        return 0.0
    return t_two_sided(spark, r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def most_influential(loadings: DataFrame) -> DataFrame:
    """The variable with the largest absolute loading on each component (first name on ties)."""
    return loadings.groupBy("component").agg(
        F.min_by("variable", F.struct(-F.abs("loading"), F.col("variable"))).alias("variable"),
        F.max(F.abs("loading")).alias("loading"),
    )


def components_for(variance: DataFrame, share: float = 0.8) -> DataFrame:
    """Fewest components whose cumulative share reaches ``share``, else all of them.

    ``variance`` has one row ``(k, cumulative)`` per component.
    """
    enough = F.min(F.when(F.col("cumulative") >= share, F.struct("k", "cumulative")))
    return variance.agg(F.coalesce(enough, F.max(F.struct("k", "cumulative"))).alias("s")).select(
        F.col("s.k").alias("components"), F.col("s.cumulative").alias("cumulative")
    )


def kaiser(model: PCAModel) -> dict:
    """Components with λ > 1 of a standardised model, at least one; ``censored`` if the count ran out."""
    if model.scaling != "standard":
        return {"components": None, "censored": False}
    if model.method == "svd" and len(model.all_eigenvalues) > model.k:
        return {"components": max(1, int((model.all_eigenvalues > 1).sum())), "censored": False}
    large = model.ratio * model.width > 1
    count = int(large.argmin()) if not large.all() else len(large)
    most = min(model.width, model.n - 1)
    return {"components": max(1, count), "censored": bool(large.all() and model.k < most)}


def model_overview(model: PCAModel, df: DataFrame) -> DataFrame:
    """One row: size, variance, recommended component counts, limits."""
    cum = model.cumulative
    hit = [i for i, c in enumerate(cum) if c >= 0.8]
    enough = (hit[0] if hit else len(cum) - 1) + 1
    k = kaiser(model)
    row = (
        model.method, model.n, model.width, model.k, float(cum[-1]), enough, float(cum[enough - 1]), k["components"],
        k["censored"], *[float(model.limits.get(x, 0.0)) for x in ("t2_95", "t2_99", "q_95", "q_99")],
    )
    schema = (
        "method string, rows long, variables int, components int, captured double, components_80 int, captured_80 double, "
        "kaiser int, kaiser_censored boolean, t2_95 double, t2_99 double, q_95 double, q_99 double"
    )
    return df.sparkSession.createDataFrame([row], schema)


def biplot_scale(scored: DataFrame, loadings: DataFrame, x: str = "pc1", y: str = "pc2", reach: float = 0.7) -> DataFrame:
    """Loading arrows stretched so that the longest is 70 % of the plot (1.2 times the largest score, at least 1).

    ``loadings`` has one row ``(variable, x, y)`` per variable.
    """
    span = scored.agg(F.greatest(F.max(F.abs(x)), F.max(F.abs(y))).alias("span")).first()["span"] or 0.0
    longest = loadings.agg(F.max(F.hypot("x", "y"))).first()[0] or 0.0
    f = reach * max(1.2 * span, 1.0) / longest if longest > 0 else 1.0
    return loadings.select("variable", (F.col("x") * f).alias("x"), (F.col("y") * f).alias("y"))


def max_components(method: str, rows: int, variables: int, lags: int = 1) -> int:
    """The most components a method can give."""
    if method == "kernel":
        return max(1, rows)
    if method == "lagged":
        return max(1, min(rows - lags + 1, variables * lags))
    return max(1, min(rows, variables))
