"""Principal-component regression: every fold and every component count from two scans.

Scan one adds up cross moments per fold. Training moments are the total minus
the fold, so each fold is refitted (preprocessing, components, regression) from
an object of the size of its variables. Scan two predicts each held-out row for
all component counts at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenframe.operators import wide_regression
from eigenframe.operators.pca import PCAModel, Regression, _complete, _model
from eigenframe.operators.rowstage import MAD_SCALE, Features, RowStage, apply_row_stage, robust_stats, stage_numbers
from eigenframe.operators.scoring import predict
from eigenframe.plans.dense import floor_at_one, score_paths
from eigenframe.plans.durable import discard, stored
from eigenframe.plans.fold_ranks import robust_scales
from eigenframe.plans.gram import MAX_WIDTH, column_means, feature_array, first_width, gram, moments_from
from eigenframe.plans.products import Rows, scans
from eigenframe.plans.ranges import GROUP_ROWS, MAX_RANGES, cuts_before, dense_index, hash_cuts

BROADCAST_CELLS = 4_000_000  # coefficients of all folds together that may be broadcast
RULES = ("min", "one-se", "tolerance", "first-min", "wold")


@dataclass(frozen=True)
class CV:
    """How rows are held out. ``folds=0`` leaves one row (or group) out at a time."""

    folds: int = 10
    scheme: str = "kfold"  # kfold, forward
    group_by: str | None = None
    order_by: tuple[str, ...] = ()
    shuffle: bool = False
    repeats: int = 1
    seed: int = 0
    min_train: int = 0


@dataclass(frozen=True)
class PCRResult:
    model: PCAModel
    curve: DataFrame | None
    selected: int
    notes: dict
    out_of_fold: DataFrame | None
    max_components: int
    labelled: int
    excluded: int


# --- folds -----------------------------------------------------------------------------


def group_codes(df: DataFrame, group: str, order_by: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(group, code)``: 0, 1, … by first appearance."""
    firsts = df.groupBy(group).agg(F.min(F.struct(*order_by)).alias("_first"))
    flat = firsts.select(group, "_first.*") if group not in order_by else firsts.select(group, *[F.col("_first")[c].alias(f"_o_{c}") for c in order_by])
    keys = [c for c in flat.columns if c != group]
    return dense_index(flat, keys, name="code", group_rows=group_rows).select(group, "code")


def _cut(position: Column, parts: Column | int, total: Column | int) -> Column:
    """Number of the even cut ⌊i·n/k⌋ that a 0-based position falls into."""
    p = parts if isinstance(parts, Column) else F.lit(parts)
    n = total if isinstance(total, Column) else F.lit(total)
    return F.floor(((position + 1) * p - 1) / n).cast("int")


def _even_runs(df: DataFrame, order_by, parts: int, n: int, name: str, group_rows: int) -> DataFrame:
    """Even runs of ordered rows: only the keys are sorted, to find where the runs start."""
    starts = [i * n // parts for i in range(1, parts)]
    run = cuts_before(df, order_by, starts, n, group_rows)
    return df.withColumn(name, run.cast("int")).withColumn("repeat", F.lit(0))


def _shuffled_runs(df: DataFrame, cv: CV, parts: int, n: int, name: str) -> DataFrame:
    """Even runs in the order of a seeded hash: rows are counted by their hashes to find the edges, and never move."""
    starts = [i * n // parts for i in range(1, parts)]
    mixes = [F.xxhash64(*cv.order_by, F.lit(cv.seed) + F.lit(r)) for r in range(cv.repeats)]
    runs = F.array(*[hash_cuts(df, mix, cv.order_by, starts).cast("int") for mix in mixes])
    return df.select("*", F.posexplode(runs).alias("repeat", name))


def assign_folds(df: DataFrame, cv: CV, name: str = "fold", group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add the fold in which a row is held out (per repeat, a column ``repeat``).

    ``kfold`` cuts rows or groups, in order of appearance or of a seeded hash,
    into even runs. ``forward`` cuts the ordered rows into folds + 1 blocks;
    block 0 only trains, block b is predicted from all blocks before it.
    """
    if not cv.order_by:
        raise ValueError("folds need order_by: rows have no position of their own")
    if cv.scheme == "forward":
        if cv.folds < 1:
            raise ValueError("forward chaining needs at least one split")
        n, blocks = df.count(), cv.folds + 1
        if n < blocks:
            raise ValueError(f"{n} rows cannot make {cv.folds} splits")
        return _even_runs(df, cv.order_by, blocks, n, name, group_rows)
    if cv.scheme != "kfold":
        raise ValueError(f"unknown scheme {cv.scheme!r}")
    loo = cv.folds == 0
    if cv.repeats > 1 and (loo or not cv.shuffle):
        raise ValueError("repeats need shuffled folds, and leave-one-out has only one design")
    units = group_codes(df, cv.group_by, cv.order_by, group_rows) if cv.group_by else df
    n = units.count()
    k = n if loo else cv.folds
    if n < 2 or k < 2 or k > n:
        raise ValueError(f"{k} folds from {n} {'groups' if cv.group_by else 'rows'}")
    if not cv.group_by and not cv.shuffle and k <= MAX_RANGES:
        return _even_runs(df, cv.order_by, k, n, name, group_rows)
    if cv.shuffle and not cv.group_by and k <= MAX_RANGES:
        return _shuffled_runs(df, cv, k, n, name)
    if cv.repeats > 1:
        units = units.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(cv.repeats - 1))))
    else:
        units = units.withColumn("repeat", F.lit(0))
    key = [cv.group_by] if cv.group_by else list(cv.order_by)
    order = ["code"] if cv.group_by else key
    if cv.shuffle:
        units, order = units.withColumn("_mix", F.xxhash64(*key, F.lit(cv.seed) + F.col("repeat"))), ["_mix", *order]
    by = ["repeat"] if cv.repeats > 1 else []
    placed = dense_index(units, order, by, "_pos", group_rows, n).withColumn(name, _cut(F.col("_pos"), k, n))
    if not cv.group_by:
        return placed.drop("_pos", "_mix")
    side = placed.select(F.col(cv.group_by).alias("_f"), "repeat", name)
    return df.join(side, F.col(cv.group_by).eqNullSafe(F.col("_f")), "inner").drop("_f")


# --- selection ----------------------------------------------------------------------------


def choose_k(
    curve: Sequence[tuple[int, float, float]], rule: str = "one-se", tolerance: float = 0.0, wold_r: float = 1.0
) -> int:
    """Component count from ``(k, error, standard error)`` points in rising k."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    if not curve:
        raise ValueError("an empty curve")
    ks, err, se = zip(*curve)
    low = min(range(len(err)), key=lambda i: (err[i], i))
    if rule == "min":
        return ks[low]
    if rule in ("one-se", "tolerance"):
        if tolerance < 0:
            raise ValueError("tolerance must not be negative")
        bar = err[low] + (se[low] if rule == "one-se" else tolerance)
        return next(k for k, e in zip(ks, err) if e <= bar)
    for i in range(len(err) - 1):
        if rule == "first-min":
            margin = se[i] if se[i] is not None else 0.01 * abs(err[i])
            if err[i + 1] > err[i] + margin:
                return ks[i]
        elif err[i] <= 0 or (err[i + 1] / err[i]) ** 2 > (wold_r if wold_r > 0 else 1.0):
            return ks[i]
    return ks[-1]


def choose_from_curve(curve: DataFrame, metric: str = "rmse", **kw) -> DataFrame:
    """All rules applied to a curve table (at most one row per variable)."""
    points = _points(curve.orderBy("k").collect(), metric)
    rows = [(rule, choose_k(points, rule, **kw)) for rule in RULES]
    return curve.sparkSession.createDataFrame(rows, "rule string, k int")


def _points(rows, metric: str) -> list[tuple[int, float, float]]:
    e, s = ("rmsecv", "rmse_se") if metric == "rmse" else ("mae", "mae_se")
    return [(r["k"], r[e], r[s]) for r in rows]


def curve_notes(curve: DataFrame, rule: str, metric: str, **kw) -> dict:
    """Where the error is lowest, whether it still falls at the end, and what the other metric picks."""
    rows = curve.orderBy("k").collect()
    pts = _points(rows, metric)
    low = min(range(len(pts)), key=lambda i: (pts[i][1], i))
    falling = len(pts) > 1 and pts[-1][1] < pts[-2][1] - (pts[-1][2] or 0.0)
    other = choose_k(_points(rows, "mae" if metric == "rmse" else "rmse"), rule, **kw)
    return {"lowest_error": pts[low][0], "still_falling": falling, "selected_by_other_metric": other}


def cv_curve(predictions: DataFrame) -> DataFrame:
    """Pooled error per component count, with the spread over folds.

    ``predictions`` has rows ``(repeat, fold, k, predicted, measured)``; a count
    some fold could not fit is left out.
    """
    e = F.col("predicted") - F.col("measured")
    per = predictions.withColumn("_e", e).groupBy("repeat", "fold", "k").agg(
        F.count("*").alias("n"),
        F.sum("_e").alias("se"),
        F.sum(F.col("_e") * F.col("_e")).alias("see"),
        F.sum(F.abs("_e")).alias("sae"),
        F.sum("measured").alias("sy"),
        F.var_pop("measured").alias("vy"),
    )
    return _curve_from_folds(per)


def _curve_from_folds(per: DataFrame) -> DataFrame:
    n = F.sum("n")
    total = per.groupBy("k").agg(
        n.alias("n"),
        F.count("*").alias("folds"),
        F.sqrt(F.sum("see") / n).alias("rmsecv"),
        (F.sum("se") / n).alias("bias"),
        F.sqrt(F.greatest((F.sum("see") - F.sum("se") * F.sum("se") / n) / F.greatest(n - 1, F.lit(1)), F.lit(0.0))).alias("sep"),
        (F.sum("sae") / n).alias("mae"),
        F.sum("see").alias("_see"),
        # Total spread of the response: within folds plus between fold means.
        (F.sum(F.col("n") * F.col("vy")) + F.sum(F.col("sy") * F.col("sy") / F.col("n")) - F.sum("sy") * F.sum("sy") / n).alias("_tss"),
        F.avg(F.sqrt(F.col("see") / F.col("n"))).alias("rmse_mean"),
        _standard_error(F.sqrt(F.col("see") / F.col("n"))).alias("rmse_se"),
        _standard_error(F.col("sae") / F.col("n")).alias("mae_se"),
    )
    most = total.agg(F.max("folds")).first()[0]
    q2 = F.when(F.col("_tss") > 0, 1 - F.col("_see") / F.col("_tss")).otherwise(0.0)
    return (
        total.filter(F.col("folds") == most).withColumn("q2", q2)
        .select("k", "n", "folds", "rmsecv", "bias", "sep", "mae", "q2", "rmse_mean", "rmse_se", "mae_se")
    )


def _standard_error(c: Column) -> Column:
    return F.coalesce(F.stddev_samp(c) / F.sqrt(F.count("*")), F.lit(0.0))


# --- the fit ----------------------------------------------------------------------------------


def fit_pcr(
    df: DataFrame,
    features: Features,
    y: str,
    k: int | None = None,
    cv: CV | None = None,
    rule: str = "one-se",
    metric: str = "rmse",
    tolerance: float = 0.0,
    wold_r: float = 1.0,
    scaling: str = "standard",
    row_stage: RowStage | None = None,
    max_components: int | None = None,
) -> PCRResult:
    """Components of all rows, least squares of ``y`` on the first k scores of the labelled ones.

    Give ``k``, or ``cv`` to have it chosen. Predictors must be complete; a row
    without a response still shapes the components.
    """
    if (k is None) == (cv is None):
        raise ValueError("give k or cv")
    if scaling in ("none", "scale"):
        raise ValueError("the regression needs centred variables")
    spark, stage = df.sparkSession, row_stage or RowStage()
    names = (features,) if isinstance(features, str) else tuple(features)
    m = first_width(df, features, MAX_WIDTH)
    wide = m > MAX_WIDTH
    base, source = _prepare(df, features, y, stage, cv, checked=not wide)
    # Column means ride along with the counts: the best centre for the moments to come.
    means = [] if isinstance(source, str) else [F.avg(c).alias(c) for c in source]
    size = base.agg(F.count("_y").alias("lab"), F.count("*").alias("n"), F.avg("_y").alias("y"), *means).first()
    labelled, n = int(size["lab"]), int(size["n"])
    if labelled < 3:
        raise ValueError(f"need at least 3 rows with a response, found {labelled}")
    limit = _limit(base, labelled, m, cv, max_components or k)
    if k is not None and k > limit:
        raise ValueError(f"{k} components: at most {limit} for {labelled} labelled rows and {m} variables")
    if wide and (scaling == "robust" or not (max_components or k)):
        raise ValueError(f"more than {MAX_WIDTH} predictors: plain scaling, and k or max_components must be given")
    means = [0.0] * m if wide else column_means(base, feature_array(base, source), m) if isinstance(source, str) else [size[c] for c in source]
    shift = [float(v or 0.0) for v in (*means, size["y"])]
    curve = oof = kept = None
    notes: dict = {}
    if cv is not None:
        held = assign_folds(base.filter("_y is not null"), cv)
        if wide:
            preds, kept = wide_regression.cross_validate(base, held, source, m, cv, limit, scaling, shift[-1])
        else:
            cells = _fold_cells(base, held, source, m, cv, shift, n > labelled)
            preds = _cross_validate(base, held, cells, source, m, cv, limit, scaling, shift)
        with scans(spark, m) if wide else nullcontext():
            per_fold = _fold_errors(preds, limit).collect()  # folds × component counts
        curve = _curve_from_folds(spark.createDataFrame(per_fold, _FOLD_SCHEMA))
        points = _points(curve.orderBy("k").collect(), metric)
        k = choose_k(points, rule, tolerance, wold_r)
        notes = curve_notes(curve, rule, metric, tolerance=tolerance, wold_r=wold_r) | {"rule": rule, "metric": metric}
        oof = preds.filter("repeat = 0").withColumn("predicted", F.element_at("predictions", k + 1)).select(
            *cv.order_by, "fold", "predicted", F.col("_y").alias("measured")
        )
    if wide:
        model = wide_regression.final(base, source, names, y, m, max(1, k), scaling, stage, shift[-1], kept)
    else:
        whole = cells.filter("repeat = 0") if cv is not None else _whole_cells(base, source, shift)
        model = _final(spark, base, whole, source, names, y, m, n, k, scaling, stage, shift)
    return PCRResult(model, curve, k, notes, oof, limit, labelled, n - labelled)


def _prepare(df, features, y, stage, cv, checked=True):
    """The response and the variables; not ``checked``: whoever reads the variables looks for gaps."""
    carry = list(dict.fromkeys([*(cv.order_by if cv else ()), *([cv.group_by] if cv and cv.group_by else [])]))
    target = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double")).alias("_y")
    if stage.active or isinstance(features, str):
        rows = apply_row_stage(df, features, stage, "_pcrx") if stage.active else df.withColumn("_pcrx", feature_array(df, features))
        out = rows.select(*carry, target, "_pcrx")
        return _complete(out, "_pcrx") if checked else out, "_pcrx"
    xs = [F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    cols = [f"_x{i}" for i in range(len(features))]
    out = df.select(*carry, target, *xs)
    return _complete(out, cols) if checked else out, cols


def _limit(base, labelled, m, cv, requested):
    limit = min(labelled - 2, m)
    if cv is not None:
        folds = cv.folds
        if folds == 0:
            lab = base.filter("_y is not null")
            folds = lab.select(cv.group_by).distinct().count() if cv.group_by else labelled
        if folds > 1:
            limit = min(limit, labelled - math.ceil(labelled / folds) - 2)
    if limit < 1:
        raise ValueError(f"{labelled} labelled rows leave no component to fit")
    return min(limit, requested) if requested else limit


def _with_y(source: Features) -> Features:
    return "_xy" if isinstance(source, str) else [*source, "_y0"]


def _joined(df: DataFrame, source: Features) -> DataFrame:
    """Variables and response side by side; an absent response counts as 0 and is told apart by its group."""
    out = df.withColumn("_y0", F.coalesce("_y", F.lit(0.0)))
    return out.withColumn("_xy", F.concat(source, F.array("_y0"))) if isinstance(source, str) else out


_SPARE = -1  # the fold of rows without a response
_CELLS = "repeat int, fold int, i int, j int, v double"


def _whole_cells(base, source, shift) -> DataFrame:
    joined = _joined(base, source).withColumn("fold", F.when(F.col("_y").isNull(), _SPARE).otherwise(0))
    return gram(joined, _with_y(source), shift, ["fold"])


def _fold_cells(base, held, source, m, cv, shift, spare: bool) -> DataFrame:
    """``(repeat, fold, i, j, v)``; read once and kept, unless there is a fold per row or so."""
    xy = _with_y(source)
    cells = gram(_joined(held, source), xy, shift, ["repeat", "fold"])
    if spare:
        rest = gram(_joined(base.filter("_y is null"), source), xy, shift)
        rest = rest.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(cv.repeats - 1)))).withColumn("fold", F.lit(_SPARE))
        cells = cells.unionByName(rest)
    cells = cells.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _CELLS.split(", ")])
    if cv.folds and cv.repeats * (cv.folds + 2) * (m + 2) ** 2 <= BROADCAST_CELLS:
        return cells.sparkSession.createDataFrame(cells.toPandas(), _CELLS)
    return cells


def _final(spark, base, whole, source, names, y, m, n, k, scaling, stage, shift) -> PCAModel:
    lab_or_not = whole.groupBy((F.col("fold") == _SPARE).alias("spare"), "i", "j").agg(F.sum("v").alias("v")).toPandas()
    lab = moments_from(lab_or_not[~lab_or_not["spare"]][["i", "j", "v"]].itertuples(index=False, name=None), shift)
    both = lab_or_not[(lab_or_not["i"] <= m) & (lab_or_not["j"] <= m)].groupby(["i", "j"], as_index=False)["v"].sum()
    pool = moments_from(both[["i", "j", "v"]].itertuples(index=False, name=None), shift[:m])
    if scaling == "robust":
        center, divisor = robust_stats(base, source, m)
    else:
        center, divisor = stage_numbers(pool.mean, pool.sd, scaling)
    betas, gammas, v, lam = score_paths(pool, lab, center, divisor, k)
    k = len(betas) - 1
    off = (pool.mean - center) / divisor
    model = _model(
        spark, "svd", names, m, n, scaling, center, divisor, stage, lam[:k], v[:, :k], lam[: min(n, m)], off,
        pool.cov / np.outer(divisor, divisor),
    )
    beta = betas[k]
    # Squared error and R² of the labelled rows follow from the same moments.
    g = np.concatenate([-beta[1:], [1.0]])
    sse = float(g @ lab.scatter @ g)
    tss = float(lab.scatter[m, m])
    original = beta[1:] @ stage.matrix(m) if stage.linear else beta[1:]
    reg = Regression(
        response=y,
        k=k,
        gamma=tuple(map(float, gammas[k][1:])),
        intercept=float(gammas[k][0]),
        beta=tuple(map(float, original)) if stage.linear else (),
        beta0=float(beta[0]) if stage.linear else 0.0,
        beta_valid=stage.linear,
        rmsec=float(np.sqrt(max(sse, 0.0) / lab.n)),
        r2c=1 - sse / tss if tss > 0 else 0.0,
    )
    return replace(model, regression=reg)


_FOLD_SCHEMA = "repeat int, fold int, k int, n long, se double, see double, sae double, sy double, vy double"


WIDE_CURVE = 40  # component counts whose errors are summed side by side


def _fold_errors(preds: DataFrame, limit: int) -> DataFrame:
    """Error sums of each fold and component count; rows are summed before anything is unfolded."""
    if limit < WIDE_CURVE:
        sums = []
        for k in range(limit + 1):
            y = F.when(F.size("predictions") > k, F.col("_y"))
            e = F.get(F.col("predictions"), F.lit(k)) - y
            parts = {"n": F.count(y), "se": F.sum(e), "see": F.sum(e * e), "sae": F.sum(F.abs(e)), "sy": F.sum(y), "vy": F.var_pop(y)}
            sums.append(F.struct(F.lit(k).alias("k"), *[v.alias(c) for c, v in parts.items()]).alias(f"k{k}"))
        wide = preds.groupBy("repeat", "fold").agg(*sums)
        unfolded = wide.select("repeat", "fold", F.inline(F.array(*[f"k{k}" for k in range(limit + 1)])))
        return unfolded.filter("n > 0")
    e = F.col("p") - F.col("_y")
    long = preds.select("repeat", "fold", "_y", F.posexplode("predictions").alias("k", "p")).withColumn("_e", e)
    return long.groupBy("repeat", "fold", "k").agg(
        F.count("*").alias("n"),
        F.sum("_e").alias("se"),
        F.sum(F.col("_e") * F.col("_e")).alias("see"),
        F.sum(F.abs("_e")).alias("sae"),
        F.sum("_y").alias("sy"),
        F.var_pop("_y").alias("vy"),
    )


def _cross_validate(base, labelled, cells, source, m, cv, limit, scaling, shift):
    """Held-out rows with one prediction per component count."""
    per_fold = cells.filter(F.col("fold") != _SPARE)
    spare = cells.filter(F.col("fold") == _SPARE).filter("repeat = 0").select("i", "j", F.col("v").alias("u"))
    if cv.scheme == "forward":
        # A block trains every later split: give its moments to each of them and add up.
        train = (
            per_fold.withColumn("fold", F.explode(F.sequence(F.col("fold") + 1, F.lit(cv.folds + 1))))
            .filter(F.col("fold") <= cv.folds)
            .groupBy("repeat", "fold", "i", "j").agg(F.sum("v").alias("lab"))
        )
    else:
        total = per_fold.groupBy("repeat", "i", "j").agg(F.sum("v").alias("t"))
        train = per_fold.join(total, ["repeat", "i", "j"]).withColumn("lab", F.col("t") - F.col("v")).drop("t", "v")
    train = train.join(spare, ["i", "j"], "left").withColumn("pool", F.col("lab") + F.coalesce("u", F.lit(0.0)))
    if cv.scheme == "forward" and cv.min_train:
        big = train.filter((F.col("i") == 0) & (F.col("j") == 0) & (F.col("lab") >= cv.min_train)).select("repeat", "fold")
        train = train.join(big, ["repeat", "fold"], "left_semi")
    packed = train.groupBy("repeat", "fold").agg(
        F.collect_list(F.struct("i", "j", "lab", "pool")).alias("cells")  # (m+2)² / 2 entries
    )
    robust = _robust_stages(base, source, m, labelled, cv) if scaling == "robust" else None

    def solve(frames):
        for pdf in frames:
            out = []
            for rep, fold, cells in pdf.itertuples(index=False):
                lab = moments_from(((c["i"], c["j"], c["lab"]) for c in cells), shift)
                pool = moments_from(
                    ((c["i"], c["j"], c["pool"]) for c in cells if c["i"] <= m and c["j"] <= m), shift[:m]
                )
                center, divisor = robust[(rep, fold)] if robust else stage_numbers(pool.mean, pool.sd, scaling)
                betas = score_paths(pool, lab, center, divisor, limit)[0]
                out.append((rep, fold, [list(b) for b in betas]))
            yield pd.DataFrame(out, columns=["repeat", "fold", "betas"])

    solved = packed.mapInPandas(solve, "repeat int, fold int, betas array<array<double>>")
    folds = cv.repeats * (cv.folds or 10**9)
    small = folds * (limit + 1) * (m + 1) <= BROADCAST_CELLS
    held = labelled.join(F.broadcast(solved) if small else solved, ["repeat", "fold"])
    if isinstance(source, str):
        dot = lambda b: F.aggregate(
            F.zip_with(F.col(source), F.slice(b, 2, m), lambda x, w: x * w), F.element_at(b, 1), lambda a, v: a + v
        )
    else:
        def dot(b):
            out = F.element_at(b, 1)
            for i, c in enumerate(source):
                out = out + F.element_at(b, i + 2) * F.col(c)
            return out

    carry = list(dict.fromkeys(cv.order_by))
    return held.select(*carry, "repeat", "fold", "_y", F.transform("betas", dot).alias("predictions"))


def _learned(sizes: dict, keys: Sequence, takes, forward: bool) -> list[int]:
    """Rows that each fold learns from."""
    if forward:
        return [sum(n for o, n in sizes.items() if takes(k, o)) for k in keys]
    total = Counter()
    for (repeat, fold), n in sizes.items():
        total[None if fold == -1 else repeat] += n
    return [total[k[0]] + total[None] - sizes[k] for k in keys]


def _robust_stages(base, source, m, labelled, cv):
    """Median and spread of the rows that each fold learns from, found for all folds in the same scans."""
    spare = base.filter("_y is null").withColumns({c: F.lit(None).cast("int") for c in ("repeat", "fold")})
    df = labelled.unionByName(spare, allowMissingColumns=True)
    forward = cv.scheme == "forward"
    learns = (lambda held, fold: (fold >= 0) & (fold < held)) if forward else (lambda held, fold: fold != held)
    rows = Rows(df, feature_array(df, source), m, folds=("repeat", "fold"), learns=learns)
    rows.df = stored(rows.df, "rows")
    sizes = {(r["repeat"], r["fold"]): r["count"] for r in rows.df.groupBy("repeat", "fold").count().collect()}
    keys = sorted(k for k in sizes if k[1] >= (1 if forward else 0))
    takes = lambda k, other: other[1] == -1 or (other[0] == k[0] and bool(learns(k[1], np.array(other[1]))))
    median, spread = robust_scales(rows, keys, _learned(sizes, keys, takes, forward), not forward)
    discard(rows.df)
    return {k: (c, floor_at_one(MAD_SCALE * d)) for k, c, d in zip(keys, median, spread)}


# --- after the fit -----------------------------------------------------------------------------


def fitted(df: DataFrame, model: PCAModel, keep: Sequence[str] = ()) -> DataFrame:
    """Predicted, measured and residual of the labelled rows."""
    y = model.regression.response
    seen = df.filter(F.col(y).isNotNull()).withColumn("measured", F.col(y).cast("double"))
    out = predict(seen, model, [*keep, "measured"])
    return out.withColumn("residual", F.col("predicted") - F.col("measured"))


def labelled_split(df: DataFrame, y: str) -> DataFrame:
    """Rows with and without a finite response."""
    ok = F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")) & (F.abs(F.col(y).cast("double")) < float("inf"))
    return df.agg(F.count_if(ok).alias("labelled"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("excluded"))


def coefficients(spark: SparkSession, model: PCAModel) -> DataFrame:
    """Intercept and original-scale coefficients, one row per variable."""
    reg = model.regression
    if not reg.beta_valid:
        raise ValueError("row-wise scaling has no coefficients in the units of the data")
    rows = [("intercept", reg.beta0), *zip(model.variables, reg.beta)]
    return spark.createDataFrame([(n, float(b)) for n, b in rows], "variable string, coefficient double")

