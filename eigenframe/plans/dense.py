"""Driver-side arithmetic on objects whose size is the number of variables, never of rows."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import SparkSession

from eigenframe.plans.gram import Moments

FLAT = 1e-8  # spread below which a column or component counts as flat
RANK = 1e-8  # relative pivot below which a score adds nothing to a regression
NIPALS_STEPS = 1000


def fix_signs(p: np.ndarray) -> np.ndarray:
    """Largest loading of every component positive, the first one on ties."""
    if not p.size:
        return p
    lead = np.abs(p).argmax(axis=0)
    return p * np.where(p[lead, np.arange(p.shape[1])] < 0, -1.0, 1.0)


def top_eigen(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues falling, eigenvectors as columns with fixed signs."""
    w, v = np.linalg.eigh(c)
    return np.maximum(w[::-1], 0.0), fix_signs(v[:, ::-1])


def nipals(g: np.ndarray, sums: np.ndarray, n: float, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The power iterations of NIPALS, written on the Gram matrix of the rows.

    Scores are X·p, so a score difference has squared length d'Gd, and deflating
    the rows turns G into (I - pp')G(I - pp'). Returns λ, loadings, and the sum of
    squares nothing was extracted from.
    """
    g, sums = g.copy(), sums.copy()
    found, lam = [], []
    for _ in range(k):
        spread = np.diag(g) / n - (sums / n) ** 2
        if spread.max() < FLAT:
            break
        old = np.zeros(len(g))
        old[int(spread.argmax())] = 1.0
        for _step in range(NIPALS_STEPS):
            p = g @ old
            p /= np.linalg.norm(p)
            gap = (p - old) @ g @ (p - old)
            old = p
            if np.sqrt(max(gap, 0.0)) < 1e-8:
                break
        else:
            raise RuntimeError(f"component {len(found) + 1}: no convergence in {NIPALS_STEPS} iterations")
        lam.append(p @ g @ p / (n - 1))
        found.append(p)
        q = np.eye(len(g)) - np.outer(p, p)
        g, sums = q @ g @ q, sums - (sums @ p) * p
    loadings = np.array(found).T if found else np.zeros((len(g), 0))
    return np.array(lam), loadings, float(np.trace(g))


def score_paths(pool: Moments, labelled: Moments, center: np.ndarray, divisor: np.ndarray, k_max: int):
    """Regression on 0…k components from moments alone.

    ``pool`` describes the rows the components come from, ``labelled`` the rows
    ``[x…, y]`` with a response; ``center`` and ``divisor`` are the column stage.
    Returns original-scale coefficients (one row per component count, intercept
    first), score-space coefficients, loadings and λ. Fewer rows than k_max + 1
    come back when the labelled rows cannot support more components.
    """
    m = len(pool.mean)
    off = (pool.mean - center) / divisor
    around = pool.cov / np.outer(divisor, divisor) + np.outer(off, off) * pool.n / max(pool.n - 1, 1)
    lam, v = top_eigen(around)
    k_max = min(k_max, m, int((lam > 1e-12 * max(lam[0], 1e-300)).sum()))
    p = v[:, :k_max] / divisor[:, None]
    sxx, sxy = labelled.scatter[:m, :m], labelled.scatter[:m, m]
    stt, sty = p.T @ sxx @ p, p.T @ sxy
    tbar, ybar = p.T @ (labelled.mean[:m] - center), labelled.mean[m]
    gammas = nested_fits(stt, sty, tbar, ybar, k_max)
    betas = []
    for k, g in enumerate(gammas):
        beta = p[:, :k] @ g[1:]
        betas.append(np.concatenate([[g[0] - beta @ center], beta]))
    return np.array(betas), gammas, v[:, : len(betas) - 1], lam


def nested_fits(stt: np.ndarray, sty: np.ndarray, tbar: np.ndarray, ybar: float, k_max: int) -> list[np.ndarray]:
    """Least squares on the first 0…k_max scores from their moments, intercept first; stops at dependence."""
    out = []
    for k in range(k_max + 1):
        if k and not _adds(stt, k):
            break
        gamma = np.linalg.solve(stt[:k, :k], sty[:k]) if k else np.zeros(0)
        out.append(np.concatenate([[ybar - gamma @ tbar[:k]], gamma]))
    return out


def _adds(stt: np.ndarray, k: int) -> bool:
    """Whether score k is linearly independent of the earlier ones over the labelled rows."""
    if stt[k - 1, k - 1] <= 0:
        return False
    if k == 1:
        return True
    lead, cross = stt[: k - 1, : k - 1], stt[: k - 1, k - 1]
    rest = stt[k - 1, k - 1] - cross @ np.linalg.solve(lead, cross)
    return bool(rest > RANK * stt[k - 1, k - 1])


def floor_at_one(sd: np.ndarray) -> np.ndarray:
    """Flat columns are left alone instead of divided by almost nothing."""
    return np.where(sd < FLAT, 1.0, sd)


def smoothing_matrix(m: int, window: int, order: int, deriv: int = 0) -> np.ndarray:
    """Savitzky & Golay (1964) as an m×m matrix: row i gives output i.

    Inside, the least-squares polynomial of the window around i is evaluated at
    its middle; at the edges, the polynomial of the first or last full window.
    """
    if window % 2 == 0 or window < 3:
        raise ValueError("window must be odd and at least 3")
    if not 0 <= deriv <= order < window:
        raise ValueError("need 0 <= deriv <= order < window")
    if m < window:
        raise ValueError(f"{m} values are fewer than the window of {window}")
    half = window // 2
    u = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(u / half, order + 1, increasing=True))
    powers = np.arange(order + 1)
    # d-th derivative of (u/half)^q at position u
    falling = np.array([np.prod(np.arange(q - deriv + 1, q + 1)) if q >= deriv else 0.0 for q in powers])
    out = np.zeros((m, m))
    for i in range(m):
        start = min(max(i - half, 0), m - window)
        at = (i - start - half) / half
        basis = np.where(powers >= deriv, falling * np.power(at, np.maximum(powers - deriv, 0)), 0.0)
        out[i, start : start + window] = basis @ fit / half**deriv
    return out


def f_quantile(spark: SparkSession, level: float, d1: int, d2: int) -> float:
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    return float(dist.inverseCumulativeProbability(float(level)))


def t_two_sided(spark: SparkSession, t: float, df: int) -> float:
    """Probability that |T| exceeds |t|."""
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    return float(2 * (1 - dist.cumulativeProbability(abs(float(t)))))


def t2_limit(spark: SparkSession, level: float, n: int, k: int) -> float:
    """k(n-1)/(n-k)·F; 0 means no limit can be given."""
    return k * (n - 1) / (n - k) * f_quantile(spark, level, k, n - k) if n > k > 0 else 0.0


def q_limit(level: float, rest: np.ndarray) -> float:
    """Jackson & Mudholkar (1979) from the eigenvalues not retained; 0 if none are left."""
    return q_limit_of_sums(level, [float(np.sum(rest**i)) for i in (1, 2, 3)])


def q_limit_of_sums(level: float, th: list[float]) -> float:
    """The same from the sums of those eigenvalues, of their squares and of their cubes."""
    if th[0] <= 1e-12 or th[1] <= 0:
        return 0.0
    h0 = 1 - 2 * th[0] * th[2] / (3 * th[1] ** 2)
    if h0 == 0:
        return 0.0
    z = NormalDist().inv_cdf(level)
    core = z * np.sqrt(2 * th[1] * h0**2) / th[0] + 1 + th[1] * h0 * (h0 - 1) / th[0] ** 2
    return float(th[0] * core ** (1 / h0)) if core > 0 else 0.0
