"""Lasso and elastic net with the penalty chosen by nested folds, from the fold Grams.

The objective is ``sum(e^2) / (2 n) + alpha (ratio |b|_1 + (1 - ratio) |b|_2^2 / 2)``
on columns standardized with the outer training rows.  For an outcome and an outer
fold the grid of each ratio falls from the least alpha without a non-zero coefficient
to ``eps`` times it, evenly on a log scale.  Paths are fitted without the outer
and one inner fold each; the (ratio, alpha) with the least mean of the inner
folds' mean squared errors is fitted once more without the outer fold alone
(ties: the first in the order of ratios, then the larger alpha).

Training statistics are sums of fold Grams and a test fold's squared error is a quadratic
form in its own Gram, so no pass over the rows is needed.  Each path is a Spark task
(outcome, outer fold, inner fold): coordinate descent on covariance updates, warm
started along the grid, over the features that the strong rule (Tibshirani
et al., 2012) leaves; those that break the optimality conditions afterwards are taken in
and the point is solved again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.ridge import _score

# Numbers of alphas and the L1 shares searched.
LASSO_ALPHAS, NET_ALPHAS = 12, 100
NET_RATIOS = (1.0, 0.99, 0.975, 0.95, 0.9, 0.75, 0.5, 0.1, 0.05, 0.025, 0.01)
EPS = 1e-3


def standardized(G: np.ndarray, xi: list, yi: int, scale: np.ndarray | None = None) -> tuple:
    """(n, mean, sd, C = X'X / n, c = X'y / n, var y) of the centred columns divided by
    ``scale`` (their own sd if none; constant columns stay 0)."""
    n = G[0, 0]
    m = G[0, :] / n
    cxx = G[np.ix_(xi, xi)] / n - np.outer(m[xi], m[xi])
    second = np.diag(G)[xi] / n
    sd = np.sqrt(np.maximum(np.diag(cxx), 0))
    sd[np.diag(cxx) <= 1e-13 * np.maximum(second, 1e-300)] = 0
    sd = sd if scale is None else scale
    inv = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    c = (G[xi, yi] / n - m[xi] * m[yi]) * inv
    return n, m, sd, cxx * np.outer(inv, inv), c, G[yi, yi] / n - m[yi] ** 2


def grids(c: np.ndarray, ratios, count: int, eps: float = EPS) -> np.ndarray:
    """ratios x count alphas, falling."""
    top = np.abs(c).max() if len(c) else 0.0
    top = max(top, 1e-12)
    return np.array([np.geomspace(top / r, top / r * eps, count) for r in ratios])


def _jump(C: np.ndarray, c: np.ndarray, b: np.ndarray, g: np.ndarray, l1: float, l2: float) -> None:
    """Moves to the solution for the present signs if it has the same ones (features that move together
    make coordinate steps slow); the sweeps that follow test it."""
    at = np.flatnonzero(b)
    if not len(at):
        return
    sign = np.sign(b[at])
    try:
        new = np.linalg.solve(C[np.ix_(at, at)] + l2 * np.eye(len(at)), c[at] - l1 * sign)
    except np.linalg.LinAlgError:
        return
    if (np.sign(new) == sign).all():
        g -= C[:, at] @ (new - b[at])
        b[at] = new


def paths(C: np.ndarray, c: np.ndarray, yy: float, ratios, alphas: np.ndarray, tol: float = 1e-8,
          max_sweeps: int = 5000) -> np.ndarray:
    """Coefficients (ratios x alphas x p) of all ratios' paths, solved side by side."""
    k, p = len(alphas), len(c)
    ratio = np.asarray(ratios, float)[:, None]
    out = np.zeros((k, alphas.shape[1], p))
    b = np.zeros((k, p))
    g = np.tile(c, (k, 1))              # gradient c - C b
    diag = np.diag(C).copy()
    limit = tol * np.sqrt(max(yy, 1e-300))
    for t in range(alphas.shape[1]):
        l1 = ratio[:, 0] * alphas[:, t]
        l2 = (1 - ratio[:, 0]) * alphas[:, t]
        before = ratio[:, 0] * alphas[:, t - 1] if t else np.full(k, np.inf)
        strong = np.abs(g) >= (np.where(t > 0, 2 * l1 - before, l1))[:, None]
        inside = (strong | (b != 0)).any(0) & (diag > 0)
        while True:
            at = np.flatnonzero(inside)
            for sweep in range(1, max_sweeps + 1):
                most = 0.0
                for j in at:
                    z = g[:, j] + diag[j] * b[:, j]
                    new = np.sign(z) * np.maximum(np.abs(z) - l1, 0) / (diag[j] + l2)
                    d = new - b[:, j]
                    if d.any():
                        g -= d[:, None] * C[j]
                        b[:, j] = new
                        most = max(most, np.abs(d).max() * np.sqrt(diag[j]))
                if most <= limit:
                    break
                if sweep % 10 == 0:
                    for i in range(k):
                        _jump(C, c, b[i], g[i], l1[i], l2[i])
            broken = (np.abs(g) > l1[:, None] * (1 + 1e-9) + 1e-12).any(0) & ~inside & (diag > 0)
            if not broken.any():
                break
            inside |= broken
        out[:, t] = b
    return out


def _raw(m: np.ndarray, sd: np.ndarray, xi: list, yi: int, b: np.ndarray, d: int) -> np.ndarray:
    """Coefficients over all columns of Z (index 0: intercept) of standardized ones, last axis."""
    out = np.zeros((*b.shape[:-1], d))
    out[..., xi] = b * np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    out[..., 0] = m[yi] - out[..., xi] @ m[xi]
    return out


def _total(grams: dict, without) -> np.ndarray:
    return sum(g for f, g in grams.items() if f not in without)


def path_errors(grams: dict, xi: list, yi: int, outer: int, inner: int, ratios, count: int, eps: float = EPS) -> tuple:
    """(alphas, mean squared errors on the inner fold), both ratios x count."""
    _, _, sd, _, c, _ = standardized(_total(grams, {outer}), xi, yi)
    alphas = grids(c, ratios, count, eps)
    G = _total(grams, {outer, inner})
    _, m, _, C, c, yy = standardized(G, xi, yi, sd)
    w = _raw(m, sd, xi, yi, paths(C, c, yy, ratios, alphas), len(G))
    w[..., yi] = -1.0                   # the error is w z
    T = grams[inner]
    return alphas, np.einsum("rai,ij,raj->ra", w, T, w, optimize=True) / T[0, 0]


def refit(grams: dict, xi: list, yi: int, outer: int | None, ratio: float, place: int, count: int, eps: float = EPS) -> np.ndarray:
    """Coefficients at one point of a ratio's path without the outer fold."""
    G = _total(grams, {outer})
    _, m, sd, C, c, yy = standardized(G, xi, yi)
    alphas = grids(c, [ratio], count, eps)[:, :place + 1]
    return _raw(m, sd, xi, yi, paths(C, c, yy, [ratio], alphas)[0, -1], len(G))


def choose(spark: SparkSession, design, outcomes=None, ratios=(1.0,), count: int = LASSO_ALPHAS, eps: float = EPS,
           xi=None) -> pd.DataFrame:
    """(outcome, fold, ratio, alpha, place, mse): the chosen point for each outcome and outer fold."""
    xi = list(range(1, design.p + 1)) if xi is None else list(xi)
    work = [(o, k, j) for o in (outcomes or design.outcomes) for k in design.folds for j in design.folds if j != k]
    bc = spark.sparkContext.broadcast((design.grams, {o: design.index(o) for o in design.outcomes}))   # folds x d x d, d bounded

    def run(batches):
        grams, at = bc.value
        for pdf in batches:
            for o, k, j in pdf.itertuples(index=False):
                a, e = path_errors(grams, xi, at[o], k, j, ratios, count, eps)
                n = a.size
                yield pd.DataFrame({"outcome": o, "fold": k, "place": np.tile(np.arange(count), len(ratios)),
                                    "ratio": np.repeat(np.asarray(ratios, float), count), "alpha": a.ravel(), "mse": e.ravel()},
                                   index=range(n))
    todo = spark.createDataFrame(work, "outcome string, fold int, inner int").repartition(len(work))
    points = todo.mapInPandas(run, "outcome string, fold int, place int, ratio double, alpha double, mse double")
    means = points.groupBy("outcome", "fold", "ratio", "place").agg(F.first("alpha").alias("alpha"), F.avg("mse").alias("mse"))
    best = means.groupBy("outcome", "fold").agg(F.min(F.struct("mse", (-F.col("ratio")).alias("r"), "place", "ratio", "alpha")).alias("b"))
    return best.select("outcome", "fold", "b.ratio", "b.alpha", "b.place", "b.mse").toPandas()


def cv_predict(design, rows: DataFrame, outcomes=None, ratios=(1.0,), count: int = LASSO_ALPHAS, eps: float = EPS, xi=None) -> tuple:
    """(out-of-fold predictions (group_id, fold, model_id = outcome, y, yhat), the chosen points with
    their coefficients)."""
    spark = rows.sparkSession
    xi = list(range(1, design.p + 1)) if xi is None else list(xi)
    best = choose(spark, design, outcomes, ratios, count, eps, xi)
    bc = spark.sparkContext.broadcast((design.grams, {o: design.index(o) for o in design.outcomes}))

    def run(batches):
        grams, at = bc.value
        for pdf in batches:
            coef = [refit(grams, xi, at[r.outcome], r.fold, r.ratio, r.place, count, eps).tolist() for r in pdf.itertuples()]
            yield pdf.assign(coef=coef, model_id=pdf["outcome"])
    todo = spark.createDataFrame(best).repartition(max(1, len(best)))
    models = todo.mapInPandas(run, "outcome string, fold int, ratio double, alpha double, place int, mse double, coef array<double>, model_id string").toPandas()
    return _score(rows, models[["model_id", "fold", "outcome", "coef"]], {o: design.index(o) for o in design.outcomes}), models
