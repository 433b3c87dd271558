"""Reduction-based models from the fold Grams: principal-component ridge,
canonical correlation, multiple regression with standard errors.

The d x d algebra runs on the driver; every pass over group rows is a
``mapInPandas`` over the design rows with small broadcast matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.ridge import RIDGE_ALPHAS, _centered, _score

# Component shares searched by the principal-component ridge.
PCR_SHARES = (0.01, 0.02154, 0.0464, 0.1, 0.2154, 0.464, 1.0)


def _std_eig(G, xi, yi):
    n, m, cxx, cxy, _ = _centered(G, xi, yi)
    sd = np.sqrt(np.maximum(np.diag(cxx) / n, 0.0))
    sd[sd == 0] = 1.0
    lam, V = np.linalg.eigh(cxx / np.outer(sd, sd))
    order = np.argsort(lam)[::-1]
    lam, V = lam[order], V[:, order]
    return n, m, sd, lam, V, V.T @ (cxy / sd)


def pcr_ridge_cv(design, rows: DataFrame, outcome: str, shares=PCR_SHARES, alphas=RIDGE_ALPHAS) -> DataFrame:
    """Out-of-fold predictions of ridge on the leading principal components;
    per fold the (components, alpha) pair with the least LOO error, scanning
    component counts upward and stopping after two increases."""
    xi = list(range(1, design.p + 1))
    yi = design.index(outcome)
    ks = sorted({max(1, int(round(s * len(xi)))) for s in shares})
    prep = {k: _std_eig(design.total(exclude=k), xi, yi) for k in design.folds}
    bc = rows.sparkSession.sparkContext.broadcast(prep)
    al = np.asarray(alphas, float)

    def run(batches):
        acc = {}
        for pdf in batches:
            z = np.vstack(pdf["z"].to_numpy())
            folds = pdf["fold"].to_numpy()
            for k, (n, m, sd, lam, V, c) in bc.value.items():
                sel = folds != k
                if not sel.any():
                    continue
                u = ((z[sel][:, xi] - m[xi]) / sd) @ V
                y = z[sel][:, yi]
                for a_i, a in enumerate(al):
                    w = 1.0 / (lam + a)
                    h = np.cumsum(u * u * w, axis=1)                  # rows x comps
                    yh = m[yi] + np.cumsum(u * (c * w), axis=1)
                    for kc in ks:
                        e = (y - yh[:, kc - 1]) / (1.0 - 1.0 / n - h[:, kc - 1])
                        acc[(k, kc, a)] = acc.get((k, kc, a), 0.0) + float(e @ e)
        if acc:
            yield pd.DataFrame([(k, kc, a, s) for (k, kc, a), s in acc.items()],
                               columns=["fold", "n_comp", "alpha", "sse"])

    sse = (rows.mapInPandas(run, "fold long, n_comp long, alpha double, sse double")
           .groupBy("fold", "n_comp", "alpha").agg(F.sum("sse").alias("sse")).toPandas())
    recs = []
    for k in design.folds:
        s = sse[sse.fold == k]
        best, rises, prev = None, 0, None
        for kc in ks:
            row = s[s.n_comp == kc].sort_values(["sse", "alpha"]).iloc[0]
            if best is None or row.sse < best.sse:
                best = row
            rises = rises + 1 if (prev is not None and row.sse > prev) else 0
            prev = row.sse
            if rises >= 2:
                break
        n, m, sd, lam, V, c = prep[k]
        kc, a = int(best.n_comp), float(best.alpha)
        bstd = V[:, :kc] @ (c[:kc] / (lam[:kc] + a))
        coef = np.zeros(len(design.names))
        coef[xi] = bstd / sd
        coef[0] = m[yi] - m[xi] @ coef[xi]
        recs.append((f"{outcome}|k={kc}|alpha={a:g}", k, outcome, coef.tolist()))
    models = pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"])
    return _score(rows, models, {outcome: yi})


def cca_scores(design, rows: DataFrame, n_comp: int = 2, reg: float = 1e-3) -> DataFrame:
    """Canonical correlation of X (vocabulary columns) with Y (controls + outcomes)."""
    G = design.total()
    xi = list(range(1, design.p + 1))
    yi = [design.index(c) for c in design.controls + design.outcomes]
    n = G[0, 0]
    m = G[0, :] / n
    cov = G / n - np.outer(m, m)
    sxx, syy, sxy = cov[np.ix_(xi, xi)], cov[np.ix_(yi, yi)], cov[np.ix_(xi, yi)]

    def inv_sqrt(s):
        s = s + reg * np.trace(s) / len(s) * np.eye(len(s))
        w, v = np.linalg.eigh(s)
        return v @ np.diag(1.0 / np.sqrt(np.maximum(w, 1e-300))) @ v.T

    wx, wy = inv_sqrt(sxx), inv_sqrt(syy)
    u, s, vt = np.linalg.svd(wx @ sxy @ wy)
    k = min(n_comp, len(s))
    a, b = wx @ u[:, :k], wy @ vt.T[:, :k]
    bc = rows.sparkSession.sparkContext.broadcast((m, a, b, s[:k]))

    def run(batches):
        mm, aa, bb, ss = bc.value
        for pdf in batches:
            z = np.vstack(pdf["z"].to_numpy())
            su, sv = (z[:, xi] - mm[xi]) @ aa, (z[:, yi] - mm[yi]) @ bb
            g = pdf["group_id"].to_numpy()
            yield pd.DataFrame({"group_id": np.repeat(g, k), "comp": np.tile(np.arange(k), len(g)),
                                "x_score": su.ravel(), "y_score": sv.ravel(),
                                "canon_r": np.tile(ss, len(g))})

    gtype = dict(rows.dtypes)["group_id"]
    return rows.mapInPandas(run, f"group_id {gtype}, comp long, x_score double, y_score double, canon_r double")


def multiple_regression(design) -> list:
    """Least squares of each outcome on [1, features] from the total Gram
    (minimum-norm solution when columns are collinear), with se and t."""
    G = design.total()
    xi = [0] + list(range(1, design.p + 1))
    n = G[0, 0]
    xtx_inv = np.linalg.pinv(G[np.ix_(xi, xi)])
    rank = np.linalg.matrix_rank(G[np.ix_(xi, xi)])
    out = []
    for o in design.outcomes:
        yi = design.index(o)
        xty = G[xi, yi]
        beta = xtx_inv @ xty
        sse = G[yi, yi] - beta @ xty
        sigma2 = sse / max(n - rank, 1)
        se = np.sqrt(np.maximum(np.diag(xtx_inv) * sigma2, 0.0))
        for j, i in enumerate(xi):
            name = "_intercept" if i == 0 else design.names[i]
            out.append((o, name, float(beta[j]), float(se[j]), float(beta[j] / se[j]) if se[j] > 0 else None))
    return out
