"""Gram-based models against numpy brute force on the small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossa.operators import gram as GR
from glossa.operators import ridge as RG
from glossa.plans.q_models import CONTROLS, OUTCOMES, customer_design
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def setup(spark):
    feats, frame, vocab, d, rows = customer_design(spark, SF_SMALL)
    fr = frame.toPandas().set_index("group_id").sort_index()
    names = [n for n in d.names[1:1 + d.p]]
    fp = feats.toPandas().pivot_table(index="group_id", columns="feat", values="group_norm", aggfunc="sum")
    X = fp.reindex(index=fr.index, columns=names).fillna(0.0).to_numpy()
    return d, rows, fr, X


def _ridge_np(X, y, alpha):
    mx, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1.0
    Z = (X - mx) / sd
    b = np.linalg.solve(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean()))
    return y.mean() - (mx / sd) @ b, b / sd


def test_grams_equal_dense(setup):
    d, rows, fr, X = setup
    Z = np.column_stack([np.ones(len(fr)), X, fr[CONTROLS].to_numpy(), fr[OUTCOMES].to_numpy()])
    for k in d.folds:
        m = fr["fold"].to_numpy() == k
        assert np.allclose(d.grams[k], Z[m].T @ Z[m])


def test_ridge_out_of_fold_matches_numpy(spark, setup):
    d, rows, fr, X = setup
    got = RG.cv_predict(d, rows, alpha=10.0).toPandas()
    for o in OUTCOMES:
        y = fr[o].to_numpy()
        want = np.zeros(len(fr))
        for k in d.folds:
            te = fr["fold"].to_numpy() == k
            b0, b = _ridge_np(X[~te], y[~te], 10.0)
            want[te] = b0 + X[te] @ b
        g = got[got.model_id == o].set_index("group_id").reindex(fr.index)["yhat"].to_numpy()
        assert np.allclose(g, want, rtol=1e-6, atol=1e-6)


def test_loo_formula_equals_refits(setup):
    d, rows, fr, X = setup
    tr = fr["fold"].to_numpy() != 0
    Xt, y = X[tr], fr["acctbal"].to_numpy()[tr]
    G = d.total(exclude=0)
    xi = list(range(1, d.p + 1))
    n, m, cxx, cxy, _ = RG._centered(G, xi, d.index("acctbal"))
    for alpha in (0.1, 10.0):
        # closed form of the package
        c = RG.ridge_from_gram(G, xi, d.index("acctbal"), alpha)
        sd = np.sqrt(np.diag(cxx) / n)
        sd[sd == 0] = 1
        Zs = (Xt - m[xi]) / sd
        H = Zs @ np.linalg.solve(Zs.T @ Zs + alpha * np.eye(len(xi)), Zs.T)
        yhat = c[0] + Xt @ c[xi]
        e = (y - yhat) / (1 - 1 / n - np.diag(H))
        # brute force leave-one-out (scaler refit excluded: statistics of the full training set)
        brute = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            Zi = Zs[keep]
            bi = np.linalg.solve(Zi.T @ Zi + alpha * np.eye(len(xi)) - 0 * Zi.T @ Zi, Zi.T @ (y[keep] - y[keep].mean()))
            # centring inside the fold: refit intercept on the kept rows
            zc = Zi.mean(0)
            bi = np.linalg.solve((Zi - zc).T @ (Zi - zc) + alpha * np.eye(len(xi)), (Zi - zc).T @ (y[keep] - y[keep].mean()))
            brute.append(y[i] - (y[keep].mean() + (Zs[i] - zc) @ bi))
        assert np.allclose(e, brute, rtol=1e-6, atol=1e-6)


def test_combo_submatrix_equals_direct_fit(spark, setup):
    d, rows, fr, X = setup
    preds = RG.combo_test(d, rows, alpha=5.0, sizes=[1]).toPandas()
    y = fr["avg_price"].to_numpy()
    C = fr[["n_orders"]].to_numpy()
    want = np.zeros(len(fr))
    for k in d.folds:
        te = fr["fold"].to_numpy() == k
        b0, b = _ridge_np(np.column_stack([C, X])[~te], y[~te], 5.0)
        want[te] = b0 + np.column_stack([C, X])[te] @ b
    g = preds[preds.model_id == "avg_price|n_orders|1"].set_index("group_id").reindex(fr.index)["yhat"].to_numpy()
    assert np.allclose(g, want, rtol=1e-6, atol=1e-6)


def test_residualized_equals_two_stage(spark, setup):
    d, rows, fr, X = setup
    preds = RG.combo_test(d, rows, alpha=5.0, sizes=[1], residualized=True).toPandas()
    y = fr["acctbal"].to_numpy()
    C = fr[["nationkey"]].to_numpy()
    want = np.zeros(len(fr))
    for k in d.folds:
        te = fr["fold"].to_numpy() == k
        c0, cb = _ridge_np(C[~te], y[~te], 5.0)
        r = y[~te] - (c0 + C[~te] @ cb)
        l0, lb = _ridge_np(X[~te], r, 5.0)
        want[te] = c0 + C[te] @ cb + l0 + X[te] @ lb
    g = preds[preds.model_id == "acctbal|nationkey|1"].set_index("group_id").reindex(fr.index)["yhat"].to_numpy()
    assert np.allclose(g, want, rtol=1e-6, atol=1e-6)


def test_ridge_infinite_alpha_is_mean(setup):
    d, rows, fr, X = setup
    G = d.total()
    c = RG.ridge_from_gram(G, list(range(1, d.p + 1)), d.index("acctbal"), 1e12)
    assert abs(c[0] - fr["acctbal"].mean()) < 1e-4


def test_pcr_with_all_components_equals_ridge(spark, setup):
    from glossa.operators.reduce import pcr_ridge_cv
    d, rows, fr, X = setup
    got = pcr_ridge_cv(d, rows, "acctbal", shares=(1.0,)).toPandas()
    for k in d.folds:
        mid = got[got.fold == k]["model_id"].iloc[0]
        alpha = float(mid.split("alpha=")[1])
        c = RG.ridge_from_gram(d.total(exclude=k), list(range(1, d.p + 1)), d.index("acctbal"), alpha)
        te = fr["fold"].to_numpy() == k
        want = c[0] + X[te] @ c[1:1 + d.p]
        g = got[got.fold == k].set_index("group_id").reindex(fr.index[te])["yhat"].to_numpy()
        assert np.allclose(g, want, rtol=1e-6, atol=1e-6)


def test_cca_first_correlation_matches_numpy(spark, setup):
    from glossa.operators.reduce import cca_scores
    d, rows, fr, X = setup
    got = cca_scores(d, rows, n_comp=1, reg=1e-3).toPandas()
    Y = fr[CONTROLS + OUTCOMES].to_numpy()
    Xc, Yc = X - X.mean(0), Y - Y.mean(0)
    sxx, syy, sxy = Xc.T @ Xc / len(X), Yc.T @ Yc / len(Y), Xc.T @ Yc / len(X)

    def isq(s):
        s = s + 1e-3 * np.trace(s) / len(s) * np.eye(len(s))
        w, v = np.linalg.eigh(s)
        return v @ np.diag(1 / np.sqrt(w)) @ v.T
    s = np.linalg.svd(isq(sxx) @ sxy @ isq(syy), compute_uv=False)
    assert abs(got["canon_r"].iloc[0] - s[0]) < 1e-6


def test_adjusted_outcomes_match_numpy(spark, setup):
    d, rows, fr, X = setup
    got = RG.adjust_outcomes(d, rows, "acctbal").toPandas().set_index("group_id").reindex(fr.index)
    y = fr["acctbal"].to_numpy()
    C = np.column_stack([np.ones(len(fr)), fr[CONTROLS].to_numpy()])
    want = np.zeros(len(fr))
    for k in d.folds:
        te = fr["fold"].to_numpy() == k
        b = np.linalg.lstsq(C[~te], y[~te], rcond=None)[0]
        want[te] = y[te] - C[te] @ b + y.mean()
    assert np.allclose(got["adjusted"].to_numpy(), want, rtol=1e-6, atol=1e-6)


def test_multiple_regression_matches_pinv(setup):
    from glossa.operators.reduce import multiple_regression
    d, rows, fr, X = setup
    res = pd.DataFrame(multiple_regression(d), columns=["outcome", "term", "coef", "se", "t"])
    A = np.column_stack([np.ones(len(fr)), X])
    for o in OUTCOMES:
        b = np.linalg.pinv(A.T @ A) @ (A.T @ fr[o].to_numpy())
        got = res[res.outcome == o]["coef"].to_numpy()
        assert np.allclose(got, b, rtol=1e-6, atol=1e-6)


def test_fits_of_folds_overlap_unless_wide(spark, monkeypatch):
    import threading
    import time

    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from glossa.operators import ml
    parts = [spark.range(2).select(array_to_vector(F.array(F.lit(1.0), F.lit(2.0))).alias("features"), F.lit(k).alias("k")) for k in range(3)]
    lock, now, most = threading.Lock(), [0], [0]

    class Slow:
        def copy(self):
            return self

        def fit(self, part):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(1)
            with lock:
                now[0] -= 1
            return part.first()["k"]
    assert ml.fit_together(Slow(), parts) == [0, 1, 2] and most[0] == 3
    most[0] = 0
    monkeypatch.setattr(ml, "COLUMNS", 3)       # one fit of two columns at a time
    assert ml.fit_together(Slow(), parts) == [0, 1, 2] and most[0] == 1
