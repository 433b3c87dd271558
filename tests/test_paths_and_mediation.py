"""Lasso paths, mediation, Hommel's correction and penalized CCA against numpy."""

import numpy as np
import pytest

from glossa.operators import gram as GR
from glossa.operators import lasso as LS
from glossa.operators import mediation as MD
from glossa.operators import sparse as SP
from glossa.operators import sparse_cca as SC
from glossa.operators.padjust import hommel_from_hull, lower_hull, p_adjust
from tests.test_sparse_models import long_table, sparse_matrix

# --- lasso and elastic net ---------------------------------------------------


def slow_net(Z, y, alpha, ratio, b=None, sweeps=20_000):
    """Plain coordinate descent on the rows."""
    n, p = Z.shape
    b = np.zeros(p) if b is None else b.copy()
    e = y - Z @ b
    s = (Z ** 2).sum(0) / n
    for _ in range(sweeps):
        most = 0.0
        for j in range(p):
            if s[j] == 0:
                continue
            z = Z[:, j] @ e / n + s[j] * b[j]
            new = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (s[j] + alpha * (1 - ratio))
            if new != b[j]:
                e -= Z[:, j] * (new - b[j])
                most = max(most, abs(new - b[j]))
                b[j] = new
        if most < 1e-11:
            break
    return b


def slow_choice(X, y, fold, outer, ratios, count):
    tr = fold != outer
    m, sd = X[tr].mean(0), X[tr].std(0)
    sd[sd == 0] = np.inf
    Z = (X - m) / sd
    top = np.abs(Z[tr].T @ (y[tr] - y[tr].mean())).max() / tr.sum()
    best = None
    for r in ratios:
        grid = np.geomspace(top / r, top / r * LS.EPS, count)
        errors = []
        for inner in sorted(set(fold) - {outer}):
            a, t = tr & (fold != inner), fold == inner
            zm, ym = Z[a].mean(0), y[a].mean()
            b, row = None, []
            for alpha in grid:
                b = slow_net(Z[a] - zm, y[a] - ym, alpha, r, b)
                row.append((((y[t] - ym) - (Z[t] - zm) @ b) ** 2).mean())
            errors.append(row)
        mse = np.mean(errors, 0)
        k = int(mse.argmin())
        if best is None or mse[k] < best[0] - 1e-12:
            best = (mse[k], r, grid[k], slow_net(Z[tr] - Z[tr].mean(0), y[tr] - y[tr].mean(), grid[k], r) / sd)
    return best


def test_path_equals_rows(spark):
    rng = np.random.default_rng(1)
    n, p = 120, 15
    X = sparse_matrix(rng, n, p, 0.6)
    X[:, 14] = 0.5                      # constant
    X[:, 13] = X[:, 12] + 0.01 * X[:, 11]
    Y = np.stack([2 * X[:, 0] - X[:, 3] + 0.3 * rng.normal(size=n), X[:, 5] + rng.normal(size=n)], 1)
    fold = np.arange(n) % 4
    frame = spark.createDataFrame([(i, int(fold[i]), float(Y[i, 0]), float(Y[i, 1])) for i in range(n)], "group_id long, fold int, y0 double, y1 double")
    feats = long_table(spark, X)
    vocab, d = GR.build_design(feats, frame, [], ["y0", "y1"])
    rows = GR.design_rows(feats, vocab, frame, [], ["y0", "y1"])
    for ratios in ((1.0,), (1.0, 0.5, 0.1)):
        pred, chosen = LS.cv_predict(d, rows, ratios=ratios, count=8)
        got = pred.toPandas().set_index(["model_id", "group_id"])["yhat"]
        for j, o in enumerate(["y0", "y1"]):
            for k in range(4):
                mse, r, a, b = slow_choice(X, Y[:, j], fold, k, ratios, 8)
                c = chosen[(chosen.outcome == o) & (chosen.fold == k)].iloc[0]
                assert np.isclose(c.ratio, r) and np.isclose(c.alpha, a) and np.isclose(c.mse, mse, rtol=1e-6)
                assert np.allclose(np.array(c.coef)[1:1 + p], b, atol=1e-6)
                b0 = Y[fold != k, j].mean() - X[fold != k].mean(0) @ b
                want = X[fold == k] @ b + b0
                assert np.allclose(got[o].loc[np.flatnonzero(fold == k)], want, atol=1e-6)


def test_strong_rule_leaves_nothing_out():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 40)) @ (np.eye(40) + 0.05)
    y = X[:, 0] - X[:, 1] + rng.normal(size=60)
    X, y = X - X.mean(0), y - y.mean()
    C, c = X.T @ X / 60, X.T @ y / 60
    grid = LS.grids(c, [1.0, 0.3], 20)
    b = LS.paths(C, c, y @ y / 60, [1.0, 0.3], grid)
    for i, r in enumerate([1.0, 0.3]):
        for t in range(20):
            g = c - C @ b[i, t] - grid[i, t] * (1 - r) * b[i, t]
            assert (np.abs(g) <= grid[i, t] * r * (1 + 1e-4) + 1e-9).all()
            on = b[i, t] != 0
            assert np.allclose(g[on], grid[i, t] * r * np.sign(b[i, t][on]), rtol=1e-3, atol=1e-7)


# --- mediation ---------------------------------------------------------------

def ols(y, cols, w=None):
    D = np.column_stack([np.ones(len(y)), *cols])
    W = np.ones(len(y)) if w is None else w
    A = D.T @ (D * W[:, None])
    b = np.linalg.solve(A, D.T @ (W * y))
    e = y - D @ b
    return b[1:], np.sqrt(np.diag(np.linalg.inv(A))[1:] * (W * e ** 2).sum() / (W.sum() - D.shape[1]))


@pytest.fixture(scope="module")
def mediated(spark):
    rng = np.random.default_rng(3)
    n = 150
    x, c, c2 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    X = sparse_matrix(rng, n, 4, 0.7)
    X[:, 1] = np.maximum(0, 0.8 * x + 0.3 * c + 0.3 * rng.normal(size=n))
    m2 = x + 0.2 * rng.normal(size=n)
    y = 1.5 * X[:, 1] + 0.5 * x + 0.4 * c + 0.3 * rng.normal(size=n)
    data = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, y, c, c2, m2))] + [(n, None, None, None, None, None)],
                                 "group_id long, x double, y double, c double, c2 double, m2 double").repartition(3)
    return data, long_table(spark, X), {"x": x, "y": y, "c": c, "c2": c2, "m2": m2}, X


FEAT = MD.FEATURE
CASES = [("x", FEAT, "y", []), ("x", FEAT, "y", ["c", "c2"]), (FEAT, "m2", "y", ["c"]), ("x", "m2", FEAT, ["c"]), ("x", "m2", "y", ["c", FEAT]), ("x", "m2", "y", ["c"])]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("limit", [200_000, 40])
def test_paths_boot(mediated, monkeypatch, case, limit):
    monkeypatch.setattr(MD, "LIMIT", limit)
    data, feats, cols, X = mediated
    start, med, out, ctl = case
    uses = FEAT in [start, med, out, *ctl]
    got = {r["feat"]: r for r in MD.mediation(data, start, med, out, feats if uses else None, ctl, method="boot", reps=40, seed=5).collect()}
    import xxhash
    keys = np.array([xxhash.xxh64_intdigest(str(i).encode(), seed=42) for i in range(len(X))], np.uint64)
    W = MD.poisson_weights(keys, 40, 5)
    assert set(got) == ({f"f{j:05d}" for j in range(4)} if uses else {None})
    for name, r in got.items():
        f = X[:, int(name[1:])] if name else None
        v = lambda k: f if k == FEAT else cols[k]
        C = [v(k) for k in ctl]
        (a, *_), (sa, *_) = ols(v(med), [v(start), *C])
        (d, b, *_), (sd, sb, *_) = ols(v(out), [v(start), v(med), *C])
        (c, *_), (sc, *_) = ols(v(out), [v(start), *C])
        want = {"a": a, "se_a": sa, "b": b, "se_b": sb, "c": c, "se_c": sc, "c_prime": d, "se_c_prime": sd, "indirect": a * b,
                "sobel_z": a * b / np.sqrt(b * b * sa * sa + a * a * sb * sb)}
        assert r["n"] == 150 and all(np.isclose(r[k], x, rtol=1e-6, atol=1e-9) for k, x in want.items())
        ab = np.array([ols(v(med), [v(start), *C], w)[0][0] * ols(v(out), [v(start), v(med), *C], w)[0][1] for w in W.T[1:]])
        assert np.allclose([r["acme_mean"], r["acme_lo"], r["acme_hi"]], [ab.mean(), *np.percentile(ab, [2.5, 97.5])], rtol=1e-6, atol=1e-9)
        assert r["reps"] == 40 and np.isclose(r["acme_p"], 2 * min((ab > 0).mean(), (ab < 0).mean()))


def test_parametric_draws(mediated):
    data, feats, cols, X = mediated
    got = {r["feat"]: r for r in MD.mediation(data, "x", FEAT, "y", feats, ["c"], reps=20_000).collect()}
    r = got["f00001"]
    assert abs(r["acme_mean"] - r["indirect"]) < 0.02 and r["acme_p"] < 0.001 and r["acme_lo"] > 0.5 * r["indirect"]
    assert abs(r["ade_mean"] - r["c_prime"]) < 0.01 and abs(r["total_mean"] - r["c"]) < 0.02
    assert abs((r["ade_hi"] - r["ade_lo"]) / (2 * 1.96 * r["se_c_prime"]) - 1) < 0.05
    again = {x["feat"]: x for x in MD.mediation(data.repartition(2), "x", FEAT, "y", feats, ["c"], reps=20_000).collect()}
    assert np.isclose(again["f00000"]["acme_lo"], got["f00000"]["acme_lo"], rtol=1e-6)


def test_effects_that_do_not_exist(spark):
    data = spark.createDataFrame([(i, float(i), float(i % 3), 2.0 * i) for i in range(12)], "group_id long, x double, y double, same double")
    r = MD.mediation(data, "x", "same", "y").first()
    assert r["b"] is None and r["acme_mean"] is None and r["a"] is not None
    with pytest.raises(ValueError):
        MD.mediation(data, "x", FEAT, "y")


def test_weights_are_poisson():
    w = MD.poisson_weights(np.arange(2000, dtype=np.uint64), 200, 3)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02


# --- Hommel ------------------------------------------------------------------

def hommel_by_definition(p):
    """The largest corrected value that some intersection of tests gives (Simes), quadratic form."""
    n, o = len(p), np.argsort(p, kind="stable")
    s = p[o]
    q = np.full(n, (n * s / np.arange(1, n + 1)).min())
    best = q.copy()
    for m in range(n - 1, 1, -1):
        tail = (m * s[n - m + 1:] / np.arange(2, m + 1)).min()
        q = np.r_[np.minimum(m * s[:n - m + 1], tail), np.empty(m - 1)]
        q[n - m + 1:] = q[n - m]
        best = np.maximum(best, q)
    out = np.empty(n)
    out[o] = np.minimum(np.maximum(best, s), 1)
    return out


def test_hommel(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        p = rng.random(rng.integers(1, 50)) ** rng.choice([1, 4])
        p = np.round(p, 1) if rng.random() < 0.3 else p
        s, x = np.sort(p), np.arange(1.0, len(p) + 1)
        h = lower_hull(x, s)
        assert np.allclose(hommel_from_hull(p, float(len(p)), x[h], s[h]), hommel_by_definition(p), atol=1e-12)
    ps = {"a": np.round(rng.random(500) ** 2, 3), "b": rng.random(40) ** 5}
    rows = [(o, f"f{i}", float(v)) for o, v in ps.items() for i, v in enumerate(v)] + [("a", "null", None), ("c", "null", None), ("d", "one", 0.3)]
    got = p_adjust(spark.createDataFrame(rows, "outcome string, feat string, p double").repartition(6), "hommel").toPandas()
    for o, p in ps.items():
        g = got[(got.outcome == o) & got.p.notna()]
        assert np.allclose(g.p_adj, hommel_by_definition(g.p.to_numpy()), atol=1e-12)
    assert got[got.feat == "null"].p_adj.isna().all() and np.isclose(got[got.outcome == "d"].p_adj.iloc[0], 0.3)


# --- penalized CCA -----------------------------------------------------------

def test_permutations_are_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        seen = [tuple(SC.permuted_places(np.arange(n), n, k)) for k in range(5)]
        assert all(sorted(s) == list(range(n)) for s in seen) and (n < 17 or len(set(seen)) == 5)


def cca_design(spark, X, Y):
    names = [f"y{j}" for j in range(Y.shape[1])]
    frame = spark.createDataFrame([(i, 0, *map(float, Y[i])) for i in range(len(Y))] + [(len(Y), 0, *[None] * Y.shape[1])],
                                  "group_id long, fold int, " + ", ".join(f"{n} double" for n in names))
    return SP.sparse_design(long_table(spark, X), frame, [], names)


def test_planted_pair_is_found(spark):
    rng = np.random.default_rng(5)
    n, p, q = 200, 60, 5
    X, Y = sparse_matrix(rng, n, p, 0.6), rng.normal(size=(n, q))
    Y[:, 2] += 6 * X[:, [4, 9, 11]].sum(1)
    d = cca_design(spark, X, Y)
    pairs = SC.penalized_cca(d, components=2, penalty_x=0.25, penalty_y=0.5)
    assert set(np.argsort(-np.abs(pairs.u[:, 0]))[:3]) == {4, 9, 11} and np.argmax(np.abs(pairs.v[:, 0])) == 2
    assert (pairs.u[:, 0] == 0).sum() > 30 and np.abs(pairs.u[:, 0]).sum() <= 0.25 * np.sqrt(p) + 1e-6
    Zx, Zy = (X - X.mean(0)) / X.std(0), (Y - Y.mean(0)) / Y.std(0)
    for k in range(2):
        assert np.isclose(pairs.correlation[k], np.corrcoef(Zx @ pairs.u[:, k], Zy @ pairs.v[:, k])[0, 1], atol=1e-8)
    w = SC.pair_weights(d, pairs).toPandas()
    assert set(w.side) == {"feature", "column"} and "f00009" in set(w.name)
    table = SC.permutation_table(d, penalties=(0.25,), perms=30)
    assert table[0][-1] < 0.05 and table[0][4] > 3


def test_no_bound_gives_the_singular_vectors():
    K = np.random.default_rng(6).normal(size=(8, 4))
    u, v, d = SC.decompose(K, np.sqrt(8), 2.0, 3)
    assert np.allclose(d, np.linalg.svd(K)[1][:3], rtol=1e-6)


def test_p_under_the_null(spark):
    rng = np.random.default_rng(7)
    ps = []
    for _ in range(8):
        d = cca_design(spark, sparse_matrix(rng, 60, 10, 0.6), rng.normal(size=(60, 2)))
        ps.append(SC.permutation_table(d, penalties=(0.5,), perms=19)[0][-1])
    assert 0.15 < np.mean(ps) < 0.85 and min(ps) >= 0.05


def test_permuted_columns_are_sent_without_a_broadcast(spark):
    for n in (1, 2, 7, 64, 1000):
        for k in (0, 5):
            there = SC.permuted_places(np.arange(n), n, k)
            assert (SC.permuted_places(there, n, k, back=True) == np.arange(n)).all()
    n, perms, seed = 60, 20, 3
    ranked = spark.createDataFrame([(i, 0, [0], [1.0], [float(i), float(-i)], i + 1) for i in range(n)],
                                   "group_id long, fold int, idx array<int>, val array<double>, y array<double>, _i long").repartition(3)
    d = SC._dealt(ranked, n, perms, seed)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    for r in d.collect():
        want = [r["group_id"], *[int(SC.permuted_places(np.array([r["group_id"]]), n, seed * 1_000_003 + k)[0]) for k in range(perms)]]
        assert r["y"] == [float(v) for j in want for v in (j, -j)]
