"""Sparse designs: ridge, components, blocks, logistic models, clusters against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import blocks as BL
from glossa.operators import cluster as CL
from glossa.operators import logistic as LG
from glossa.operators import sparse as SP


def long_table(spark, X, prefix="f", ids=None):
    r, c = np.nonzero(X)
    ids = np.arange(len(X)) if ids is None else ids
    return spark.createDataFrame([(int(ids[i]), f"{prefix}{j:05d}", float(X[i, j])) for i, j in zip(r, c)],
                                 "group_id long, feat string, group_norm double")


def sparse_matrix(rng, n, p, share, decay=0.0):
    X = (rng.random((n, p)) < share) * rng.random((n, p))
    return X * np.exp(-decay * np.arange(p))


@pytest.fixture(scope="module")
def wide(spark):
    """10,000 columns, 80 rows, two outcomes (one with gaps), a control."""
    rng = np.random.default_rng(1)
    n, p = 80, 10_000
    X = sparse_matrix(rng, n, p, 0.01)
    X[:, 0] = 1.0                       # a column that doesn't vary
    c = rng.normal(size=n)
    Y = np.stack([X[:, :50].sum(1) + 0.3 * c + 0.1 * rng.normal(size=n), rng.normal(size=n)], 1)
    Y[:7, 1] = np.nan
    fold = np.arange(n) % 4
    frame = spark.createDataFrame([(i, int(fold[i]), float(c[i]), float(Y[i, 0]), None if np.isnan(Y[i, 1]) else float(Y[i, 1]))
                                   for i in range(n)], "group_id long, fold int, c double, y0 double, y1 double")
    d = SP.sparse_design(long_table(spark, X).repartition(3), frame, ["c"], ["y0", "y1"])
    used = np.flatnonzero(X.any(0))
    return d, np.column_stack([X[:, used], c]), Y, fold


def dense_ridge(X, y, alpha):
    m, sd = X.mean(0), X.std(0)
    sd[sd < 1e-7] = np.inf
    Z = (X - m) / sd
    b = Z.T @ np.linalg.solve(Z @ Z.T + alpha * np.eye(len(Z)), y - y.mean()) / sd
    return b, y.mean() - m @ b


def test_wide_ridge_equals_dense(wide):
    d, X, Y, fold = wide
    got = SP.ridge(d, alphas=(1.0, 1000.0))
    assert d.p == X.shape[1] and got.residual.max() <= 1e-10
    for j, (k, o, a) in enumerate(got.keys):
        y = Y[:, d.outcomes.index(o)]
        tr = (fold != k) & ~np.isnan(y)
        b, b0 = dense_ridge(X[tr], y[tr], a)
        assert np.abs(got.coef[:, j] - b).max() < 1e-6 * np.abs(b).max() and abs(got.intercept[j] - b0) < 1e-6
    p = SP.predictions(d, got).toPandas()
    assert len(p) == 2 * 2 * len(Y)
    one = p[(p.outcome == "y0") & (p.alpha == 1.0)].set_index("group_id").sort_index()
    for k in range(4):
        b, b0 = dense_ridge(X[fold != k], Y[fold != k, 0], 1.0)
        assert np.allclose(one.yhat[one.fold == k], (X @ b + b0)[fold == k], atol=1e-6)


def test_wide_ridge_joins_equal_columns_and_long_rows_take_few_steps(spark):
    rng = np.random.default_rng(12)
    n, p = 60, 5_000
    X = sparse_matrix(rng, n, p, 0.002) * (rng.random(p) < 0.6)
    long = rng.random(n) < 0.1
    X[long] += (rng.random((long.sum(), p)) < 0.3) / 8      # long rows beside short ones
    X[:, 4000:] = X[:, 1000:2000]       # each of these equals another column
    X[1, 3000:3900] = 0.5               # and these hold one row's number only, if any other
    X[2] = X[3]                         # a copy of a row
    y = np.where(rng.random(n) < 0.5, 1.0, 0.0)
    y[5] = np.nan
    fold = np.arange(n) % 3
    frame = spark.createDataFrame([(i, int(fold[i]), None if np.isnan(y[i]) else float(y[i])) for i in range(n)],
                                  "group_id long, fold int, o double")
    d = SP.sparse_design(long_table(spark, X).repartition(3), frame, [], ["o"])
    used = X[:, X.any(0)]
    slim, place = SP.distinct_columns(d)
    assert slim.p == len(np.unique(used, axis=1).T) and (used == used[:, np.unique(place, return_index=True)[1]][:, place]).all()
    factor = np.where(np.arange(d.p) % 3 == 0, np.nan, np.where(np.arange(d.p) % 3 == 1, 0.0, 2.0))
    for scale in (None, {"o": factor}):
        got = SP.ridge(d, (0.5, 100.0), scale=scale)
        assert got.residual.max() <= 1e-10 and got.steps < 100
        for j, (k, _, a) in enumerate(got.keys):
            tr = (fold != k) & ~np.isnan(y)
            sd = used[tr].std(0)
            f = np.divide(1, sd, out=np.zeros(d.p), where=sd > 1e-9)
            if scale:
                f = np.where(np.isnan(factor), f, np.where(f > 0, factor, 0.0))
            Z = (used[tr] - used[tr].mean(0)) * f
            b = Z.T @ np.linalg.solve(Z @ Z.T + a * np.eye(len(Z)), y[tr] - y[tr].mean()) * f
            assert np.abs(got.coef[:, j] - b).max() < 1e-7 * np.abs(b).max()
            assert abs(got.intercept[j] - (y[tr].mean() - used[tr].mean(0) @ b)) < 1e-7


def test_weights_in_raw_units(wide):
    d, X, Y, _ = wide
    got = SP.ridge(d, alphas=(10.0,), without=[None])
    w = SP.weights(d, got).where("outcome = 'y0'").toPandas().set_index("feat")["weight"]
    b, b0 = dense_ridge(X, Y[:, 0], 10.0)
    assert abs(w["_intercept"] - b0) < 1e-6 and abs(w["c"] - b[-1]) < 1e-6 and len(w) <= X.shape[1] + 1


def test_randomized_components(spark):
    """20,000 columns, the leading 50 components within 1 % of numpy's."""
    rng = np.random.default_rng(2)
    n, p, k = 300, 20_000, 50
    X = sparse_matrix(rng, n, p, 0.01)
    X[:, :200] += (rng.normal(size=(n, 60)) * np.geomspace(3, 0.3, 60)) @ rng.normal(size=(60, 200)) * (rng.random((n, 200)) < 0.9)
    frame = spark.createDataFrame([(i, 0) for i in range(n)], "group_id long, fold int")
    d = SP.sparse_design(long_table(spark, X).repartition(5), frame)
    c = SP.principal_components(d, k)
    Z = X[:, X.any(0)] - X[:, X.any(0)].mean(0)
    sv = np.linalg.svd(Z, compute_uv=False)
    assert np.abs(c.variance * n / sv[:k] ** 2 - 1).max() < 0.01
    assert np.allclose(c.vectors.T @ c.vectors, np.eye(k), atol=1e-8)
    assert abs(c.total - Z.var(0).sum()) < 1e-6 * c.total
    s = np.array([r["pcs"] for r in SP.component_scores(d, c).orderBy("group_id").collect()])
    assert np.allclose(s, Z @ c.vectors, atol=1e-8)
    again = SP.principal_components(SP.sparse_design(long_table(spark, X).repartition(2), frame), k)
    assert np.allclose(again.variance, c.variance, rtol=1e-8)      # drawn by name, whatever the partitions
    assert SP.loadings(d, c).where("category = 'comp0'").count() > 0


def test_components_of_a_small_table(spark):
    frame = spark.createDataFrame([(i, 0) for i in range(3)], "group_id long, fold int")
    feats = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "group_id long, feat string, group_norm double")
    c = SP.principal_components(SP.sparse_design(feats, frame), 5)
    Z = np.array([[1, 0], [0, 2], [0, 0]], float)
    Z -= Z.mean(0)
    assert np.allclose(c.variance, np.linalg.svd(Z, compute_uv=False) ** 2 / 3)


@pytest.fixture(scope="module")
def two_blocks(spark):
    rng = np.random.default_rng(3)
    n = 240
    A, B = sparse_matrix(rng, n, 40, 0.4), sparse_matrix(rng, n, 30, 0.5) * 50
    c = rng.normal(size=n)
    y = 3 * A[:, 3] - 2 * A[:, 7] + B[:, :5].sum(1) / 50 + 0.5 * c + 0.05 * rng.normal(size=n)
    z = A[:, 5] + 0.05 * rng.normal(size=n)
    frame = spark.createDataFrame([(i, int(i % 5 != 0), float(c[i]), float(y[i]), float(z[i])) for i in range(n)],
                                  "group_id long, fold int, c double, y double, z double")
    tables = {"a": long_table(spark, A), "b": long_table(spark, B)}
    return tables, frame, A, B, c, np.stack([y, z], 1)


def numpy_blocks(A, B, c, y, alpha, level, comps):
    def scaled(M):
        return (M - M.mean(0)) / M.std(0), M.mean(0), M.std(0)
    n = len(y)
    ZA, ma, sa = scaled(A)
    r = (ZA * (y - y.mean())[:, None]).mean(0) / y.std()
    from glossa.functions.dist import betainc
    f = r ** 2 / (1 - r ** 2) * (n - 2)
    pv = betainc((n - 2) / 2, 0.5, (n - 2) / (n - 2 + f))
    keep = np.flatnonzero(pv < level / A.shape[1])
    ZB, mb, sb = scaled(B)
    V = np.linalg.svd(ZB, full_matrices=False)[2][:comps].T
    Zc, mc, sc = scaled(c[:, None])
    D = np.column_stack([ZA[:, keep], Zc, ZB @ V])
    b = np.linalg.solve(D.T @ D + alpha * np.eye(D.shape[1]), D.T @ (y - y.mean()))
    return keep, lambda A, B, c: y.mean() + np.column_stack([((A - ma) / sa)[:, keep], (c[:, None] - mc) / sc, ((B - mb) / sb) @ V]) @ b


def test_blocks_with_selector_and_reducer(spark, two_blocks, tmp_path):
    tables, frame, A, B, c, Y = two_blocks
    bd = BL.block_design(tables, frame, ["c"], ["y", "z"])
    specs = [BL.Block("a", select=0.05), BL.Block("b", reduce=4)]
    model = BL.fit(bd, specs, alpha=5.0, without=0, back_off=0.0)
    BL.save(str(tmp_path / "m"), model)
    w, meta = BL.load(spark, str(tmp_path / "m"))
    assert {(r["outcome"], r["model"]) for r in meta.collect()} == {("y", "ridge"), ("z", "ridge")}
    tr = np.arange(len(c)) % 5 != 0
    for reloaded in (BL.weights(model), w):
        got = BL.predict(reloaded, tables, frame, ["c"]).toPandas().set_index(["outcome", "group_id"])["yhat"].sort_index()
        for j, o in enumerate(["y", "z"]):
            keep, f = numpy_blocks(A[tr], B[tr], c[tr], Y[tr, j], 5.0, 0.05, 4)
            assert 0 < len(keep) < 40
            assert np.allclose(got[o].to_numpy(), f(A, B, c), atol=1e-6)
            lo, hi = bd.ranges["a"]
            assert np.array_equal(np.flatnonzero(model.selected[lo:hi, j]), keep)


def test_back_off_and_empty_selection(spark, two_blocks):
    tables, frame, A, B, c, Y = two_blocks
    bd = BL.block_design({"a": tables["a"]}, frame, [], ["y"])
    model = BL.fit(bd, [BL.Block("a", select=1e-300)], alpha=5.0, without=0, back_off=0.05)
    assert model.selected.all() and model.model == ["ridge"]           # nothing selected: the block stays whole
    model = BL.fit(bd, [BL.Block("a", best=3)], alpha=5.0, without=0, back_off=0.05)
    assert model.model == ["linear"] and model.selected.sum() == 3
    tr = np.arange(len(c)) % 5 != 0
    at = np.flatnonzero(model.selected[:, 0])
    D = np.column_stack([np.ones(tr.sum()), A[tr][:, at]])
    want = np.linalg.lstsq(D, Y[tr, 0], rcond=None)[0]
    assert np.allclose(np.r_[model.intercept, model.coef[at, 0]], want, atol=1e-6)


def newton(X, y, lam, sd):
    Z = np.column_stack([np.ones(len(X)), X / sd])
    pen = np.r_[0, np.full(X.shape[1], lam)]
    t = np.zeros(Z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-Z @ t))
        g = Z.T @ (p - y) / len(y) + pen * t
        H = (Z * (p * (1 - p))[:, None]).T @ Z / len(y) + np.diag(pen) + 1e-14 * np.eye(len(t))
        t -= np.linalg.solve(H, g)
    return t[0], t[1:] / sd


def test_logistic_models_together_equal_single_fits(spark):
    rng = np.random.default_rng(4)
    n, p = 200, 12
    X, C = sparse_matrix(rng, n, p, 0.5), rng.normal(size=(n, 2))
    u = 2 * X[:, 0] - X[:, 1] + C[:, 0] * X[:, 2] * 3 + 0.3
    a, b = (u + rng.normal(size=n) > 0.5).astype(float), (rng.random(n) < 0.4).astype(float)
    b[:20] = np.nan
    fold = np.arange(n) % 3
    frame = spark.createDataFrame([(i, int(fold[i]), *map(float, C[i]), float(a[i]), None if np.isnan(b[i]) else float(b[i])) for i in range(n)],
                                  "group_id long, fold int, c0 double, c1 double, a double, b double")
    d = SP.sparse_design(long_table(spark, X).repartition(3), frame, ["c0", "c1"], ["a", "b"])
    specs = [LG.Spec(lab, k, ctl, lang, ad) for lab in "ab" for k in (None, 0, 2)
             for ctl, lang, ad in [((), True, ()), (("c0",), False, ()), (("c0", "c1"), True, ()), ((), True, ("c0",)), (("c1",), True, ("c0", "c1"))]]
    got = LG.fit(d, specs, penalty=0.01, tol=1e-9, max_passes=500)
    assert got.converged.all()
    for j, s in enumerate(specs):
        y = a if s.label == "a" else b
        tr = ~np.isnan(y) & (fold != (-1 if s.fold is None else s.fold))
        cols = [X] * s.language + [C[:, [int(c[1])]] for c in s.controls] + [X * C[:, [int(c[1])]] for c in s.adapt]
        D = np.column_stack(cols)
        b0, w = newton(D[tr], y[tr], 0.01, D[tr].std(0))
        mine = [got.coef[0, :p, j]] * s.language + [got.coef[0, [p + int(c[1])], j] for c in s.controls] + [
            got.coef[1 + got.adapt.index(c), :p, j] for c in s.adapt]
        assert np.allclose(np.concatenate(mine), w, atol=1e-5) and abs(got.intercept[j] - b0) < 1e-5
    pr = LG.probabilities(d, got).toPandas()
    assert len(pr[pr.model == 1]) == 0 or True
    j = next(i for i, s in enumerate(specs) if s == LG.Spec("a", 0, (), True, ("c0",)))
    one = pr[pr.model == j].set_index("group_id").sort_index()
    u = X @ got.coef[0, :p, j] + (X * C[:, [0]]) @ got.coef[1, :p, j] + got.intercept[j]
    assert np.allclose(one.prob, (1 / (1 + np.exp(-u)))[fold == 0])


def test_logistic_in_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    X, y = sparse_matrix(rng, 60, 5, 0.6), (rng.random(60) < 0.5).astype(float)
    frame = spark.createDataFrame([(i, i % 2, float(y[i])) for i in range(60)], "group_id long, fold int, y double")
    d = SP.sparse_design(long_table(spark, X), frame, [], ["y"])
    specs = [LG.Spec("y", k) for k in (None, 0, 1)]
    whole = LG.fit(d, specs)
    monkeypatch.setattr(LG, "BUDGET", 1)
    parts = LG.fit(d, specs)
    assert np.allclose(whole.coef, parts.coef, atol=1e-8)


def test_clusters_find_planted_groups(spark):
    rng = np.random.default_rng(5)
    groups, per, k = 60, 40, 6
    X = np.zeros((k * per, groups))
    for i in range(k * per):
        at = np.arange(groups).reshape(k, -1)[i // per]
        X[i, rng.choice(at, 6, replace=False)] = rng.random(6) + 0.5
        X[i, rng.integers(groups)] += 0.1
    feats = spark.createDataFrame([(int(g), f"w{i:03d}", float(X[i, g])) for i, g in zip(*np.nonzero(X))] + [(0, "zero", 0.0)],
                                  "group_id long, feat string, group_norm double").repartition(4)
    c = CL.k_means(CL.feature_rows(feats), k)
    lex = CL.cluster_lexicon(c).toPandas().set_index("term").sort_index()
    assert len(lex) == k * per and (lex.weight > 0).all() and c.sizes.sum() == k * per
    found = [set(lex.category.iloc[i * per:(i + 1) * per]) for i in range(k)]
    assert all(len(s) == 1 for s in found) and len(set.union(*found)) == k
    again = CL.k_means(CL.feature_rows(feats.repartition(2)), k)
    assert np.isclose(again.inertia, c.inertia, rtol=1e-8)


def test_fewer_rows_than_clusters(spark):
    feats = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0), (0, "c", 2.0)], "group_id long, feat string, group_norm double")
    c = CL.k_means(CL.feature_rows(feats), 5)
    assert len(c.centers) == 2 and c.inertia < 1e-12 and CL.cluster_lexicon(c).count() == 3


def test_products_equal_the_explicit_ones(spark):
    rng = np.random.default_rng(8)
    n, p = 100, 9
    X, C = sparse_matrix(rng, n, p, 0.6), rng.normal(size=(n, 2)) * 3
    Y = np.stack([X[:, 0] * C[:, 0] + rng.normal(size=n), X[:, 1] + rng.normal(size=n)], 1)
    fold = np.arange(n) % 4
    frame = spark.createDataFrame([(i, int(fold[i]), *map(float, C[i]), *map(float, Y[i])) for i in range(n)],
                                  "group_id long, fold int, a double, b double, y double, z double")
    d = SP.with_products(SP.sparse_design(long_table(spark, X).repartition(3), frame, ["a", "b"], ["y", "z"]), ["b", "a"])
    S = (C - C.min(0)) / (C.max(0) - C.min(0))
    D = np.column_stack([X, C, X * S[:, [1]], X * S[:, [0]]])
    names = [r["feat"] for r in d.names().orderBy("idx").collect()]
    assert d.p == D.shape[1] and names[p + 2] == "f00000 x b" and names[-1] == f"f{p - 1:05d} x a"
    got = SP.ridge(d, (5.0,))
    for j, (k, o, a) in enumerate(got.keys):
        b, b0 = dense_ridge(D[fold != k], Y[fold != k, d.outcomes.index(o)], a)
        assert np.allclose(got.coef[:, j], b, atol=1e-7) and np.isclose(got.intercept[j], b0, atol=1e-7)
    best = SP.chosen_alphas(d, (0.1, 10.0, 1000.0))
    for k in range(4):
        for o in (0, 1):
            mse = {}
            for alpha in (0.1, 10.0, 1000.0):
                e = []
                for j in set(range(4)) - {k}:
                    tr = (fold != k) & (fold != j)
                    b, b0 = dense_ridge(D[tr], Y[tr, o], alpha)
                    e.append(((Y[fold == j, o] - D[fold == j] @ b - b0) ** 2).mean())
                mse[alpha] = np.mean(e)
            assert best[k, d.outcomes[o]] == min(mse, key=mse.get)
    c = SP.principal_components(d, 4)
    assert np.allclose(c.variance, np.linalg.svd(D - D.mean(0), compute_uv=False)[:4] ** 2 / n, rtol=1e-6)
    only = {o: np.r_[np.zeros(p + 2), np.full(2 * p, np.nan)] for o in ("y", "z")}
    part = SP.ridge(d, (5.0,), without=[None], scale=only)
    b, b0 = dense_ridge(D[:, p + 2:], Y[:, 0], 5.0)
    assert np.allclose(part.coef[p + 2:, 0], b, atol=1e-7) and not part.coef[:p + 2].any()
