"""Panels without leaks, sinks and the bootstrap of AUC against plain computations."""

import numpy as np
import pytest

from glossa.operators import stats_models as SM
from glossa.operators.mediation import poisson_weights
from glossa.plans import q_models as QM
from glossa.plans import q_panels as QP
from tests.test_sparse_models import long_table, sparse_matrix


def std_ridge(X, y, alpha):
    m, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1.0
    Z = (X - m) / sd
    b = np.linalg.lstsq(Z.T @ Z + alpha * np.eye(X.shape[1]), Z.T @ (y - y.mean()), rcond=None)[0] / sd
    return lambda A: A @ b + y.mean() - m @ b


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    n = 90
    A, B, C = sparse_matrix(rng, n, 12, 0.6), sparse_matrix(rng, n, 9, 0.6), rng.normal(size=(n, 2))
    y = A[:, 0] + C[:, 0] + B[:, 1] + 0.3 * rng.normal(size=n)
    fold = np.arange(n) % 3
    frame = spark.createDataFrame([(i, int(fold[i]), *map(float, C[i]), float(y[i])) for i in range(n)], "group_id long, fold int, c0 double, c1 double, y double")
    return frame, long_table(spark, A, "a"), long_table(spark, B, "b"), A, B, C, y, fold


def nested(A, sets, C, y, fold, k, alpha):
    """Residual traits of outer fold k, stage by stage on the rows."""
    inside, folds = fold != k, [f for f in sorted(set(fold)) if f != k]
    inferred = np.zeros(len(y))
    for j in folds:
        tr = inside & (fold != j)
        inferred[fold == j] = std_ridge(A[tr], y[tr], alpha)(A[fold == j])
    inferred[~inside] = std_ridge(A[inside], y[inside], alpha)(A[~inside])
    D = np.column_stack([C, inferred])
    joined = np.zeros(len(y))
    for j in folds:
        tr = inside & (fold != j)
        joined[fold == j] = std_ridge(D[tr], y[tr], 1.0)(D[fold == j])
    joined[~inside] = std_ridge(D[inside], y[inside], 1.0)(D[~inside])
    resid = y - joined
    return resid[~inside], {t: std_ridge(X[inside], resid[inside], alpha)(X[~inside]) for t, X in sets.items()}


def test_residual_traits_equal_nested_fits(spark, panel):
    frame, fa, fb, A, B, C, y, fold = panel
    got = QP.residual_traits(spark, frame, fa, {"a": fa, "b": fb, "ab": fa.unionByName(fb)}, "y", ["c0", "c1"], alpha=5.0).toPandas()
    assert len(got) == 3 * len(y)
    for k in range(3):
        r, want = nested(A, {"a": A, "b": B, "ab": np.column_stack([A, B])}, C, y, fold, k, 5.0)
        for t, p in want.items():
            g = got[(got.model_id == t) & (got.fold == k)].sort_values("group_id")
            assert np.allclose(g.y, r, atol=1e-6) and np.allclose(g.yhat, p, atol=1e-6)


def test_a_test_fold_does_not_reach_earlier_stages(spark, panel):
    """Other outcomes in the test fold change its targets, never a prediction for it."""
    from pyspark.sql import functions as F
    frame, fa, fb, *_ = panel
    args = (fa, {"b": fb}, "y", ["c0", "c1"])
    one = QP.residual_traits(spark, frame, *args).where("fold = 1").orderBy("group_id").toPandas()
    other = frame.withColumn("y", F.when(F.col("fold") == 1, F.col("group_id") * 7.0).otherwise(F.col("y")))
    two = QP.residual_traits(spark, other, *args).where("fold = 1").orderBy("group_id").toPandas()
    assert np.allclose(one.yhat, two.yhat, atol=1e-9) and not np.allclose(one.y, two.y)


def test_stacking_parts_are_apart(spark, panel):
    """Bases see the training part only: combiner and test outcomes don't change their predictions."""
    from pyspark.sql import functions as F
    frame, fa, fb, A, B, C, y, fold = panel
    parts = {"a": (fa, 5.0), "b": (fb, 5.0)}
    got = QM.base_predictions(spark, None, frame.select("group_id", "fold", "y"), ["y"], parts, 2, [0, 1]).orderBy("group_id").toPandas()
    changed = frame.withColumn("y", F.when(F.col("fold") == 2, F.col("y")).otherwise(F.lit(9.0))).select("group_id", "fold", "y")
    same = QM.base_predictions(spark, None, changed, ["y"], parts, 2, [0, 1]).orderBy("group_id").toPandas()
    tr = fold == 2
    assert np.allclose(got.b_a, std_ridge(A[tr], y[tr], 5.0)(A[~tr]), atol=1e-6) and np.allclose(got.b_b, std_ridge(B[tr], y[tr], 5.0)(B[~tr]), atol=1e-6)
    assert np.allclose(got[["b_a", "b_b"]], same[["b_a", "b_b"]], atol=1e-9)


def weighted_auc(x, y, w):
    p, n = y == 1, y == 0
    u = sum(w[i] * w[j] * ((x[i] > x[j]) + 0.5 * (x[i] == x[j])) for i in np.flatnonzero(p) for j in np.flatnonzero(n))
    return u / (w[p].sum() * w[n].sum())


@pytest.mark.parametrize("parts", ["1", "7"])
def test_auc_bootstrap_equals_pairs(spark, parts):
    import xxhash
    rng = np.random.default_rng(2)
    n = 40
    X = np.round(sparse_matrix(rng, n, 3, 0.6) * 4) / 4
    X[:, 2] -= 0.5 * (rng.random(n) < 0.4)
    y = (rng.random(n) < 0.4).astype(float)
    lab = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "group_id long, o double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)       # the features cross the borders of several tasks
    try:
        got = {r["feat"]: r for r in SM.auc_boot(long_table(spark, X), lab, "o", lab.select("group_id"), reps=25, seed=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    W = poisson_weights(np.array([xxhash.xxh64_intdigest(str(i).encode(), seed=42) for i in range(n)], np.uint64), 25, 3)
    assert len(got) == 3
    for j in range(3):
        want = np.array([weighted_auc(X[:, j], y, w) for w in W.T])
        r = got[f"f{j:05d}"]
        assert np.isclose(r["auc"], want[0]) and np.isclose(r["auc_boot_mean"], want[1:].mean()) and r["reps"] == 25
        assert np.isclose(r["p_boot"], 2 * min((want[1:] <= 0.5).mean(), (want[1:] >= 0.5).mean()))


def test_sinks_hold_what_was_predicted(spark):
    from tests.conftest import SF_SMALL
    wide = QM.q_predict_to_outcomes(spark, SF_SMALL)
    feats = QM.q_predict_to_feats(spark, SF_SMALL)
    assert wide.inputFiles() and feats.inputFiles()
    long = {(r["group_id"], r["feat"]): r["value"] for r in feats.collect()}
    rows = wide.collect()
    assert len(long) == 2 * len(rows)
    for r in rows:
        for o in QM.OUTCOMES:
            assert np.isclose(long[r["group_id"], f"p_ridge${o}"], r[f"p_ridge${o}"])      # of the second, replacing run
    log = QM.q_metric_log(spark, SF_SMALL).toPandas()
    assert sorted(log.model) == ["linear", "linear", "ridge", "ridge"]
