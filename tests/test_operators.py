"""Operator invariants and numpy cross-checks on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.functions.dist import t_sf2
from glossa.operators.correlate import correlate, correlate_controls
from glossa.operators.feats import ngram_feats
from glossa.operators.folds import k_fold
from glossa.operators.padjust import p_adjust
from glossa.operators.ranks import average_rank, global_rank, prefix_sums
from glossa.operators.stats import spearman
from glossa.sources import tables as src
from tests.conftest import SF_SMALL


def test_group_norm_sums_to_one(spark):
    f = ngram_feats(src.messages_by_doc(spark, SF_SMALL), [1, 2])
    n = F.size(F.split("feat", " "))
    s = f.groupBy("group_id", n.alias("n")).agg(F.sum("group_norm").alias("s")).toPandas()
    assert np.allclose(s["s"], 1.0)  # one table per n, each sums to 1 per group


def test_global_rank_equals_row_number(spark):
    d = src.table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice")
    g = global_rank(d, [F.col("o_totalprice").desc(), F.col("o_orderkey")]).toPandas()
    w = d.withColumn("rn2", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))).toPandas()
    m = g.merge(w, on="o_orderkey")
    assert (m["rn"] == m["rn2"]).all() and len(m) == d.count()


def test_average_rank_and_prefix_sums(spark):
    pdf = pd.DataFrame({"k": ["a"] * 6 + ["b"] * 3, "v": [3.0, 1.0, 3.0, 2.0, 5.0, 3.0, 1.0, 1.0, 0.5]})
    df = spark.createDataFrame(pdf)
    r = average_rank(df, ["k"], "v").toPandas()
    for k, g in pdf.groupby("k"):
        want = g["v"].rank(method="average").to_numpy()
        got = r[r.k == k].sort_values("v")["arank"].to_numpy()
        assert np.allclose(np.sort(got), np.sort(want))
    ps = prefix_sums(df, [F.col("v")], ["v"]).toPandas().sort_values("cum_v")
    assert np.isclose(ps["cum_v"].max(), pdf["v"].sum())


def test_folds_partition_groups(spark):
    g = src.table(spark, SF_SMALL, "customer").select(F.col("c_custkey").alias("group_id"))
    f = k_fold(g, 5).toPandas()
    assert len(f) == g.count() and f["group_id"].is_unique
    sizes = f["fold"].value_counts()
    assert sizes.max() - sizes.min() <= 1


def _dense(spark):
    feats = ngram_feats(src.messages_by_doc(spark, SF_SMALL), 1)
    top = feats.groupBy("feat").count().orderBy(F.desc("count"), "feat").limit(20)
    feats = feats.join(top.select("feat"), "feat", "left_semi")
    lab = src.label_outcomes(spark, SF_SMALL)
    groups = src.messages_by_doc(spark, SF_SMALL).select("group_id")
    fp = feats.toPandas().pivot_table(index="group_id", columns="feat", values="group_norm", aggfunc="sum")
    lp = lab.toPandas().set_index("group_id")
    X = fp.reindex(lp.index).fillna(0.0)
    return feats, lab, groups, X, lp


def test_correlate_with_zeros_matches_numpy(spark):
    feats, lab, groups, X, lp = _dense(spark)
    c = correlate(feats, lab, ["quality"], groups=groups).toPandas().set_index("feat")
    for feat in X.columns:
        r = np.corrcoef(X[feat], lp["quality"])[0, 1]
        assert abs(c.loc[feat, "r"] - r) < 1e-9
        n = len(lp)
        t = r * np.sqrt((n - 2) / (1 - r * r))
        assert abs(c.loc[feat, "p"] - t_sf2(t, n - 2)) < 1e-9


def test_partial_correlation_matches_residuals(spark):
    feats, lab, groups, X, lp = _dense(spark)
    d = src.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("group_id"),
                                                       F.col("n_chars").cast("double").alias("n_chars"),
                                                       (F.col("lang") == "en").cast("double").alias("is_en"))
    c = correlate_controls(feats, lab, ["toxic"], d, ["n_chars", "is_en"], groups).toPandas().set_index("feat")
    dc = d.toPandas().set_index("group_id").reindex(lp.index)
    Z = np.column_stack([np.ones(len(lp)), dc[["n_chars", "is_en"]].to_numpy()])
    res = lambda v: v - Z @ np.linalg.lstsq(Z, v, rcond=None)[0]
    ry = res(lp["toxic"].to_numpy())
    for feat in X.columns:
        rx = res(X[feat].to_numpy())
        want = (rx @ ry) / np.sqrt((rx @ rx) * (ry @ ry))
        assert abs(c.loc[feat, "r"] - want) < 1e-8


def test_spearman_zero_block_matches_full_ranks(spark):
    feats, lab, groups, X, lp = _dense(spark)
    s = spearman(feats, lab, ["quality"], groups).toPandas().set_index("feat")
    ry = lp["quality"].rank()
    for feat in X.columns:
        want = np.corrcoef(X[feat].rank(), ry)[0, 1]
        assert abs(s.loc[feat, "rho"] - want) < 1e-9


def test_p_adjust_monotone_and_bounded(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"outcome": "o", "feat": [f"f{i}" for i in range(200)], "p": rng.uniform(0, 0.2, 200)})
    df = spark.createDataFrame(pdf)
    for m in ("bonferroni", "holm", "hochberg", "BH", "BY"):
        out = p_adjust(df, m).toPandas().sort_values(["p", "feat"])
        assert (out["p_adj"] >= out["p"] - 1e-15).all() and (out["p_adj"] <= 1).all()
        assert (np.diff(out["p_adj"].to_numpy()) >= -1e-15).all()
    # BH against a direct computation
    bh = p_adjust(df, "BH").toPandas().sort_values(["p", "feat"])
    p = bh["p"].to_numpy()
    m = len(p)
    want = np.minimum.accumulate((p * m / np.arange(1, m + 1))[::-1])[::-1]
    assert np.allclose(bh["p_adj"], np.minimum(want, 1))


def test_logistic_per_feat_matches_numpy_newton(spark):
    from glossa.operators.stats_models import logistic_per_feat
    feats, lab, groups, X, lp = _dense(spark)
    got = logistic_per_feat(feats, lab, "quality", groups, iters=12).toPandas().set_index("feat")
    y = lp["quality"].to_numpy()
    tested = 0
    for feat in X.columns:
        A = np.column_stack([np.ones(len(y)), X[feat].to_numpy()])
        b = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-A @ b))
            H = A.T @ (A * (p * (1 - p))[:, None])
            b = b + np.linalg.solve(H, A.T @ (y - p))
        if abs(b[1]) > 100:      # (quasi-)separation: no finite maximum
            continue
        tested += 1
        assert abs(got.loc[feat, "coef"] - b[1]) < 1e-6 * max(1, abs(b[1]))
    assert tested >= 3


def test_interaction_matches_lstsq(spark):
    from glossa.operators.stats_models import interaction
    feats, lab, groups, X, lp = _dense(spark)
    d = src.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("group_id"),
                                                       (F.col("lang") == "en").cast("double").alias("is_en"))
    fr = lab.join(d, "group_id")
    got = interaction(feats, fr, "quality", "is_en").toPandas().set_index("feat")
    z = d.toPandas().set_index("group_id").reindex(lp.index)["is_en"].to_numpy()
    y = lp["quality"].to_numpy()
    tested = 0
    for feat in X.columns:
        x = X[feat].to_numpy()
        A = np.column_stack([np.ones(len(y)), x, z, x * z])
        if np.linalg.matrix_rank(A) < 4:     # singular design: reported as null
            assert np.isnan(got.loc[feat, "coef_xz"])
            continue
        b = np.linalg.lstsq(A, y, rcond=None)[0]
        assert abs(got.loc[feat, "coef_xz"] - b[3]) < 1e-6 * max(1, abs(b[3]))
        tested += 1
    assert tested >= 3


def test_auc_boot_replicate_zero_equals_auc(spark):
    from glossa.operators.stats import auc
    from glossa.operators.stats_models import auc_boot
    feats, lab, groups, X, lp = _dense(spark)
    a = auc(feats, lab, ["quality"], groups).toPandas().set_index("feat")
    b = auc_boot(feats, lab, "quality", groups, reps=3).toPandas().set_index("feat")
    for f in b.index:
        assert abs(a.loc[f, "auc"] - b.loc[f, "auc"]) < 1e-9


def test_running_extremes_and_sums_match_pandas(spark):
    from glossa.operators.ranks import running_extreme, running_sum
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 500), "o": rng.permutation(500).astype(float),
                        "v": rng.normal(size=500)})
    df = spark.createDataFrame(pdf).repartition(7)
    s = pdf.sort_values(["k", "o"])
    got = running_extreme(df, ["k"], [F.col("o")], "v", "max", "prefix", "r").toPandas().sort_values(["k", "o"])
    assert np.allclose(got["r"].to_numpy(), s.groupby("k")["v"].cummax().to_numpy())
    got = running_extreme(df, ["k"], [F.col("o")], "v", "min", "suffix", "r").toPandas().sort_values(["k", "o"])
    want = s.iloc[::-1].groupby("k")["v"].cummin().iloc[::-1]
    assert np.allclose(got["r"].to_numpy(), want.to_numpy())
    got = running_sum(df, ["k"], [F.col("o")], "v", "c", inclusive=False).toPandas().sort_values(["k", "o"])
    assert np.allclose(got["c"].to_numpy(), (s.groupby("k")["v"].cumsum() - s["v"]).to_numpy())


def test_auc_matches_rank_sum(spark):
    from glossa.operators.stats import auc
    feats, lab, groups, X, lp = _dense(spark)
    got = auc(feats, lab, ["toxic"], groups).toPandas().set_index("feat")
    y = lp["toxic"].to_numpy()
    n1, n0 = y.sum(), len(y) - y.sum()
    for feat in X.columns:
        r = X[feat].rank().to_numpy()
        want = (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        assert abs(got.loc[feat, "auc"] - want) < 1e-9


def test_sobel_matches_numpy_regressions(spark):
    from glossa.operators.stats import mediation_sobel
    o = src.order_feats(spark, SF_SMALL)
    ctl = src.customer_controls(spark, SF_SMALL).select("group_id", "n_orders")
    data = (src.table(spark, SF_SMALL, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
            .join(ctl, "group_id").where(F.col("n_orders") > 0))
    got = mediation_sobel(o, data, "n_orders", "y").toPandas().set_index("feat")
    dp = data.toPandas().set_index("group_id").sort_index()
    M = o.toPandas().pivot_table(index="group_id", columns="feat", values="group_norm", aggfunc="sum").reindex(dp.index).fillna(0.0)
    x, y = dp["n_orders"].to_numpy(), dp["y"].to_numpy()
    n = len(y)
    for feat in list(M.columns)[:6]:
        m = M[feat].to_numpy()
        A1 = np.column_stack([np.ones(n), x])
        a_coef, res_a = np.linalg.lstsq(A1, m, rcond=None)[:2]
        A2 = np.column_stack([np.ones(n), x, m])
        b_coef = np.linalg.lstsq(A2, y, rcond=None)[0]
        sa = np.sqrt(((m - A1 @ a_coef) ** 2).sum() / (n - 2) * np.linalg.inv(A1.T @ A1)[1, 1])
        sb = np.sqrt(((y - A2 @ b_coef) ** 2).sum() / (n - 3) * np.linalg.inv(A2.T @ A2)[2, 2])
        a, b = a_coef[1], b_coef[2]
        z = a * b / np.sqrt(b * b * sa * sa + a * a * sb * sb)
        assert abs(got.loc[feat, "a"] - a) < 1e-8 * max(1, abs(a))
        assert abs(got.loc[feat, "b"] - b) < 1e-6 * max(1, abs(b))
        assert abs(got.loc[feat, "sobel_z"] - z) < 1e-6 * max(1, abs(z))


def test_idp_matches_formula(spark):
    from glossa.operators.stats import idp
    feats, lab, groups, X, lp = _dense(spark)
    got = idp(feats, lab, "quality").toPandas().set_index("feat")
    fp = feats.toPandas()
    a = fp.groupby("feat")["value"].sum()
    a0 = fp["value"].sum()
    q = lp["quality"]
    g1, g2 = set(q[q == 1].index), set(q[q == 0].index)
    s1 = fp[fp.group_id.isin(g1)]
    s2 = fp[fp.group_id.isin(g2)]
    n1, n2 = s1["value"].sum(), s2["value"].sum()
    y1 = s1.groupby("feat")["value"].sum().reindex(a.index).fillna(0)
    y2 = s2.groupby("feat")["value"].sum().reindex(a.index).fillna(0)
    d = np.log((y1 + a) / (n1 + a0 - y1 - a)) - np.log((y2 + a) / (n2 + a0 - y2 - a))
    z = d / np.sqrt(1 / (y1 + a) + 1 / (y2 + a))
    assert np.allclose(got.loc[a.index, "delta"], d) and np.allclose(got.loc[a.index, "z"], z)


def test_tfidf_vectorizer_matches_pandas(spark):
    import re
    from collections import Counter
    from glossa.operators.feats import ACCENTED, UNACCENTED, english_stop_words, tfidf_vectorizer
    msgs = src.messages_by_source(spark, SF_SMALL)
    got = tfidf_vectorizer(msgs).toPandas()
    stop = set(english_stop_words(spark))
    table = str.maketrans(ACCENTED, UNACCENTED)
    docs = {}
    for r in msgs.toPandas().itertuples(index=False):
        t = [w for w in re.findall(r"[^\W_]{2,}", r.message.lower().translate(table)) if w not in stop]
        docs.setdefault(r.group_id, []).append(t)
    tf = {}
    for g, lists in docs.items():
        c = Counter()
        for t in lists:
            for n in (1, 2, 3):
                c.update(" ".join(t[i:i + n]) for i in range(len(t) - n + 1))
        tf[g] = c
    n_docs = len(tf)
    df = Counter(f for c in tf.values() for f in c)
    ctf = Counter()
    for c in tf.values():
        ctf.update(c)
    vocab = [f for f in df if 0.2 * n_docs <= df[f] <= 0.8 * n_docs]
    vocab = set(sorted(vocab, key=lambda f: (-ctf[f], f))[:200000])
    rows = []
    for g, c in tf.items():
        w = {f: v * (np.log((1 + n_docs) / (1 + df[f])) + 1) for f, v in c.items() if f in vocab}
        norm = np.sqrt(sum(x * x for x in w.values()))
        rows += [(g, f, c[f], x / norm) for f, x in w.items()]
    want = pd.DataFrame(rows, columns=["group_id", "feat", "value", "group_norm"])
    m = got.merge(want, on=["group_id", "feat"], suffixes=("_g", "_w"))
    assert len(m) == len(want) == len(got)
    assert np.allclose(m["group_norm_g"], m["group_norm_w"]) and np.allclose(m["value_g"], m["value_w"])
