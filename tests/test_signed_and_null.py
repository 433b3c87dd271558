"""Negative feature values, null p-values, missing classes, per-label folds, splits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import folds, messages, metrics, padjust, ranks, select, stats, stats_models


def _tables(spark, rows):
    """rows: group -> (x or None, y)."""
    f = spark.createDataFrame([(g, "f", float(x), float(x)) for g, (x, _) in rows.items() if x is not None],
                              "group_id long, feat string, value double, group_norm double")
    y = spark.createDataFrame([(g, float(y)) for g, (_, y) in rows.items()], "group_id long, o double")
    return f, y, y.select("group_id")


def _avg_rank(v):
    v = np.asarray(v, float)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_probed_input_with_negative_values(spark):
    f, y, g = _tables(spark, {1: (-2, 1), 2: (-1, 0), 3: (1, 1), 4: (None, 0)})
    assert stats.auc(f, y, ["o"], g).first()["auc"] == 0.5
    assert abs(stats.spearman(f, y, ["o"], g).first()["rho"]) < 1e-12
    assert stats_models.auc_boot(f, y, "o", g, reps=3).first()["auc"] == 0.5


def test_signed_values_against_numpy(spark):
    rng = np.random.default_rng(5)
    rows = {i: (None if rng.random() < 0.3 else float(rng.integers(-4, 5)) or 0.5, int(rng.integers(0, 2))) for i in range(80)}
    f, y, g = _tables(spark, rows)
    x = np.array([v[0] or 0.0 for v in rows.values()])
    o = np.array([v[1] for v in rows.values()])
    rx, ry = _avg_rank(x), _avg_rank(o)
    assert math.isclose(stats.spearman(f, y, ["o"], g).first()["rho"], np.corrcoef(rx, ry)[0, 1], abs_tol=1e-9)
    n1 = o.sum()
    want = (rx[o == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(o) - n1))
    assert math.isclose(stats.auc(f, y, ["o"], g).first()["auc"], want, abs_tol=1e-9)
    assert math.isclose(stats_models.auc_boot(f, y, "o", g, reps=2).first()["auc"], want, abs_tol=1e-9)


def test_average_rank_of_one_shared_value(spark):
    d = spark.range(1000).select(F.lit("c").alias("c"), F.when(F.col("id") < 900, 1.0).otherwise(F.col("id") + 0.5).alias("v"))
    got = ranks.average_rank(d, ["c"], "v", "r").groupBy("v").agg(F.first("r").alias("r"), F.count("*").alias("n")).collect()
    assert {(r["r"], r["n"]) for r in got if r["v"] == 1.0} == {(450.5, 900)}
    assert sorted(r["r"] for r in got if r["v"] != 1.0) == [float(i) for i in range(901, 1001)]


@pytest.mark.parametrize("method,want", [("BH", [0.03, 0.03, 0.5]), ("bonferroni", [0.03, 0.06, 1.0]), ("holm", [0.03, 0.04, 0.5]),
                                         ("hochberg", [0.03, 0.04, 0.5])])
def test_null_p_is_no_test(spark, method, want):
    d = spark.createDataFrame([("o", f"f{i}", p) for i, p in enumerate((0.01, 0.02, 0.5, None, None, None))], "outcome string, feat string, p double")
    got = [r["p_adj"] for r in padjust.p_adjust(d, method).orderBy("feat").collect()]
    assert got[3:] == [None] * 3 and np.allclose(got[:3], want)


def test_alpha_sweep_is_the_fixed_list():
    assert select.FWE_ALPHAS == (0.25, 0.5, 1.0, 1.5, 2.0, 4.0, 5.0, 7.5, 10.0, 20.0, 30.0, 50.0, 100.0, 200.0)


def test_no_group_is_left_out_by_default(spark):
    g = spark.range(500).select(F.col("id").alias("group_id"))
    got = {r["split"]: r["count"] for r in folds.train_test_split(g).groupBy("split").count().collect()}
    assert got == {"test": 100, "train": 400}
    got = {r["split"]: r["count"] for r in folds.train_test_split(g, train_cap=50).groupBy("split").count().collect()}
    assert got == {"test": 100, "train": 50, "unused": 350}


def test_roc_with_one_class(spark):
    d = spark.createDataFrame([(0.1, 1), (0.7, 1)], "score double, label int")
    assert [(r["tpr"], r["fpr"]) for r in metrics.roc_points(d).orderBy(F.desc("threshold")).collect()] == [(0.5, None), (1.0, None)]


def test_lines_without_whitelist(spark):
    m = spark.createDataFrame([(1, 1, "One two, three"), (2, 1, "")], "message_id long, group_id long, message string")
    got = {r["message_id"]: r["line"] for r in messages.tokenized_lines(m).collect()}
    assert got[1].split() == messages.tokenize(m).where("message_id = 1").first()["tokens"]


def test_chunks_in_order_give_the_whole_text(spark):
    rows = [(i, i % 2, f"m{i}") for i in range(995, 1040)]
    d = spark.createDataFrame(rows, "message_id long, group_id long, message string")
    got = messages.concat_messages(d, chunk_size=10).orderBy("group_id", "chunk").collect()
    for g in (0, 1):
        mine = [r for r in got if r["group_id"] == g]
        assert [r["chunk"] for r in mine] == [0, 1, 2]
        assert " ".join(r["message"] for r in mine) == " ".join(m for _, k, m in rows if k == g)
    assert {r["chunk"] for r in messages.concat_messages(d).collect()} == {0}


def test_joined_lines_break_in_feature_order(spark):
    rows = [(g, f"f{k:03d} x", float(k % 4 + 1)) for g in (1, 2) for k in range(60)]
    d = spark.createDataFrame(rows, "group_id long, feat string, value double")
    whole = {r["group_id"]: r["line"] for r in messages.joined_feature_lines(d).collect()}
    got = messages.joined_feature_lines(d, tokens_per_chunk=20).orderBy("group_id", "chunk").collect()
    assert len(got) > 10
    for g in (1, 2):
        assert " ".join(r["line"] for r in got if r["group_id"] == g) == whole[g]
        assert whole[g].split() == sorted(whole[g].split())
