"""Steps that send few rows to the many, or count a row where it lies, instead of shuffling all n-grams."""

import pytest

from glossa.operators import feats as FE
from glossa.operators import messages as M
from glossa.operators import ranks
from glossa.operators import refine as R

MESSAGES = [(1, 1, "a b a b a"), (2, 2, ""), (3, 3, None), (4, 4, "one"), (5, 5, "The the THE end"), (6, 6, "x y"), (7, 6, "y x y"),
            (8, None, "lost words lost"), (9, None, "lost again"), (10, 7, "ä ö ä 1 22 1"), (11, 8, None), (12, 8, "only here")]


@pytest.fixture()
def messages(spark):
    return spark.createDataFrame(MESSAGES, "message_id long, group_id long, message string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3])
def test_lone_messages_count_as_grouped_ones(messages, n):
    def rows(d):
        return sorted((tuple(r) for r in d.collect()), key=repr)
    want = FE.ngram_feats(messages, n)
    got = FE.lone_message_feats(messages, n)
    assert rows(got) == rows(want) and got.dtypes == want.dtypes
    assert any(v > 1 for _, _, v, _ in rows(got)) or n == 3


def test_lone_messages_are_not_shuffled(messages):
    lone = FE.lone_message_feats(messages.where("group_id < 6"), 2)
    text = plan(lone)
    assert "Aggregate" not in text and "Exchange hashpartitioning" not in text and lone.count() == 4


def test_joined_lines_keep_no_copy_and_repeat_last(spark, monkeypatch):
    kept = []
    plain = ranks.materialize
    monkeypatch.setattr(ranks, "materialize", lambda df: (kept.append(df.columns), plain(df))[1])
    f = spark.createDataFrame([(1, "b c", 2.0), (1, "a", 3.0), (2, "z", 1.0), (None, "q", 1.0)], "group_id long, feat string, value double")
    got = {(r["group_id"], r["chunk"]): r["line"] for r in M.joined_feature_lines(f).collect()}
    assert got == {(1, 0): "a a a b_c b_c", (2, 0): "z"}
    assert kept and all("feat" not in c for c in kept)


def test_kept_features_are_written_before_the_rows_meet_them(spark):
    f = spark.createDataFrame([(g, w, 1.0) for g in range(10) for w in ("all", f"own{g}")], "group_id long, feat string, value double")
    got = R.feat_occ_filter(f, 0.5)
    assert "Aggregate" not in plan(got) and {r["feat"] for r in got.collect()} == {"all"} and got.count() == 10


def test_vectorizer_sends_its_vocabulary(spark, monkeypatch):
    m = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate([("u", "red fox runs"), ("v", "red fox sleeps"), ("w", "blue whale")])],
                              "message_id long, group_id string, message string")
    plans = []
    plain = FE.materialize
    monkeypatch.setattr(FE, "materialize", lambda df: (plans.append(plan(df)) if "_w" in df.columns else None, plain(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {(r["group_id"], r["feat"]) for r in FE.tfidf_vectorizer(m, min_df=0.5, max_df=0.9, stop_words=[]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(g, w) for g in "uv" for w in ("red", "fox", "red fox")}
    assert len(plans) == 1 and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]


def test_collocations_are_written_step_by_step(spark, monkeypatch):
    f = spark.createDataFrame([("u", "a b", 2.0), ("u", "b c", 1.0), ("v", "a b", 1.0)], "group_id string, feat string, value double")
    w = spark.createDataFrame([("u", "a", 3.0), ("u", "b", 4.0), ("v", "b", 1.0), ("u", "c", 1.0), ("v", "a", 1.0)], "group_id string, feat string, value double")
    kept = []
    for mod in (R, FE):
        monkeypatch.setattr(mod, "materialize", lambda df, plain=mod.materialize: (kept.append(set(df.columns)), plain(df))[1])
    pmi = R.ngram_pmi(f, w)
    assert {"feat", "c", "n"} in kept                       # n-gram totals are made once
    got = FE.colloc_feats(w, f, pmi.select("feat"))
    assert {"group_id", "_total"} in kept and "Aggregate" not in plan(got)
    assert {(r["group_id"], r["feat"]): (r["value"], r["group_norm"]) for r in got.collect()} == {
        ("u", "a"): (1.0, 0.2), ("u", "b"): (1.0, 0.2), ("u", "a b"): (2.0, 0.4), ("u", "b c"): (1.0, 0.2), ("v", "a b"): (1.0, 1.0)}


def test_fits_read_no_more_parts_than_cores(spark):
    from glossa.operators.ml import fit_together

    class Counter:
        def copy(self):
            return self

        def fit(self, part):
            return part.rdd.getNumPartitions(), part.count()
    f = spark.range(100).selectExpr("id", "id AS x").repartition(40)
    cores = spark.sparkContext.defaultParallelism
    assert cores < 40 and fit_together(Counter(), [f]) == [(cores, 100)]
