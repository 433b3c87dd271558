"""Long feature tables are counted, joined and ranked once, whatever the number of outcomes or readers."""

import numpy as np

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _odd(spark):
    """Features with negative values, ties and an absent block; outcomes that are null here and there; a group twice."""
    rng = np.random.default_rng(3)
    n = 30
    y = [(i, None if i % 7 == 0 else float(i % 2), None if i % 5 == 0 else float(rng.integers(0, 4))) for i in range(n)] + [(1, 1.0, 2.0)]
    x = [(i, f, float(rng.integers(-2, 4))) for f in ("a", "b", "c") for i in range(n) if rng.random() < 0.7] + [(0, "only_null", 1.0)]
    return (spark.createDataFrame(x, "group_id long, feat string, group_norm double"), x,
            spark.createDataFrame(y, "group_id long, p double, q double"), y)


def _dense(x, y, feat, k):
    at = {g: v for g, f, v in x if f == feat}
    pairs = [(at.get(r[0], 0.0), r[k]) for r in y if r[k] is not None]
    return np.array(pairs).T


def _ranks(v):
    s = np.sort(v)
    return (np.searchsorted(s, v, "left") + np.searchsorted(s, v, "right") + 1) / 2


def test_correlations_shuffle_a_row_per_feature(spark):
    """the sums of all outcomes are one row of a feature."""
    from glossa.operators.correlate import correlate, correlate_controls
    f, x, o, y = _odd(spark)
    groups = o.select("group_id").distinct()
    c = correlate(f, o, ["p", "q"], groups=groups, with_p=False)
    assert "hashpartitioning(outcome" not in _plan(c)
    got = {(r["outcome"], r["feat"]): r for r in c.collect()}
    assert {k[1] for k in got if k[0] == "p"} == {"a", "b", "c"}       # no row where the outcome is unknown
    for k, out in ((1, "p"), (2, "q")):
        for feat in "abc":
            a, b = _dense(x, y, feat, k)
            r = got[out, feat]
            assert r["n"] == len(a) and abs(r["r"] - np.corrcoef(a, b)[0, 1]) < 1e-9
            assert r["freq"] == (a > 0).sum()
    ctl = groups.withColumn("k", (groups.group_id % 3).cast("double"))
    p = correlate_controls(f, o, ["p", "q"], ctl, ["k"], groups, with_p=False)
    assert "hashpartitioning(outcome" not in _plan(p)
    got = {(r["outcome"], r["feat"]): r for r in p.collect()}
    for k, out in ((1, "p"), (2, "q")):
        for feat in "abc":
            a, b = _dense(x, y, feat, k)
            z = np.stack([np.ones(len(a)), [r[0] % 3 for r in y if r[k] is not None]], 1)
            ra, rb = (v - z @ np.linalg.lstsq(z, v, rcond=None)[0] for v in (a, b))
            assert abs(got[out, feat]["r"] - np.corrcoef(ra, rb)[0, 1]) < 1e-9


def test_flagship_is_written_once(spark):
    """users that read the correlations several times read a file."""
    from glossa.plans.q_stats import flagship
    assert "Exchange" not in _plan(flagship(spark, SF_SMALL, with_p=False))


def test_ranks_come_from_distinct_values(spark):
    """rank sums from the distinct values, no rank joined back to the groups' rows."""
    from glossa.operators.stats import auc, spearman
    f, x, o, y = _odd(spark)
    groups = o.select("group_id").distinct()
    rho, area = spearman(f, o, ["p", "q"], groups), auc(f, o, ["p"], groups)
    for d in (rho, area):
        assert not [k for k in _plan(d).splitlines() if "Join" in k and "x#" in k]
    rho = {(r["outcome"], r["feat"]): r for r in rho.collect()}
    area = {r["feat"]: r["auc"] for r in area.collect()}
    for feat in "abc":
        for k, out in ((1, "p"), (2, "q")):
            a, b = _dense(x, y, feat, k)
            assert rho[out, feat]["n"] == len(a)
            assert abs(rho[out, feat]["rho"] - np.corrcoef(_ranks(a), _ranks(b))[0, 1]) < 1e-9
        a, b = _dense(x, y, feat, 1)
        d = a[b == 1][:, None] - a[b == 0]
        assert abs(area[feat] - ((d > 0) + 0.5 * (d == 0)).mean()) < 1e-9


def test_both_sides_in_one_pass(spark, monkeypatch):
    """F32: the correlations of both sides are one pass."""
    from glossa.plans import q_stats
    calls, real = [], q_stats.correlate
    monkeypatch.setattr(q_stats, "correlate", lambda *a, **k: calls.append(1) or real(*a, **k))
    d = E.queries()["ddla_groups"](spark, SF_SMALL)
    assert len(calls) == 1 and d.columns == ["outcome", "feat", "r", "n", "freq", "t", "p", "is_en"]
    assert {r["outcome"] for r in d.select("outcome").collect()} <= {"quality"}


def test_short_groups_are_not_sorted_globally(spark, monkeypatch):
    """only groups of more than a line's tokens need a running sum; theirs is right."""
    from glossa.operators import ranks
    from glossa.operators.messages import joined_feature_lines
    rows = [(1, "b c", 2.0), (1, "a", 1.0), (2, "x", 1.0)]
    f = spark.createDataFrame(rows, "group_id long, feat string, value double")
    real = ranks.running_sum
    monkeypatch.setattr(ranks, "running_sum", lambda *a, **k: 1 / 0)
    got = {(r["group_id"], r["chunk"]): r["line"] for r in joined_feature_lines(f, 10).collect()}
    assert got == {(1, 0): "a b_c b_c", (2, 0): "x"}
    monkeypatch.setattr(ranks, "running_sum", real)
    got = {(r["group_id"], r["chunk"]): r["line"] for r in joined_feature_lines(f, 2).collect()}
    assert got == {(1, 0): "a b_c b_c", (2, 0): "x"}
    got = {(r["group_id"], r["chunk"]): r["line"] for r in joined_feature_lines(f, 1).collect()}
    assert got == {(1, 0): "a", (1, 1): "b_c b_c", (2, 0): "x"}


def test_inline_lexicon_is_broadcast(spark):
    """Features aren't dealt out by word to meet the lexicon's few rows."""
    from glossa.operators.feats import lexicon_feats
    from glossa.sources import tables as src
    f = spark.createDataFrame([(1, "the", 2.0, 0.5), (1, "x", 2.0, 0.5)], "group_id long, feat string, value double, group_norm double")
    d = lexicon_feats(f, src.lexicon(spark))
    assert "hashpartitioning(feat" not in _plan(d) and [(r["feat"], r["value"], r["group_norm"]) for r in d.collect()] == [("func_en", 2.0, 0.5)]


def _counted(monkeypatch):
    from glossa.operators import feats
    calls, real = [], feats.ngram_counts
    monkeypatch.setattr(feats, "ngram_counts", lambda m, n=1, *a, **k: calls.append(n) or real(m, n, *a, **k))
    return calls


def test_ngrams_of_tag_clouds_and_pmi_are_stored(spark, monkeypatch):
    """a second query of a session doesn't count the n-grams again."""
    q = E.queries()
    for key in ("tagcloud_data", "pmi_filter"):
        q[key](spark, SF_SMALL).count()
        calls = _counted(monkeypatch)
        q[key](spark, SF_SMALL).count()
        assert not calls, key


def test_tables_read_twice_are_written_once(spark):
    """the counts that several branches read come from a file."""
    from glossa.operators.feats import tfidf_vectorizer
    from glossa.operators.refine import combine_feats
    f = spark.createDataFrame([(1, "a", 1.0, 1.0)], "group_id long, feat string, value double, group_norm double")
    g = f.groupBy("group_id", "feat").agg({"value": "sum", "group_norm": "sum"}).toDF("group_id", "feat", "value", "group_norm")
    d = combine_feats({"u": g, "v": f})
    assert "hashpartitioning(group_id" not in _plan(d) and {r["feat"] for r in d.collect()} == {"u:a", "v:a"}
    m = spark.createDataFrame([(1, "Cat the cat dog"), (2, "cat bird"), (3, "bird fly")], "group_id long, message string")
    t = tfidf_vectorizer(m, ngram_range=(1, 1))
    assert "regexp_extract_all" not in _plan(t)
    assert {(r["group_id"], r["feat"], r["value"]) for r in t.collect()} == {
        (1, "cat", 2.0), (1, "dog", 1.0), (2, "cat", 1.0), (2, "bird", 1.0), (3, "bird", 1.0), (3, "fly", 1.0)}
    assert "regexp_extract_all" not in _plan(E.queries()["colloc_feats"](spark, SF_SMALL))


def test_coefficients_meet_their_names_in_a_join(spark):
    """no list of names or of rows on the driver."""
    from types import SimpleNamespace
    from pyspark.ml.linalg import Vectors
    from glossa.plans.q_class import coefficient_lexicon
    order = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "feat string, idx int")
    d = coefficient_lexicon(SimpleNamespace(coefficients=Vectors.dense([0.5, 0.0, -2.0]), intercept=0.25), order, "toxic")
    assert "Join" in _plan(d)
    assert d.columns == ["category", "term", "weight"]
    assert {tuple(r) for r in d.collect()} == {("toxic", "_intercept", 0.25), ("toxic", "a", 0.5), ("toxic", "c", -2.0)}


def test_few_columns_are_solved_in_one_pass(spark, monkeypatch):
    """ridge on few columns takes two passes, and gives what conjugate gradients give."""
    from glossa.operators import sparse as SP
    rng = np.random.default_rng(5)
    n = 120
    x = [(i, f, float(rng.normal())) for f in "abcd" for i in range(n) if rng.random() < 0.6]
    frame = spark.createDataFrame([(i, i % 4, 5.0 + i % 3, float(rng.normal()), None if i % 9 == 0 else float(rng.normal())) for i in range(n)],
                                  "group_id long, fold int, k double, u double, v double")
    feats = spark.createDataFrame(x, "group_id long, feat string, group_norm double")
    d = SP.with_products(SP.sparse_design(feats, frame, ["k"], ["u", "v"]), ["k"])
    scale = {"u": np.full(d.p, np.nan), "v": np.where(np.arange(d.p) < 5, np.nan, 0.0)}
    passes, real = [], SP.summed
    monkeypatch.setattr(SP, "summed", lambda *a, **k: passes.append(1) or real(*a, **k))
    got = SP.ridge(d, (1.0, 50.0), [0, (1, 2), None], scale)
    assert len(passes) == 2 and got.residual.max() < 1e-10
    monkeypatch.setattr(SP, "DENSE", 0)
    want = SP.ridge(d, (1.0, 50.0), [0, (1, 2), None], scale)
    assert want.steps > 1 and got.keys == want.keys
    np.testing.assert_allclose(got.coef, want.coef, atol=1e-8)
    np.testing.assert_allclose(got.intercept, want.intercept, atol=1e-8)


def test_order_features_are_read_from_the_store(spark, monkeypatch):
    """every design of the query reads order features that were written once."""
    from glossa.sources import tables as src
    q = E.queries()
    first = {k: {tuple(r)[:2] for r in q[k](spark, SF_SMALL).collect()} for k in ("reduce_fwe_pca", "res_control")}
    monkeypatch.setattr(src, "order_feats", lambda *a: 1 / 0)
    for k, rows in first.items():
        assert {tuple(r)[:2] for r in q[k](spark, SF_SMALL).collect()} == rows
