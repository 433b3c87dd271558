"""Prediction queries (2.10, 2.11): rows-only checks plus pytest against numpy.

Data: X = brand shares of each customer's ordered quantity (order_feats),
controls = one-hot market segment, nation key, order count; outcomes =
account balance and mean order price; folds = md5 k-fold of customers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from glossa.operators import gram as GR
from glossa.operators import ridge as RG
from glossa.operators.folds import k_fold
from glossa.plans.registry import register
from glossa.sources import tables as src

CONTROLS = ["seg_automobile", "seg_building", "nationkey", "n_orders"]
OUTCOMES = ["acctbal", "avg_price"]


def customer_frame(spark, sf_dir, controls=CONTROLS, outcomes=OUTCOMES, k: int = 5):
    from glossa.plans.common import stored
    o = src.customer_outcomes(spark, sf_dir)
    c = src.customer_controls(spark, sf_dir).select("group_id", *controls)
    f = stored(spark, ("customer_folds", sf_dir, k), lambda: k_fold(o.select("group_id"), k))
    return o.select("group_id", *outcomes).join(c, "group_id").join(f, "group_id")


def customer_design(spark, sf_dir, controls=CONTROLS, outcomes=OUTCOMES, feat_col="p_brand"):
    from glossa.plans.common import stored
    feats = stored(spark, ("order_feats", sf_dir, feat_col), lambda: src.order_feats(spark, sf_dir, feat_col))
    frame = customer_frame(spark, sf_dir, controls, outcomes).na.drop()
    vocab, design = GR.build_design(feats, frame, controls, outcomes)
    rows = GR.design_rows(feats, vocab, frame, controls, outcomes)
    return feats, frame, vocab, design, rows


@register("ridge")
def q_ridge(spark, sf_dir):
    """Out-of-fold ridge (alpha 1000, standardized features) predictions."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.cv_predict(d, rows, alpha=1000.0)


@register("ridge_cv")
def q_ridge_cv(spark, sf_dir):
    """Out-of-fold ridge with the alpha chosen per fold by leave-one-out error."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.cv_predict(d, rows, model="ridge_cv")


@register("linear")
def q_linear(spark, sf_dir):
    """Out-of-fold least squares on language + controls."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.cv_predict(d, rows, model="linear", controls=CONTROLS)


@register("combo_test")
def q_combo_test(spark, sf_dir):
    """Pooled out-of-fold metrics for outcome x control combination x {controls, + language}."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.score_summary(RG.combo_test(d, rows, alpha=1000.0))


@register("residualized")
def q_residualized(spark, sf_dir):
    """Combo test where language models the residuals of the controls model."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.score_summary(RG.combo_test(d, rows, alpha=1000.0, residualized=True))


@register("adjust_outcomes")
def q_adjust_outcomes(spark, sf_dir):
    """acctbal adjusted for the controls: ``y - yhat_controls + mean(y)`` out of fold."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return RG.adjust_outcomes(d, rows, "acctbal")


@register("predict_cv_to_feats")
def q_predict_cv_to_feats(spark, sf_dir):
    """Out-of-fold predictions of every group as a feature table."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    p = RG.cv_predict(d, rows, alpha=1000.0)
    return p.select("group_id", F.concat(F.lit("p_ridge$"), "model_id").alias("feat"),
                    F.col("yhat").alias("value"), F.col("yhat").alias("group_norm"))


def _fit_all_predict(spark, sf_dir, alpha=1000.0):
    """Train on all groups, predict all groups (fold column forced to one model)."""
    _, frame, vocab, d, rows = customer_design(spark, sf_dir)
    G = d.total()
    xi = list(range(1, d.p + 1))
    recs = [(o, f, o, RG.ridge_from_gram(G, xi, d.index(o), alpha).tolist()) for o in d.outcomes for f in d.folds]
    models = pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"])
    return RG._score(rows, models, {o: d.index(o) for o in d.outcomes})


@register("predict_to_feats")
def q_predict_to_feats(spark, sf_dir):
    """Predictions of a model trained on all groups, written as a feature table and read back."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    p = _fit_all_predict(spark, sf_dir)
    path = scratch_path(spark, "feats") + "/p_ridge"
    IO.write_feature_table(p.select("group_id", F.concat(F.lit("p_ridge$"), "model_id").alias("feat"),
                                    F.col("yhat").alias("value"), F.col("yhat").alias("group_norm")), path)
    return spark.read.parquet(path)


@register("predict_to_outcomes")
def q_predict_to_outcomes(spark, sf_dir):
    """Predictions as a wide outcome table ``p_ridge$<outcome>`` per group, which replaces an
    earlier one; read back."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    path = scratch_path(spark, "outcomes") + "/p_ridge"
    for alpha in (1.0, 1000.0):         # the second run replaces the first one's table
        p = _fit_all_predict(spark, sf_dir, alpha)
        IO.write_outcome_table(p.groupBy("group_id").pivot("model_id", OUTCOMES).agg(F.first("yhat")).select(
            "group_id", *[F.col(o).alias(f"p_ridge${o}") for o in OUTCOMES]), path)
    return spark.read.parquet(path)


@register("metric_log")
def q_metric_log(spark, sf_dir):
    """Out-of-fold metrics of two models appended to a log, read back with the model's name."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    _, _, _, d, rows = customer_design(spark, sf_dir)
    path = scratch_path(spark, "log")
    for name, kw in (("ridge", {"alpha": 1000.0}), ("linear", {"model": "linear", "controls": CONTROLS})):
        IO.append_metrics(RG.score_summary(RG.cv_predict(d, rows, **kw)).withColumn("model", F.lit(name)), path)
    return spark.read.parquet(path)


@register("regression_to_lexicon")
def q_regression_to_lexicon(spark, sf_dir):
    """Ridge coefficients (raw units) with ``_intercept`` as a weighted lexicon."""
    _, _, _, d, _ = customer_design(spark, sf_dir)
    G = d.total()
    xi = list(range(1, d.p + 1))
    parts = []
    for o in d.outcomes:
        c = RG.coefficients(d, G, xi, d.index(o), 1000.0)
        c.insert(0, "category", o)
        parts.append(c[c["weight"] != 0])
    pdf = pd.concat(parts, ignore_index=True).rename(columns={"feat": "term"})
    return spark.createDataFrame(pdf, "category string, term string, weight double")


@register("holdout_test")
def q_holdout_test(spark, sf_dir):
    """Train on the md5 80 %, test on the 20 % hold-out; pooled metrics."""
    from glossa.operators.folds import train_test_split
    feats = src.order_feats(spark, sf_dir)
    o = src.customer_outcomes(spark, sf_dir).select("group_id", *OUTCOMES).na.drop()
    sp = train_test_split(o.select("group_id"), 0.2)
    sp = sp.where(F.col("split").isin("test", "train"))
    frame = o.join(sp, "group_id").withColumn("fold", F.when(F.col("split") == "test", 0).otherwise(1)).drop("split")
    vocab, d = GR.build_design(feats, frame, [], OUTCOMES)
    rows = GR.design_rows(feats, vocab, frame, [], OUTCOMES)
    G = d.grams[1]
    xi = list(range(1, d.p + 1))
    recs = [(o_, 0, o_, RG.ridge_from_gram(G, xi, d.index(o_), 1000.0).tolist()) for o_ in OUTCOMES]
    models = pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"])
    return RG.score_summary(RG._score(rows, models, {x: d.index(x) for x in OUTCOMES}))


# ---------------------------------------------------------------- pyspark.ml estimators


def _oof(spark, sf_dir, name, outcome="acctbal"):
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    data = ML.assemble(rows, d, outcome)
    p = ML.cv_fit_predict(data, ML.regressor(name), d.folds)
    return p.select("group_id", "fold", F.lit(outcome).alias("outcome"), F.col("label").alias("y"),
                    F.col("prediction").alias("yhat"))


@register("lasso")
def q_lasso(spark, sf_dir):
    """Out-of-fold lasso (L1, standardized, regParam 0.01)."""
    return _oof(spark, sf_dir, "lasso")


@register("elastic_net")
def q_elastic_net(spark, sf_dir):
    return _oof(spark, sf_dir, "elastic_net")


@register("gbt")
def q_gbt(spark, sf_dir):
    """Out-of-fold gradient-boosted trees (subsample .7, depth 5, feature share .8, seeded)."""
    return _oof(spark, sf_dir, "gbt")


@register("forest")
def q_forest(spark, sf_dir):
    """Out-of-fold random forest (stands in for extra trees)."""
    return _oof(spark, sf_dir, "forest")


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """3-fold grid search over regularization strength and L1 share; returns the grid scores."""
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    cv = ML.grid_search(ML.assemble(rows, d, "acctbal"))
    recs = [(float(pm[[p for p in pm if p.name == "regParam"][0]]), float(pm[[p for p in pm if p.name == "elasticNetParam"][0]]),
             float(m)) for pm, m in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    return spark.createDataFrame(recs, "reg_param double, elastic_net double, mean_mse double")


@register("pca")
def q_pca(spark, sf_dir):
    """Projections of the centred brand shares on the first 5 principal components."""
    from pyspark.ml.functions import vector_to_array
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    data = ML.assemble(rows, d, None)
    m = ML.centered_pca(data, min(5, d.p))
    return m.transform(data).select("group_id", vector_to_array("pcs").alias("pcs"))


@register("pca_variance")
def q_pca_variance(spark, sf_dir):
    """Components kept up to a 90 % variance share (cap: a quarter of the features)."""
    from pyspark.ml.functions import vector_to_array
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    data = ML.assemble(rows, d, None)
    full = ML.centered_pca(data, d.p)
    k = ML.pca_variance_k(full.stages[-1].explainedVariance.toArray(), 0.9, 0.25, d.p)
    m = ML.centered_pca(data, k)
    return m.transform(data).select("group_id", F.lit(k).alias("k"), vector_to_array("pcs").alias("pcs"))


@register("reduce_fwe_pca")
def q_reduce_fwe_pca(spark, sf_dir):
    """Univariate family-wise selection (alpha 60) for both outcomes, then the leading components of the
    kept, centred features (of all when nothing is kept; k = min(10, kept)), for any number of features."""
    from glossa.operators.correlate import correlate
    from glossa.operators.ranks import materialize
    from glossa.operators.select import select_fwe
    from glossa.operators.sparse import component_scores, principal_components, sparse_design
    from glossa.plans.common import stored
    feats = stored(spark, ("order_feats", sf_dir, "p_brand"), lambda: src.order_feats(spark, sf_dir))
    frame = materialize(customer_frame(spark, sf_dir).na.drop())
    c = correlate(feats, frame, OUTCOMES, groups=frame.select("group_id"), with_p=False)
    keep = materialize(select_fwe(materialize(c), 60.0))
    out = None
    for o in OUTCOMES:
        kept = feats.join(keep.where(F.col("outcome") == o).select("feat"), "feat", "left_semi")
        d = sparse_design(kept if not kept.isEmpty() else feats, frame)
        p = component_scores(d, principal_components(d, min(10, d.p))).select("group_id", F.lit(o).alias("outcome"), "pcs")
        out = p if out is None else out.unionByName(p)
    return out


@register("reducer_to_lexicon")
def q_reducer_to_lexicon(spark, sf_dir):
    """PCA loadings of the brand shares written as a weighted lexicon
    (category = component, term = feature)."""
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    m = ML.centered_pca(ML.assemble(rows, d, None), min(5, d.p))
    pc = m.stages[-1].pc.toArray()
    recs = [(f"comp{j}", d.names[1 + i], float(pc[i, j])) for j in range(pc.shape[1]) for i in range(pc.shape[0])]
    return spark.createDataFrame(recs, "category string, term string, weight double")


@register("pcr_ridge")
def q_pcr_ridge(spark, sf_dir):
    """Principal-component ridge: for each fold, the component count and alpha
    with the least leave-one-out error (search stops after two increases)."""
    from glossa.operators.reduce import pcr_ridge_cv
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return pcr_ridge_cv(d, rows, "acctbal")


@register("cca")
def q_cca(spark, sf_dir):
    """Canonical correlation of language (brand shares) with outcomes + controls:
    ridge-regularized covariance from the Gram, SVD on the small matrix,
    component scores by a Spark projection."""
    from glossa.operators.reduce import cca_scores
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return cca_scores(d, rows, n_comp=2, reg=1e-3)


@register("multir")
def q_multir(spark, sf_dir):
    """Multiple regression of each outcome on all features (least squares):
    coefficients, standard errors and t from the Gram."""
    from glossa.operators.reduce import multiple_regression
    _, _, _, d, _ = customer_design(spark, sf_dir)
    return spark.createDataFrame(multiple_regression(d), "outcome string, term string, coef double, se double, t double")


@register("score_rows")
def q_score_rows(spark, sf_dir):
    """Flat score rows: outcome, controls, with_language and pooled metrics."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    s = RG.score_summary(RG.combo_test(d, rows, alpha=1000.0))
    parts = F.split("model_id", r"\|")
    return s.select(parts[0].alias("outcome"), parts[1].alias("controls"), (parts[2] == "1").alias("with_lang"),
                    "n", "r2", "r", "mae", "mse")


@register("train_predict")
def q_train_predict(spark, sf_dir):
    """Three blocks (brand, type shares, order words) with their own scaler; types selected per outcome,
    words of the order priorities and states reduced to components; fitted on the training customers,
    saved, loaded and applied to the test customers."""
    from glossa.operators import blocks as BL
    from glossa.operators.folds import train_test_split
    from glossa.operators.ranks import scratch_path
    frame = customer_frame(spark, sf_dir).na.drop()
    split = train_test_split(frame.select("group_id"), 0.2)
    frame = frame.drop("fold").join(split.select("group_id", F.when(F.col("split") == "test", 0).otherwise(1).alias("fold")), "group_id")
    tables = {"brand": src.order_feats(spark, sf_dir, "p_brand"), "type": src.order_feats(spark, sf_dir, "p_type"),
              "state": src.order_states(spark, sf_dir)}
    design = BL.block_design(tables, frame, CONTROLS, OUTCOMES)
    model = BL.fit(design, [BL.Block("brand"), BL.Block("type", best=60), BL.Block("state", reduce=5)], alpha=1000.0, without=0)
    path = scratch_path(spark, "blocks")
    BL.save(path, model)
    weights, _ = BL.load(spark, path)
    test = frame.where("fold = 0")
    p = BL.predict(weights, {k: t.join(test.select("group_id"), "group_id", "left_semi") for k, t in tables.items()}, test, CONTROLS)
    y = test.select("group_id", F.expr("stack(2, 'acctbal', acctbal, 'avg_price', avg_price) AS (outcome, y)"))
    return p.join(y, ["group_id", "outcome"]).select("group_id", "outcome", "y", "yhat")


def base_predictions(spark, sf_dir, frame, outcomes, parts: dict, train: int, score: list):
    """(group_id, fold, outcome, b_<base> ...): bases fitted on the rows of fold ``train``, applied to
    those of ``score``.  ``parts``: base -> (feature table or None for the controls, alpha)."""
    out = None
    for name, (feats, alpha) in parts.items():
        cols = [] if feats is not None else CONTROLS
        vocab, d = GR.build_design(feats, frame, cols, outcomes)
        rows = GR.design_rows(feats, vocab, frame, cols, outcomes)
        xi = list(range(1, d.p + 1)) + [d.index(c) for c in cols]
        recs = [(o, k, o, RG.ridge_from_gram(d.grams[train], xi, d.index(o), alpha).tolist()) for o in outcomes for k in score]
        p = RG._score(rows, pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"]), {o: d.index(o) for o in outcomes})
        p = p.select("group_id", "fold", F.col("model_id").alias("outcome"), F.col("yhat").alias(f"b_{name}"))
        out = p if out is None else out.join(p, ["group_id", "fold", "outcome"])
    return out


@register("stacking")
def q_stacking(spark, sf_dir):
    """Three-way stacking: base models (brand shares, type shares, controls) fitted on the training customers, a
    ridge over their predictions fitted on the combiner's customers for every combination of two or more,
    judged on the test customers; no customer of one part is seen by an earlier fit."""
    import itertools
    from glossa.operators.folds import split3
    frame = customer_frame(spark, sf_dir).na.drop()
    part = F.when(F.col("split") == "test", 0).when(F.col("split") == "combiner", 1).otherwise(2)
    frame = frame.drop("fold").join(split3(frame.select("group_id")).select("group_id", part.alias("fold")), "group_id")
    bases = {"brand": (src.order_feats(spark, sf_dir, "p_brand"), 1000.0), "type": (src.order_feats(spark, sf_dir, "p_type"), 1000.0),
             "controls": (None, 1.0)}
    from glossa.operators.ranks import materialize
    got = materialize(base_predictions(spark, sf_dir, frame, OUTCOMES, bases, 2, [0, 1]))
    out = None
    for o in OUTCOMES:
        stacked = got.where(F.col("outcome") == o).drop("outcome").join(frame.select("group_id", o), "group_id")
        cols = [f"b_{b}" for b in sorted(bases)]
        _, d = GR.build_design(None, stacked, cols, [o])
        rows = GR.design_rows(None, None, stacked, cols, [o])
        combos = [c for size in (2, 3) for c in itertools.combinations(sorted(bases), size)]
        recs = [(f"{o}|{'+'.join(c)}", 0, o, RG.ridge_from_gram(d.grams[1], [d.index(f"b_{b}") for b in c], d.index(o), 1.0).tolist()) for c in combos]
        s = RG.score_summary(RG._score(rows, pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"]), {o: d.index(o)}))
        out = s if out is None else out.unionByName(s)
    return out


def saved_model(spark, sf_dir, feats, groups, outcomes, stages, controls=()):
    """Fit on the training groups, save, load, predict the test groups."""
    from glossa.operators import lifecycle as LC
    from glossa.operators.folds import train_test_split
    from glossa.operators.ranks import scratch_path
    path = scratch_path(spark, "model")
    d = groups.join(train_test_split(groups.select("group_id"), 0.2), "group_id")
    models, order = LC.fit(feats, d.where("split = 'train'"), outcomes, stages, controls)
    LC.save(path, models, order, controls)
    models, order, controls = LC.load(spark, path)
    return LC.predict(models, order, feats, d.where("split = 'test'").select("group_id", *controls), controls)


@register("save_load_regression")
def q_save_load_regression(spark, sf_dir):
    """Regression models with scaler and controls: saved, loaded, applied to the held-out customers."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.regression import LinearRegression
    frame = customer_frame(spark, sf_dir).na.drop()
    stages = lambda o: [StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True),
                        LinearRegression(featuresCol="scaled", labelCol=o, regParam=0.1)]
    return saved_model(spark, sf_dir, src.order_feats(spark, sf_dir), frame, OUTCOMES, stages, CONTROLS)


@register("save_load_classification")
def q_save_load_classification(spark, sf_dir):
    """Classifiers of both labels with scaler: saved, loaded, applied to the held-out documents."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from glossa.plans.q_stats import base_feats
    feats, _, _ = base_feats(spark, sf_dir)
    stages = lambda o: [StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True),
                        LogisticRegression(featuresCol="scaled", labelCol=o, regParam=0.01, maxIter=50)]
    return saved_model(spark, sf_dir, feats, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], stages)
