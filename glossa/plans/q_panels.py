"""Experiment-level compositions (2.10 recipes): fold splits, out-of-fold
inference, estimator panels, residual panels, factor adaptation, residual
traits, controls only.  All reuse the fold Grams; rows-only checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glossa.operators import gram as GR
from glossa.operators import ridge as RG
from glossa.operators.ranks import materialize
from glossa.plans.common import stored
from glossa.plans.q_models import CONTROLS, OUTCOMES, customer_design, customer_frame
from glossa.plans.registry import register
from glossa.sources import tables as src

_CUST_RN = """g AS (SELECT c_custkey AS group_id, CAST((row_number() OVER (ORDER BY md5('1' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer)"""


@register("split_fold", f"""WITH {_CUST_RN}
SELECT CAST(k AS INTEGER) AS k, group_id, CASE WHEN fold = k THEN 'test' ELSE 'train' END AS split
FROM g, range(5) t(k)""")
def q_split_fold(spark, sf_dir):
    """Train / test membership of every group for each of the 5 folds
    (an explode per group, no join)."""
    from glossa.operators.folds import k_fold
    f = k_fold(src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id")), 5)
    e = f.select("group_id", "fold", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return e.select(F.col("k").cast("int").alias("k"), "group_id",
                    F.when(F.col("fold") == F.col("k"), F.lit("test")).otherwise(F.lit("train")).alias("split"))


def _union(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _mean_model(d, outcomes):
    recs = []
    for o in outcomes:
        yi = d.index(o)
        for k in d.folds:
            G = d.total(exclude=k)
            c = [0.0] * len(d.names)
            c[0] = G[0, yi] / G[0, 0]
            recs.append((o, k, o, c))
    return pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"])


@register("infer_oof")
def q_infer_oof(spark, sf_dir):
    """Out-of-fold inference: training-mean and ridge-CV predictions per group."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    mean = RG._score(rows, _mean_model(d, ["acctbal"]), {"acctbal": d.index("acctbal")}).select(
        "group_id", F.col("yhat").alias("mean_pred"))
    ridge = RG.cv_predict(d, rows, ["acctbal"], model="ridge_cv").select("group_id", "fold", "y", F.col("yhat").alias("ridge_pred"))
    return ridge.join(mean, "group_id")


@register("cv_panel")
def q_cv_panel(spark, sf_dir):
    """Estimator panel per fold (mean, ridge, ridge-CV, least squares, lasso),
    pooled out-of-fold metrics per estimator and outcome."""
    from glossa.operators import ml as ML
    _, _, _, d, rows = customer_design(spark, sf_dir)
    idx = {o: d.index(o) for o in d.outcomes}
    parts = [RG._score(rows, _mean_model(d, d.outcomes), idx).withColumn("model_id", F.concat(F.lit("mean|"), "model_id"))]
    for name, kw in (("ridge", {"alpha": 1000.0}), ("ridge_cv", {"model": "ridge_cv"}), ("linear", {"model": "linear"})):
        p = RG.cv_predict(d, rows, **kw)
        parts.append(p.withColumn("model_id", F.concat(F.lit(name + "|"), "model_id")))
    for o in d.outcomes:
        lp = ML.cv_fit_predict(ML.assemble(rows, d, o), ML.regressor("lasso"), d.folds)
        parts.append(lp.select("group_id", "fold", F.lit(f"lasso|{o}").alias("model_id"),
                               F.col("label").alias("y"), F.col("prediction").alias("yhat")))
    return RG.score_summary(_union(parts))


@register("residual_panel")
def q_residual_panel(spark, sf_dir):
    """Controls first, then language on the controls' residuals (all controls),
    against the controls-only and joint models."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    res = RG.score_summary(RG.combo_test(d, rows, alpha=1000.0, sizes=[len(CONTROLS)], residualized=True))
    joint = RG.score_summary(RG.combo_test(d, rows, alpha=1000.0, sizes=[len(CONTROLS)]))
    return (res.withColumn("kind", F.lit("residualized")).unionByName(joint.withColumn("kind", F.lit("joint"))))


@register("controls_only")
def q_controls_only(spark, sf_dir):
    """Panel on the controls alone: least squares and ridge, out of fold."""
    frame = customer_frame(spark, sf_dir).na.drop()
    _, d = GR.build_design(None, frame, CONTROLS, ["acctbal", "avg_price"])
    rows = GR.design_rows(None, None, frame, CONTROLS, ["acctbal", "avg_price"])
    lin = RG.cv_predict(d, rows, model="linear", use_feats=False, controls=CONTROLS)
    rid = RG.cv_predict(d, rows, alpha=10.0, use_feats=False, controls=CONTROLS)
    return RG.score_summary(_union([lin.withColumn("model_id", F.concat(F.lit("linear|"), "model_id")),
                                    rid.withColumn("model_id", F.concat(F.lit("ridge|"), "model_id"))]))


# The penalties searched in the adaptation panels.
ADAPT_ALPHAS = (1.0, 10.0, 100.0, 1e3, 1e4, 1e5)


def adaptation_panel(design, tag: str = "", sets: dict | None = None, alphas=ADAPT_ALPHAS):
    """Pooled out-of-fold metrics of the mean and of ridge on each set of blocks of a design with products:
    ``sets``: name -> (features, controls, products).  The penalty of a fold and outcome is the best one over the
    other folds."""
    from glossa.operators import sparse as SP
    f, c = design.features, len(design.controls)
    sets = sets or {"language": (1, 0, 0), "language+controls": (1, 1, 0), "adapted": (1, 0, 1), "adapted+controls": (1, 1, 1)}
    parts = []
    for name, (lang, ctl, prod) in sets.items():
        use = np.concatenate([np.full(f, lang), np.full(c, ctl), np.full(design.p - f - c, prod)])
        scale = {o: np.where(use == 1, np.nan, 0.0) for o in design.outcomes}
        best = SP.chosen_alphas(design, alphas, scale)
        fitted = SP.ridge(design, sorted(set(best.values())), scale=scale)
        keep = [j for j, (k, o, a) in enumerate(fitted.keys) if best[k, o] == a]
        fitted = SP.Fitted([fitted.keys[j] for j in keep], fitted.coef[:, keep], fitted.intercept[keep], fitted.steps, fitted.residual[keep])
        p = SP.predictions(design, fitted)
        parts.append(p.withColumn("model_id", F.concat_ws("|", F.lit(tag + name), "outcome")))
    nothing = SP.ridge(design, (1.0,), scale={o: np.zeros(design.p) for o in design.outcomes})
    parts.append(SP.predictions(design, nothing).withColumn("model_id", F.concat_ws("|", F.lit(tag + "mean"), "outcome")))
    return RG.score_summary(_union(parts))


@register("factor_adaptation")
def q_factor_adaptation(spark, sf_dir):
    """Factor adaptation of both outcomes: language, and language times nation and order count (products made
    while rows are read), each with and without the controls; penalties by nested folds."""
    from glossa.operators import sparse as SP
    frame = customer_frame(spark, sf_dir).na.drop()
    d = SP.sparse_design(src.order_feats(spark, sf_dir), frame, CONTROLS, OUTCOMES)
    return adaptation_panel(SP.with_products(d, ["nationkey", "n_orders"]))


@register("factor_adaptation_saved")
def q_factor_adaptation_saved(spark, sf_dir):
    """Adaptation from saved data: components of the language, controls and outcomes are written as CSV and read
    back; each outcome is predicted from the components times the controls and the other outcome."""
    from glossa.operators import sparse as SP
    from glossa.operators.ranks import scratch_path
    frame = customer_frame(spark, sf_dir).na.drop()
    d = SP.sparse_design(src.order_feats(spark, sf_dir, "p_type"), frame)
    pcs = SP.component_scores(d, SP.principal_components(d, 20))
    root = scratch_path(spark, "saved")
    wide = pcs.select("group_id", *[F.col("pcs")[i].alias(f"comp{i:02d}") for i in range(min(20, d.p))])
    wide.write.option("header", True).csv(f"{root}/language_pca")
    frame.select("group_id", *CONTROLS).write.option("header", True).csv(f"{root}/controls")
    frame.select("group_id", "fold", *OUTCOMES).write.option("header", True).csv(f"{root}/outcomes")
    numbers = ", ".join(f"{c} double" for c in wide.columns[1:])
    language = spark.read.csv(f"{root}/language_pca", header=True, schema="group_id long, " + numbers)
    controls = spark.read.csv(f"{root}/controls", header=True, schema="group_id long, " + ", ".join(f"{c} double" for c in CONTROLS))
    outcomes = spark.read.csv(f"{root}/outcomes", header=True, schema="group_id long, fold int, " + ", ".join(f"{o} double" for o in OUTCOMES))
    stack = ", ".join(f"'{c}', {c}" for c in wide.columns[1:])
    feats = language.select("group_id", F.expr(f"stack({len(wide.columns) - 1}, {stack}) AS (feat, group_norm)"))
    back = outcomes.join(controls, "group_id")
    parts = []
    for o in OUTCOMES:
        others = [x for x in OUTCOMES if x != o]
        d = SP.sparse_design(feats, back, [*CONTROLS, *others], [o])
        parts.append(adaptation_panel(SP.with_products(d, [*CONTROLS, *others]), sets={"adapted": (1, 0, 1)}))
    return _union(parts)


def residual_traits(spark, frame, feats, sets: dict, outcome: str, controls, alpha: float = 1000.0):
    """Predictions of residual traits without a leak: (group_id, fold, model_id, y, yhat).

    For each outer fold k, and within the other folds only: the outcome is inferred from language for fold j by
    a model without k and j; controls and inference are joined for fold j by a model without k and j; the
    residuals are then predicted from each feature set.  Fold k itself is inferred, joined and
    predicted by models of all other folds.  A row appears once for each outer fold k, in cell
    k * K + j, so every stage is one pass."""
    folds = sorted(r["fold"] for r in frame.select("fold").distinct().collect())
    cells = len(folds)
    code = {(k, j): a * cells + b for a, k in enumerate(folds) for b, j in enumerate(folds)}

    def models(grams, xi, yi, a, cell):
        """Coefficients for the rows of (k, j), fitted without both; ``cell`` finds the Gram of fold f for k."""
        return {(k, j): RG.ridge_from_gram(sum(grams[cell(k, f)] for f in folds if f not in (k, j)), xi, yi, a).tolist()
                for k in folds for j in folds}

    vocab, d = GR.build_design(feats, frame, [], [outcome])
    rows = GR.design_rows(feats, vocab, frame, [], [outcome])
    yi = d.index(outcome)
    recs = [(str(k), j, outcome, c) for (k, j), c in models(d.grams, list(range(1, d.p + 1)), yi, alpha, lambda k, f: f).items()]
    inferred = RG._score(rows, pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"]), {outcome: yi})
    number = F.create_map(*[F.lit(v) for kj, c in code.items() for v in (f"{kj[0]} {kj[1]}", c)])
    cell = number[F.concat_ws(" ", "model_id", F.col("fold").cast("string"))]
    f2 = materialize(frame.drop("fold").join(inferred.select("group_id", cell.alias("fold"), F.col("yhat").alias("inferred")), "group_id"))
    cols = [*controls, "inferred"]
    _, d2 = GR.build_design(None, f2, cols, [outcome])
    r2 = GR.design_rows(None, None, f2, cols, [outcome])
    at = code
    m2 = models(d2.grams, [d2.index(c) for c in cols], d2.index(outcome), 1.0, lambda k, f: at[k, f])
    recs = [("", at[kj], outcome, c) for kj, c in m2.items()]
    joined = RG._score(r2, pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"]), {outcome: d2.index(outcome)})
    f3 = materialize(joined.select("group_id", "fold", (F.col("y") - F.col("yhat")).alias("resid")))
    parts = []
    for tag, fe in sets.items():
        v, d3 = GR.build_design(fe, f3, [], ["resid"])
        r3 = GR.design_rows(fe, v, f3, [], ["resid"])
        yi = d3.index("resid")
        recs = [(tag, at[k, k], "resid", RG.ridge_from_gram(sum(d3.grams[at[k, f]] for f in folds if f != k), list(range(1, d3.p + 1)), yi, alpha).tolist())
                for k in folds]
        parts.append(RG._score(r3, pd.DataFrame(recs, columns=["model_id", "fold", "outcome", "coef"]), {"resid": yi}))
    back = F.create_map(*[F.lit(v) for k in folds for v in (at[k, k], k)])
    return _union(parts).withColumn("fold", back[F.col("fold")])


@register("res_control")
def q_res_control(spark, sf_dir):
    """Residual traits of both outcomes: (1) infer the outcome from language, (2) improve it with the
    controls, (3) take the residual, (4) predict the residual from three feature sets (brand, type,
    both); every step within the outer training folds."""
    frame = materialize(customer_frame(spark, sf_dir).na.drop())
    brand, typ = (stored(spark, ("order_feats", sf_dir, c), lambda c=c: src.order_feats(spark, sf_dir, c)) for c in ("p_brand", "p_type"))
    sets = {"brand": brand, "type": typ, "brand+type": brand.unionByName(typ)}
    parts = []
    for o in OUTCOMES:
        p = residual_traits(spark, frame, brand, sets, o, CONTROLS)
        parts.append(p.withColumn("model_id", F.concat(F.lit(f"{o}|"), "model_id")))
    return RG.score_summary(_union(parts))
