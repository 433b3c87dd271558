"""Models over any number of columns (2.8, 2.10, 2.11) and their companions: sparse ridge and
components, penalty paths, many classifiers at once, mediation in all roles, feature
clusters, penalized CCA, Hommel's correction.

Those with a closed form have SQL; the rest is held against numpy in
``tests/test_sparse_models.py`` and ``tests/test_paths_and_mediation.py``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from glossa.operators import cluster as CL
from glossa.operators import lasso as LS
from glossa.operators import logistic as LG
from glossa.operators import mediation as MD
from glossa.operators import sparse as SP
from glossa.operators import sparse_cca as SC
from glossa.operators import spread as SD
from glossa.plans.common import rnd, stored
from glossa.plans.q_class import DOC_CONTROLS, doc_frame
from glossa.plans.q_models import CONTROLS, customer_design, customer_frame
from glossa.plans.q_stats import base_feats
from glossa.plans.q_text import _ORDER_FEATS_SQL
from glossa.plans.registry import register
from glossa.sources import tables as src


def words_design(spark, sf_dir, label: str = "quality", controls=(), outcomes=("quality", "toxic")) -> SP.SparseDesign:
    """All 1-grams of the labelled documents; folds stratified by a label."""
    feats, _, _ = base_feats(spark, sf_dir)
    return SP.sparse_design(feats, doc_frame(spark, sf_dir, label), controls, outcomes)


@register("ridge_wide")
def q_ridge_wide(spark, sf_dir):
    """Out-of-fold ridge of both labels on all 1-grams and the controls, by conjugate gradients."""
    d = words_design(spark, sf_dir, controls=DOC_CONTROLS)
    return SP.predictions(d, SP.ridge(d, alphas=(1000.0,)))


def all_words(spark, sf_dir) -> SP.SparseDesign:
    """All 1-grams of all documents that have any."""
    feats, _, groups = base_feats(spark, sf_dir)
    return SP.sparse_design(feats, groups.withColumn("fold", F.lit(0)))


@register("pca_wide")
def q_pca_wide(spark, sf_dir):
    """Scores of all documents on the 50 leading components of all 1-grams (randomized range finder)."""
    return SD.component_scores(SD.principal_components(all_words(spark, sf_dir), 50))


@register("pca_wide_to_lexicon")
def q_pca_wide_to_lexicon(spark, sf_dir):
    """Loadings of all 1-grams on the 10 leading components as a weighted lexicon."""
    return SD.loadings(SD.principal_components(all_words(spark, sf_dir), 10))


@register("feature_clusters")
def q_feature_clusters(spark, sf_dir):
    """All 1-grams clustered by the documents that use them (50 clusters), as a lexicon."""
    feats, _, _ = base_feats(spark, sf_dir)
    return CL.cluster_lexicon(CL.k_means(CL.feature_rows(feats), 50))


@register("lasso_cv")
def q_lasso_cv(spark, sf_dir):
    """Out-of-fold lasso of both outcomes; the penalty of each fold by nested folds."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return LS.cv_predict(d, rows)[0]


@register("elastic_net_cv")
def q_elastic_net_cv(spark, sf_dir):
    """Out-of-fold elastic net of both outcomes; penalty and L1 share of each fold by nested folds."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    return LS.cv_predict(d, rows, ratios=LS.NET_RATIOS, count=LS.NET_ALPHAS)[0]


@register("lasso_path")
def q_lasso_path(spark, sf_dir):
    """The chosen point for each outcome and fold with its error and number of features."""
    _, _, _, d, rows = customer_design(spark, sf_dir)
    chosen = LS.cv_predict(d, rows)[1]
    chosen["n_feats"] = [sum(x != 0 for x in c[1:1 + d.p]) for c in chosen["coef"]]
    return spark.createDataFrame(chosen[["outcome", "fold", "alpha", "place", "mse", "n_feats"]])


def control_sets(controls) -> list:
    return [c for k in range(len(controls) + 1) for c in itertools.combinations(controls, k)]


@register("classify_combos")
def q_classify_combos(spark, sf_dir):
    """Logistic regression of two labels (a positive balance, a mean price above that of all customers) for every
    set of the four controls: alone, with language (brand shares) and with language adapted to the set
    (products); five folds: accuracy and AUC of the pooled held-out customers."""
    frame = customer_frame(spark, sf_dir).na.drop()
    mean = frame.agg(F.avg("avg_price")).first()[0]
    frame = frame.select("group_id", "fold", *CONTROLS, (F.col("acctbal") > 0).cast("double").alias("rich"),
                         (F.col("avg_price") > F.lit(mean)).cast("double").alias("dear"))
    feats = stored(spark, ("order_feats", sf_dir, "p_brand"), lambda: src.order_feats(spark, sf_dir))
    d = SP.sparse_design(feats, frame, CONTROLS, ["rich", "dear"])
    kinds = dict.fromkeys((c, lang, ad) for c in control_sets(CONTROLS) for lang, ad in ((False, ()), (True, ()), (True, c)) if lang or c)
    specs = [LG.Spec(lab, k, c, lang, ad) for c, lang, ad in kinds for lab in d.outcomes for k in d.folds]
    fitted = LG.fit(d, specs)
    p = LG.probabilities(d, fitted)
    names = spark.createDataFrame([(j, ",".join(s.controls), s.language, ",".join(s.adapt), bool(fitted.converged[j]))
                                   for j, s in enumerate(specs)], "model int, controls string, with_lang boolean, adapted string, converged boolean")
    by = ["label", "controls", "with_lang", "adapted"]
    pooled = p.join(F.broadcast(names), "model")        # a row for each model
    each = pooled.groupBy(*by, "prob").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), F.bool_and("converged").alias("converged"),
                                           F.sum(((F.col("prob") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("right"))
    from glossa.operators.ranks import running_sum
    below = running_sum(each, by, [F.col("prob")], "neg", "below", inclusive=False)
    a = below.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum("right").alias("right"),
                               F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg"))).alias("u"), F.bool_and("converged").alias("converged"))
    return a.select(*by, (F.col("p") + F.col("q")).cast("long").alias("n"), (F.col("right") / (F.col("p") + F.col("q"))).alias("accuracy"),
                    (F.col("u") / F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("auc"), "converged")


# ---------------------------------------------------------------- mediation

def mediation_data(spark, sf_dir):
    """Brand shares, and order count, balance, mean price and nation of the customers with orders."""
    feats = stored(spark, ("order_feats", sf_dir, "p_brand"), lambda: src.order_feats(spark, sf_dir))
    ctl = src.customer_controls(spark, sf_dir).select("group_id", "n_orders", "nationkey")
    return feats, src.customer_outcomes(spark, sf_dir).join(ctl, "group_id").where("n_orders > 0")


ROLES = {"mediator": ("n_orders", MD.FEATURE, "acctbal", ["nationkey"]), "start": (MD.FEATURE, "avg_price", "acctbal", ["nationkey"]),
         "outcome": ("n_orders", "avg_price", MD.FEATURE, ["nationkey"]), "control": ("n_orders", "avg_price", "acctbal", ["nationkey", MD.FEATURE])}
_SQL_ROLES = {"mediator": ("x", "f", "y", "0"), "start": ("f", "m", "y", "0"), "outcome": ("x", "m", "f", "0"), "control": ("x", "m", "y", "f")}


def _mediation_sql():
    rows = " UNION ALL ".join(f"SELECT '{r}' AS role, feat, {a}::DOUBLE AS x, {b}::DOUBLE AS m, {c}::DOUBLE AS y, z, {k}::DOUBLE AS k FROM e"
                              for r, (a, b, c, k) in _SQL_ROLES.items())
    pairs = [("x", "x"), ("m", "m"), ("y", "y"), ("x", "m"), ("x", "y"), ("m", "y"), ("x", "k"), ("m", "k"), ("y", "k"), ("k", "k")]
    cov = ", ".join(f"covar_pop({a}, {b}) * count(*) AS {a}{b}" for a, b in pairs)
    zs = ", ".join(f"covar_pop({a}, z) * count(*) AS {a}z" for a in "xmykz")
    one = ", ".join(f"{a}{b} - {a}z * {b}z / zz AS {a}{b}" for a, b in pairs)
    two = ", ".join(f"{a}{b} - CASE WHEN kk > 1e-12 THEN {a}k * {b}k / kk ELSE 0 END AS {a}{b}" for a, b in pairs[:6])
    return f"""WITH {_ORDER_FEATS_SQL},
o AS (SELECT o_custkey AS group_id, count(*)::DOUBLE AS x, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey),
d AS (SELECT c_custkey AS group_id, x, m, c_acctbal AS y, c_nationkey::DOUBLE AS z FROM customer JOIN o ON c_custkey = o.group_id),
e AS (SELECT v.feat, x, m, y, z, coalesce(group_norm, 0) AS f FROM d, (SELECT DISTINCT feat FROM ofe) v
      LEFT JOIN ofe ON ofe.group_id = d.group_id AND ofe.feat = v.feat),
r AS ({rows}),
c AS (SELECT role, feat, count(*) AS n, {cov}, {zs} FROM r GROUP BY role, feat),
p AS (SELECT role, feat, n, {one} FROM c),
s AS (SELECT role, feat, n, n - 3 - (role = 'control')::INT AS df, {two} FROM p),
t AS (SELECT *, xm / xx AS a, xy / xx AS c, xx * mm - xm * xm AS det FROM s),
u AS (SELECT *, (xx * my - xm * xy) / det AS b, (mm * xy - xm * my) / det AS d FROM t),
w AS (SELECT *, (mm - a * xm) / df / xx AS va, (yy - b * my - d * xy) / (df - 1) AS s2, (yy - c * xy) / df / xx AS vc FROM u)
SELECT role, feat, n, round(a, 6) + 0 AS a, round(sqrt(va), 6) + 0 AS se_a, round(b, 6) + 0 AS b, round(sqrt(s2 * xx / det), 6) + 0 AS se_b,
       round(c, 6) + 0 AS c, round(sqrt(vc), 6) + 0 AS se_c, round(d, 6) + 0 AS c_prime, round(sqrt(s2 * mm / det), 6) + 0 AS se_c_prime,
       round(a * b, 6) + 0 AS indirect, round(a * b / sqrt(b * b * va + a * a * s2 * xx / det), 6) + 0 AS sobel_z FROM w"""


def _all_roles(spark, sf_dir, **kw):
    feats, data = mediation_data(spark, sf_dir)
    parts = [MD.mediation(data, *spec[:3], feats, spec[3], **kw).select(F.lit(role).alias("role"), "*") for role, spec in ROLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("mediation_roles", _mediation_sql())
def q_mediation_roles(spark, sf_dir):
    """Paths of the mediation with each brand share as mediator, start, outcome or control, beside the nation."""
    r = _all_roles(spark, sf_dir, reps=1)
    return r.select("role", "feat", "n", *[(rnd(c) + 0.0).alias(c) for c in ("a", "se_a", "b", "se_b", "c", "se_c", "c_prime", "se_c_prime", "indirect", "sobel_z")])


@register("mediation_parametric")
def q_mediation_parametric(spark, sf_dir):
    """Indirect, direct and total effects in all roles with intervals from 1,000 draws."""
    return _all_roles(spark, sf_dir, reps=1000)


@register("mediation_no_features")
def q_mediation_no_features(spark, sf_dir):
    """Order count, mean price and balance: mediation without a feature, 1,000 bootstrap replicates."""
    _, data = mediation_data(spark, sf_dir)
    return MD.mediation(data, "n_orders", "avg_price", "acctbal", None, ["nationkey"], method="boot").drop("feat")


# ---------------------------------------------------------------- canonical correlation

def _cca_design(spark, sf_dir, columns):
    feats, data = mediation_data(spark, sf_dir)
    return SP.sparse_design(feats, data.withColumn("fold", F.lit(0)), [], columns)


@register("cca_penalized")
def q_cca_penalized(spark, sf_dir):
    """Brand shares with outcomes, and brand shares with controls: two pairs each under L1 bounds."""
    out = None
    for tag, cols in (("outcomes", ["acctbal", "avg_price"]), ("controls", ["n_orders", "nationkey"])):
        d = _cca_design(spark, sf_dir, cols)
        pairs = SC.penalized_cca(d, 2, 0.5, 1.0)
        corr = spark.createDataFrame([(j, float(pairs.d[j]), float(pairs.correlation[j])) for j in range(len(pairs.d))],
                                     "component int, d double, correlation double")
        one = SC.pair_weights(d, pairs).join(F.broadcast(corr), "component").select(F.lit(tag).alias("against"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("cca_permutations")
def q_cca_permutations(spark, sf_dir):
    """Permutation test of the first pair for each penalty (100 permutations)."""
    d = _cca_design(spark, sf_dir, ["acctbal", "avg_price"])
    return spark.createDataFrame(SC.permutation_table(d), "penalty double, d double, null_mean double, null_sd double, z double, p double")


# ---------------------------------------------------------------- Hommel

_HOMMEL_SQL = f"""WITH {_ORDER_FEATS_SQL},
g AS (SELECT c_custkey AS group_id, c_acctbal AS y, c_nationkey FROM customer WHERE c_custkey IN (SELECT group_id FROM ofe)),
o AS (SELECT group_id, 'acctbal' AS outcome, y FROM g UNION ALL SELECT group_id, 'nationkey', c_nationkey::DOUBLE FROM g),
v AS (SELECT DISTINCT feat FROM ofe),
e AS (SELECT o.outcome, v.feat, corr(coalesce(group_norm, 0), y) AS r, count(*) AS n FROM o, v
      LEFT JOIN ofe ON ofe.group_id = o.group_id AND ofe.feat = v.feat GROUP BY ALL),
p AS (SELECT outcome, feat, 1 / (1 + exp(0.07056 * power(abs(atanh(r) * sqrt(n - 3)), 3) + 1.5976 * abs(atanh(r) * sqrt(n - 3)))) * 2 AS p FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY p, feat) AS k, count(*) OVER (PARTITION BY outcome) AS m FROM p),
a AS (SELECT s.outcome, s.i, min(s.i * k.p / (k.k - k.m + s.i)) AS alpha FROM k, LATERAL (SELECT k.outcome, unnest(range(1, k.m + 1)) AS i) s
      WHERE k.k > k.m - s.i GROUP BY s.outcome, s.i),
b AS (SELECT k.outcome, k.feat, k.p, k.m, coalesce(max(a.i) FILTER (a.i * k.p < a.alpha), 0) AS i FROM k JOIN a USING (outcome) GROUP BY ALL)
SELECT b.outcome, b.feat, round(b.p, 9) AS p, round(least(1, greatest(coalesce(a.alpha, 0), b.i * b.p)), 9) AS p_adj
FROM b LEFT JOIN a ON a.outcome = b.outcome AND a.i = b.i + 1"""


@register("p_adjust_hommel", _HOMMEL_SQL)
def q_p_adjust_hommel(spark, sf_dir):
    """Hommel's correction of the brand shares' correlations with balance and nation (logistic approximation
    of the normal tail, so that the oracle can compute it)."""
    from glossa.operators.correlate import correlate
    from glossa.operators.padjust import p_adjust
    feats = stored(spark, ("order_feats", sf_dir, "p_brand"), lambda: src.order_feats(spark, sf_dir))
    groups = feats.select("group_id").distinct()
    y = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("acctbal"),
                                                    F.col("c_nationkey").cast("double").alias("nationkey"))
    c = correlate(feats, y, ["acctbal", "nationkey"], groups=groups, with_p=False)
    z = F.abs(F.atanh("r") * F.sqrt(F.col("n") - 3))
    c = c.select("outcome", "feat", (F.lit(2.0) / (1 + F.exp(0.07056 * z * z * z + 1.5976 * z))).alias("p"))
    return p_adjust(c, "hommel").select("outcome", "feat", rnd("p", 9).alias("p"), rnd("p_adj", 9).alias("p_adj"))
