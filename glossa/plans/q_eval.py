"""Evaluation (2.12) and classification metrics (2.11) over scored rows.

Scored rows come from the tables: y = customer account balance, predictions
= the mean balance of the customer's nation (``yhat``) and of its market
segment (``yhat_ctrl``), weights = order counts, folds = md5 k-fold.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import metrics as ME
from glossa.operators.folds import k_fold
from glossa.plans.common import rnd
from glossa.plans.registry import register
from glossa.sources import tables as src

_SCORED_SQL = """sc AS (SELECT c_custkey AS group_id, c_acctbal AS y,
  avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS yhat,
  avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS yhat_ctrl FROM customer),
ord AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS w FROM orders GROUP BY o_custkey),
fo AS (SELECT c_custkey AS group_id, CAST((row_number() OVER (ORDER BY md5('1' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS fold FROM customer),
s AS (SELECT sc.*, coalesce(ord.w, 0) AS w, fo.fold FROM sc LEFT JOIN ord ON sc.group_id = ord.o_custkey JOIN fo ON sc.group_id = fo.group_id)"""


def scored(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer")
    nat = c.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("yhat"))
    seg = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("yhat_ctrl"))
    w = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(
        F.count(F.lit(1)).cast("double").alias("w"))
    s = (c.join(F.broadcast(nat), "c_nationkey").join(F.broadcast(seg), "c_mktsegment")
         .select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"), "yhat", "yhat_ctrl"))
    folds = k_fold(s.select("group_id"), 5)
    return s.join(w, "group_id", "left").fillna(0.0, ["w"]).join(folds, "group_id")


def _r_sql(a, b):
    return (f"(count(*) * sum({a} * {b}) - sum({a}) * sum({b})) / nullif(sqrt((count(*) * sum({a} * {a}) - sum({a}) * sum({a}))"
            f" * (count(*) * sum({b} * {b}) - sum({b}) * sum({b}))), 0)")


@register("evaluate", f"""WITH {_SCORED_SQL}
SELECT round(avg(abs(y - yhat)), 6) AS mae, round(avg((y - yhat) * (y - yhat)), 6) AS mse, round({_r_sql('y', 'yhat')}, 6) AS r FROM s""")
def q_evaluate(spark, sf_dir):
    e = ME.evaluate(scored(spark, sf_dir))
    return e.select(rnd("mae").alias("mae"), rnd("mse").alias("mse"), rnd("r").alias("r"))


@register("r2", f"""WITH {_SCORED_SQL}
SELECT round(1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM s""")
def q_r2(spark, sf_dir):
    return ME.r2(scored(spark, sf_dir)).select(rnd("r2").alias("r2"))


@register("accuracy_stats", f"""WITH {_SCORED_SQL},
rk AS (SELECT y, yhat, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ra,
              rank() OVER (ORDER BY yhat) + (count(*) OVER (PARTITION BY yhat) - 1) / 2.0 AS rb FROM s),
m AS (SELECT 1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2,
             avg((y - yhat) * (y - yhat)) AS mse, avg(abs(y - yhat)) AS mae, {_r_sql('y', 'yhat')} AS r FROM s),
b AS (SELECT avg(abs(y - (SELECT avg(y) FROM s))) AS mean_baseline_mae FROM s),
sp AS (SELECT {_r_sql('ra', 'rb')} AS spearman FROM rk)
SELECT round(r2, 6) AS r2, round(CASE WHEN r2 >= 0 THEN sqrt(r2) END, 6) AS r_from_r2, round(mse, 6) AS mse, round(mae, 6) AS mae,
       round(mean_baseline_mae, 6) AS mean_baseline_mae, round(r, 6) AS r, round(spearman, 6) AS spearman FROM m, b, sp""")
def q_accuracy_stats(spark, sf_dir):
    a = ME.accuracy_stats(scored(spark, sf_dir))
    return a.select(*[rnd(c).alias(c) for c in a.columns])


@register("fold_stats", f"""WITH {_SCORED_SQL},
pf AS (SELECT fold, avg(abs(y - yhat)) AS mae, avg((y - yhat) * (y - yhat)) AS mse,
              1 - sum((y - yhat) * (y - yhat)) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM s GROUP BY fold)
SELECT round(avg(mae), 6) AS mae, round(stddev_pop(mae) / sqrt(count(*)), 6) AS se_mae,
       round(avg(mse), 6) AS mse, round(stddev_pop(mse) / sqrt(count(*)), 6) AS se_mse,
       round(avg(r2), 6) AS r2, round(stddev_pop(r2) / sqrt(count(*)), 6) AS se_r2 FROM pf""")
def q_fold_stats(spark, sf_dir):
    f = ME.fold_stats(scored(spark, sf_dir))
    return f.select(*[rnd(c).alias(c) for c in f.columns])


@register("paired_t", f"""WITH {_SCORED_SQL},
d AS (SELECT abs(y - yhat) - abs(y - yhat_ctrl) AS d FROM s)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(d) / (stddev_pop(d) / sqrt(count(*))), 6) AS t FROM d""")
def q_paired_t(spark, sf_dir):
    return ME.paired_t(scored(spark, sf_dir), "y", "yhat", "yhat_ctrl").select("n", rnd("t").alias("t"))


@register("fisher_z", f"""WITH {_SCORED_SQL},
r AS (SELECT {_r_sql('y', 'yhat')} AS r1, {_r_sql('y', 'yhat_ctrl')} AS r2, count(*) AS n FROM s),
z AS (SELECT r1, r2, (atanh(r1) - atanh(r2)) / sqrt(2.0 / (n - 3)) AS z FROM r)
SELECT round(r1, 6) AS r_full, round(r2, 6) AS r_ctrl, round(z, 6) AS z,
  round(power(((((((0.000005383 * abs(z) + 0.0000488906) * abs(z) + 0.0000380036) * abs(z) + 0.0032776263) * abs(z)
   + 0.0211410061) * abs(z) + 0.049867347) * abs(z) + 1), -16) / 2, 9) AS p1tail FROM z""")
def q_fisher_z(spark, sf_dir):
    f = ME.fisher_z(scored(spark, sf_dir), "y", "yhat", "yhat_ctrl")
    return f.select(rnd("r_full").alias("r_full"), rnd("r_ctrl").alias("r_ctrl"), rnd("z").alias("z"),
                    rnd("p1tail", 9).alias("p1tail"))


@register("weighted_eval", f"""WITH {_SCORED_SQL},
m AS (SELECT avg(y) AS my, stddev_pop(y) AS sy, avg(yhat) AS mp, stddev_pop(yhat) AS sp FROM s),
z AS (SELECT w, (y - my) / sy AS zy, (yhat - mp) / sp AS zp FROM s, m)
SELECT round(sum(w * zy * zp) / sum(w * zp * zp), 6) AS beta_w FROM z""")
def q_weighted_eval(spark, sf_dir):
    return ME.weighted_eval(scored(spark, sf_dir), "y", "yhat", "w").select(rnd("beta_w").alias("beta_w"))


@register("train_mean_mae", f"""WITH {_SCORED_SQL},
fm AS (SELECT f.fold, (SELECT avg(y) FROM s s2 WHERE s2.fold <> f.fold) AS train_mean FROM (SELECT DISTINCT fold FROM s) f)
SELECT s.fold, round(avg(abs(y - train_mean)), 6) AS train_mean_mae FROM s JOIN fm ON s.fold = fm.fold GROUP BY s.fold""")
def q_train_mean_mae(spark, sf_dir):
    """Per fold: MAE of the test fold against the mean of the training folds
    (train mean = (total - fold sum) / (total n - fold n), no self-join)."""
    s = scored(spark, sf_dir)
    per = s.groupBy("fold").agg(F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("sy"), F.sum("n")).first()
    tm = per.select("fold", ((F.lit(tot[0]) - F.col("sy")) / (F.lit(tot[1]) - F.col("n"))).alias("train_mean"))
    return (s.join(F.broadcast(tm), "fold").groupBy("fold")
            .agg(rnd(F.avg(F.abs(F.col("y") - F.col("train_mean")))).alias("train_mean_mae")))


_DESC_COLS = ("acctbal", "avg_price")
_CUST_OUT = """co AS (SELECT c.c_custkey AS group_id, c.c_acctbal AS acctbal, a.avg_price FROM customer c
  LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey)"""


@register("desc_stats", f"""WITH {_CUST_OUT},
l AS (SELECT 'acctbal' AS outcome, acctbal AS v FROM co WHERE acctbal IS NOT NULL
      UNION ALL SELECT 'avg_price', avg_price FROM co WHERE avg_price IS NOT NULL)
SELECT outcome, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS max FROM l GROUP BY outcome""")
def q_desc_stats(spark, sf_dir):
    from glossa.operators.correlate import long_outcomes
    lo = long_outcomes(src.customer_outcomes(spark, sf_dir), list(_DESC_COLS), "outcome", "v")
    return lo.groupBy("outcome").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("v")).alias("mean"), rnd(F.stddev_samp("v")).alias("sd"),
        rnd(F.min("v")).alias("min"), rnd(F.percentile("v", 0.25)).alias("p25"), rnd(F.percentile("v", 0.5)).alias("median"),
        rnd(F.percentile("v", 0.75)).alias("p75"), rnd(F.max("v")).alias("max"))


@register("hist_counts", f"""WITH {_CUST_OUT},
l AS (SELECT 'acctbal' AS outcome, acctbal AS v FROM co WHERE acctbal IS NOT NULL
      UNION ALL SELECT 'avg_price', avg_price FROM co WHERE avg_price IS NOT NULL),
mm AS (SELECT outcome, min(v) AS lo, max(v) AS hi FROM l GROUP BY outcome),
b AS (SELECT l.outcome, CAST(least(floor((v - lo) / nullif(hi - lo, 0) * 10), 9) AS INTEGER) AS bin FROM l JOIN mm USING (outcome))
SELECT outcome, bin, count(*) AS n FROM b GROUP BY outcome, bin""")
def q_hist_counts(spark, sf_dir):
    """Histogram counts (10 equal-width bins between min and max) per outcome."""
    from glossa.operators.correlate import long_outcomes
    lo = long_outcomes(src.customer_outcomes(spark, sf_dir), list(_DESC_COLS), "outcome", "v")
    mm = lo.groupBy("outcome").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = lo.join(F.broadcast(mm), "outcome").select(
        "outcome", F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 10),
                           F.lit(9)).cast("int").alias("bin"))
    return b.groupBy("outcome", "bin").agg(F.count(F.lit(1)).alias("n"))


@register("pair_values", f"""WITH {_CUST_OUT}
SELECT group_id, round(acctbal, 6) AS x, round(avg_price, 6) AS y FROM co WHERE acctbal IS NOT NULL AND avg_price IS NOT NULL""")
def q_pair_values(spark, sf_dir):
    o = src.customer_outcomes(spark, sf_dir).na.drop()
    return o.select("group_id", rnd("acctbal").alias("x"), rnd("avg_price").alias("y"))


@register("mean_est", """WITH g AS (SELECT c_custkey AS group_id, c_acctbal AS y,
  row_number() OVER (ORDER BY md5('1' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn, count(*) OVER () AS n FROM customer),
tr AS (SELECT avg(y) AS m FROM g WHERE rn > round(0.2 * n))
SELECT group_id, round((SELECT m FROM tr), 6) AS yhat, CAST(sign((SELECT m FROM tr)) AS INTEGER) AS yhat_class FROM g WHERE rn <= round(0.2 * n)""")
def q_mean_est(spark, sf_dir):
    """Mean baseline: the training mean predicted for every test group (sign when classifying)."""
    from glossa.operators.folds import train_test_split
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
    sp = train_test_split(c.select("group_id"), 0.2)
    d = c.join(sp, "group_id")
    m = d.where(F.col("split") == "train").agg(F.avg("y")).first()[0]
    return d.where(F.col("split") == "test").select("group_id", rnd(F.lit(m)).alias("yhat"),
                                                    F.signum(F.lit(m)).cast("int").alias("yhat_class"))


_ROC_SQL = """WITH d AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
per AS (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM d GROUP BY score),
t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM per),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM per)
SELECT score AS threshold, tp, fp, round(tp / (SELECT p FROM t), 9) AS tpr, round(fp / (SELECT n FROM t), 9) AS fpr FROM c"""


@register("roc_points", _ROC_SQL)
def q_roc_points(spark, sf_dir):
    """ROC points of document length as a score for the quality label."""
    d = src.table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    s = src.table(spark, sf_dir, "labels").join(d, "doc_id").select("score", F.col("quality").alias("label"))
    r = ME.roc_points(s)
    return r.select("threshold", "tp", "fp", rnd("tpr", 9).alias("tpr"), rnd("fpr", 9).alias("fpr"))


@register("confusion", """WITH d AS (SELECT CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS pred, l.quality AS label
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
a AS (SELECT count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp,
             count(*) FILTER (WHERE pred = 0 AND label = 0) AS tn, count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn FROM d)
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
  round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM a""")
def q_confusion(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("pred"))
    s = src.table(spark, sf_dir, "labels").join(d, "doc_id").select("pred", F.col("quality").alias("label"))
    c = ME.confusion(s)
    return c.select("tp", "fp", "tn", "fn", *[rnd(x).alias(x) for x in ("accuracy", "precision", "recall", "f1")])


@register("stack_preds", f"""WITH {_SCORED_SQL},
pf AS (SELECT fold, sum(y) AS sy, count(*) AS n FROM s GROUP BY fold),
t AS (SELECT sum(sy) AS ty, sum(n) AS tn FROM pf),
v AS (SELECT s.group_id, s.fold, ((SELECT ty FROM t) - pf.sy) / ((SELECT tn FROM t) - pf.n) AS pred_train_mean
      FROM s JOIN pf ON s.fold = pf.fold)
SELECT v.group_id, v.fold, round(pred_train_mean, 6) AS pred_train_mean, round(s.yhat, 6) AS pred_nation
FROM v JOIN s ON v.group_id = s.group_id""")
def q_stack_preds(spark, sf_dir):
    """Vertical stacking (union over folds) of each fold's test predictions
    (training mean), horizontally joined with a second prediction column."""
    s = scored(spark, sf_dir)
    per = s.groupBy("fold").agg(F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n"))
    tot = per.agg(F.sum("sy"), F.sum("n")).first()
    parts = None
    for k in [r["fold"] for r in per.select("fold").collect()]:       # one row per fold
        tm = per.where(F.col("fold") == k).select(((F.lit(tot[0]) - F.col("sy")) / (F.lit(tot[1]) - F.col("n"))).alias("m")).first()["m"]
        p = s.where(F.col("fold") == k).select("group_id", "fold", F.lit(tm).alias("pred_train_mean"))
        parts = p if parts is None else parts.unionByName(p)
    h = parts.join(s.select("group_id", F.col("yhat").alias("pred_nation")), "group_id")
    return h.select("group_id", "fold", rnd("pred_train_mean").alias("pred_train_mean"), rnd("pred_nation").alias("pred_nation"))


@register("control_combos", """WITH n AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS names FROM customer),
m AS (SELECT unnest(range(1, CAST(1 << len(names) AS BIGINT))) AS mask, names FROM n)
SELECT CAST(mask AS BIGINT) AS mask,
       array_to_string(list_filter(names, lambda x, i: ((mask >> (i - 1)) & 1) = 1), ',') AS controls,
       CAST(len(list_filter(names, lambda x, i: ((mask >> (i - 1)) & 1) = 1)) AS INTEGER) AS size FROM m""")
def q_control_combos(spark, sf_dir):
    """Every non-empty combination of the control names (here the market
    segments found in the data), as a power-set explode over a bitmask."""
    names = (src.table(spark, sf_dir, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("names")))
    m = names.select("names", F.explode(F.expr("sequence(1L, shiftleft(1L, size(names)) - 1L)")).alias("mask"))
    sub = F.expr("filter(names, (x, i) -> ((mask >> i) & 1) = 1)")
    return m.select("mask", F.array_join(sub, ",").alias("controls"), F.size(sub).alias("size"))
