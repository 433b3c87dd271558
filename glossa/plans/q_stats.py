"""Correlation-family queries (section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators.correlate import correlate
from glossa.operators.padjust import p_adjust
from glossa.operators.ranks import materialize
from glossa.operators.refine import feat_occ_filter
from glossa.plans import sqlfrag as S
from glossa.plans.common import doc_unigrams, rnd
from glossa.plans.q_text import _ORDER_FEATS_SQL  # noqa: F401
from glossa.plans.registry import register
from glossa.sources import tables as src


#: The occurrence filter of the flagship slice.
SLICE_SHARE = 0.05


def base_feats(spark, sf_dir, share=None):
    """(all 1-gram features, those that occur in ``share`` of the groups or, without
    a share, all again, group population).

    The feature table is written once (reliable checkpoint) and every branch
    (group count, occurrence statistics, kept rows, population) reads it,
    instead of re-tokenizing the documents per branch."""
    feats = doc_unigrams(spark, sf_dir)
    groups = feats.select("group_id").distinct()
    return feats, feats if share is None else feat_occ_filter(feats, share, n_groups=groups.count()), groups


def flagship(spark, sf_dir, with_p: bool = True, share=None):
    """1-grams per document -> occurrence filter, where a share is given -> r with
    quality / toxic (absent = 0)."""
    feats, kept, groups = base_feats(spark, sf_dir, share)
    return materialize(correlate(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], groups=groups,
                                 with_p=with_p))        # a row per feature and outcome; users read it several times


_BASE_CTES = f"""{S.feat_ctes('documents', 'doc_id')},
ff AS (SELECT * FROM f),
{S.label_outcomes_cte('y0')},
y AS (SELECT * FROM y0 WHERE group_id IN (SELECT group_id FROM f))"""

_SLICE_CTES = _BASE_CTES + f""",
ys AS (SELECT outcome, count(*) AS n, sum(y) AS sy, sum(y*y) AS syy FROM y GROUP BY outcome),
xy AS (SELECT outcome, feat, sum(group_norm) AS sx, sum(group_norm*group_norm) AS sxx,
              sum(group_norm*y) AS sxy, count(*) FILTER (WHERE group_norm > 0) AS freq
       FROM ff JOIN y USING (group_id) GROUP BY outcome, feat),
res AS (SELECT outcome, feat, {S.corr_expr()} AS r, CAST(n AS BIGINT) AS n, CAST(freq AS BIGINT) AS freq
        FROM xy JOIN ys USING (outcome))"""


@register("correlate", f"WITH {_SLICE_CTES}\nSELECT outcome, feat, round(r, 6) AS r, n, freq FROM res")
def q_correlate(spark, sf_dir):
    c = flagship(spark, sf_dir, with_p=False)
    return c.select("outcome", "feat", rnd("r").alias("r"), "n", "freq")


@register("correlate_p")
def q_correlate_p(spark, sf_dir):
    """r, t and two-tailed p (Student t, N-2 df) with BH-adjusted p."""
    c = p_adjust(flagship(spark, sf_dir), "BH")
    return c.select("outcome", "feat", rnd("r").alias("r"), "n", "freq", rnd("t").alias("t"),
                    "p", "p_adj")


# ---------------------------------------------------------------- rank / contrast statistics

_AVG_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0"


@register("spearman", f"""WITH {_BASE_CTES},
yr AS (SELECT group_id, outcome, y, {_AVG_RANK.format(p='outcome', v='y')} AS ry FROM y),
ys AS (SELECT outcome, count(*) AS n, sum(ry) AS sry, sum(ry * ry) AS sry2 FROM yr GROUP BY outcome),
xy AS (SELECT ff.feat, yr.outcome, ff.group_norm AS x, yr.ry FROM ff JOIN yr USING (group_id)),
xr AS (SELECT *, {_AVG_RANK.format(p='outcome, feat', v='x')} AS rx FROM xy),
a AS (SELECT outcome, feat, count(*) AS nnz, sum(rx) AS s1, sum(rx * rx) AS s2, sum(rx * ry) AS sxy, sum(ry) AS sy_nz
      FROM xr GROUP BY outcome, feat),
j AS (SELECT a.*, ys.n, ys.sry, ys.sry2, CAST(ys.n AS DOUBLE) - nnz AS z FROM a JOIN ys USING (outcome)),
k AS (SELECT outcome, feat, n, sry, sry2, n * (n + 1) / 2.0 AS srx,
        nnz * z * z + 2 * z * s1 + s2 + z * ((z + 1) / 2) * ((z + 1) / 2) AS srx2,
        z * sy_nz + sxy + ((z + 1) / 2) * (sry - sy_nz) AS srxy FROM j)
SELECT outcome, feat, round((n * srxy - srx * sry) / nullif(sqrt((n * srx2 - srx * srx) * (n * sry2 - sry * sry)), 0), 6) AS rho,
       CAST(n AS BIGINT) AS n FROM k""")
def q_spearman(spark, sf_dir):
    from glossa.operators.stats import spearman
    _, kept, groups = base_feats(spark, sf_dir)
    r = spearman(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], groups)
    return r.select("outcome", "feat", rnd("rho").alias("rho"), "n")


@register("auc", f"""WITH {_BASE_CTES},
ys AS (SELECT outcome, count(*) AS n, sum(y) AS n1 FROM y GROUP BY outcome),
xy AS (SELECT ff.feat, y.outcome, ff.group_norm AS x, y.y FROM ff JOIN y USING (group_id)),
xr AS (SELECT *, {_AVG_RANK.format(p='outcome, feat', v='x')} AS rx FROM xy),
a AS (SELECT outcome, feat, count(*) AS nnz, sum(rx * y) AS s_pos, sum(y) AS nnz_pos FROM xr GROUP BY outcome, feat),
j AS (SELECT a.*, ys.n, ys.n1, CAST(ys.n AS DOUBLE) - nnz AS z FROM a JOIN ys USING (outcome)),
k AS (SELECT outcome, feat, n, n1, z * nnz_pos + s_pos + (n1 - nnz_pos) * (z + 1) / 2 AS r1 FROM j)
SELECT outcome, feat, round((r1 - n1 * (n1 + 1) / 2) / nullif(n1 * (n - n1), 0), 6) AS auc, CAST(n AS BIGINT) AS n FROM k""")
def q_auc(spark, sf_dir):
    from glossa.operators.stats import auc
    _, kept, groups = base_feats(spark, sf_dir)
    r = auc(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], groups)
    return r.select("outcome", "feat", rnd("auc").alias("auc"), "n")


def _idp_sql(g1, g2):
    return f"""WITH {_BASE_CTES},
a AS (SELECT feat, sum(value) AS a FROM ff GROUP BY feat),
a0 AS (SELECT sum(value) AS a0 FROM ff),
s1 AS (SELECT feat, sum(value) AS y1 FROM ff WHERE group_id IN ({g1}) GROUP BY feat),
s2 AS (SELECT feat, sum(value) AS y2 FROM ff WHERE group_id IN ({g2}) GROUP BY feat),
n1 AS (SELECT coalesce(sum(value), 0) AS n1 FROM ff WHERE group_id IN ({g1})),
n2 AS (SELECT coalesce(sum(value), 0) AS n2 FROM ff WHERE group_id IN ({g2})),
j AS (SELECT a.feat, coalesce(y1, 0) + a AS y1a, coalesce(y2, 0) + a AS y2a FROM a
      LEFT JOIN s1 ON a.feat = s1.feat LEFT JOIN s2 ON a.feat = s2.feat),
d AS (SELECT feat, y1a, y2a, ln(y1a / ((SELECT n1 FROM n1) + (SELECT a0 FROM a0) - y1a))
        - ln(y2a / ((SELECT n2 FROM n2) + (SELECT a0 FROM a0) - y2a)) AS delta FROM j)
SELECT feat, round(delta, 6) AS delta, round(delta / sqrt(1 / y1a + 1 / y2a), 6) AS z FROM d"""


@register("idp", _idp_sql("SELECT doc_id FROM labels WHERE quality = 1", "SELECT doc_id FROM labels WHERE quality = 0"))
def q_idp(spark, sf_dir):
    from glossa.operators.stats import idp
    _, kept, _ = base_feats(spark, sf_dir)
    r = idp(kept, src.label_outcomes(spark, sf_dir), "quality")
    return r.select("feat", rnd("delta").alias("delta"), rnd("z").alias("z"))


@register("idp_samples", _idp_sql("SELECT doc_id FROM documents WHERE lang = 'en'",
                                  "SELECT doc_id FROM documents WHERE lang <> 'en'"))
def q_idp_samples(spark, sf_dir):
    """Log-odds between two explicit samples: English vs other documents."""
    from glossa.operators.stats import idp_samples
    _, kept, _ = base_feats(spark, sf_dir)
    d = src.table(spark, sf_dir, "documents")
    g1 = d.where(F.col("lang") == "en").select(F.col("doc_id").alias("group_id"))
    g2 = d.where(F.col("lang") != "en").select(F.col("doc_id").alias("group_id"))
    r = idp_samples(kept, g1, g2)
    return r.select("feat", rnd("delta").alias("delta"), rnd("z").alias("z"))


@register("zscore_group", f"""WITH {_BASE_CTES},
o AS (SELECT group_id, y AS fl FROM y WHERE outcome = 'quality'),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(fl) AS n1 FROM o),
a AS (SELECT feat, sum(group_norm) AS s, sum(group_norm * group_norm) AS s2, sum(group_norm * fl) AS s_1
      FROM ff JOIN o USING (group_id) GROUP BY feat)
SELECT feat, round((s_1 / (SELECT n1 FROM t) - s / (SELECT n FROM t))
  / nullif(sqrt(s2 / (SELECT n FROM t) - power(s / (SELECT n FROM t), 2)), 0), 6) AS z FROM a""")
def q_zscore_group(spark, sf_dir):
    from glossa.operators.stats import zscore_group
    _, kept, _ = base_feats(spark, sf_dir)
    return zscore_group(kept, src.label_outcomes(spark, sf_dir), "quality").select("feat", rnd("z").alias("z"))


_MED_SQL = """WITH {_ORDER_FEATS_SQL_REF},
ctl AS (SELECT o_custkey AS group_id, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY o_custkey),
d AS (SELECT c.c_custkey AS group_id, ctl.n_orders AS x, c.c_acctbal AS yv FROM customer c JOIN ctl ON c.c_custkey = ctl.group_id),
t AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(yv) AS sy, sum(x * x) AS sxx, sum(yv * yv) AS syy, sum(x * yv) AS sxy FROM d),
tc AS (SELECT n, sx, sy, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM t),
a AS (SELECT feat, sum(group_norm) AS sm, sum(group_norm * group_norm) AS smm, sum(group_norm * x) AS sxm,
             sum(group_norm * yv) AS smy FROM ofe JOIN d USING (group_id) GROUP BY feat),
m AS (SELECT feat, smm - sm * sm / n AS cmm, sxm - sx * sm / n AS cxm, smy - sm * sy / n AS cmy, n, cxx, cyy, cxy FROM a, tc),
p AS (SELECT *, cxm / cxx AS pa, (cxx * cmy - cxm * cxy) / nullif(cxx * cmm - cxm * cxm, 0) AS pb,
             (cmm * cxy - cxm * cmy) / nullif(cxx * cmm - cxm * cxm, 0) AS pc, cxy / cxx AS c FROM m),
q AS (SELECT *, sqrt((cmm - pa * cxm) / (n - 2) / cxx) AS se_a,
             sqrt((cyy - pb * cmy - pc * cxy) / (n - 3) * cxx / nullif(cxx * cmm - cxm * cxm, 0)) AS se_b FROM p)
SELECT feat, round(pa, 6) AS a, round(pb, 6) AS b, round(pc, 6) AS c_prime, round(c, 6) AS c,
       round(pa * pb / sqrt(pb * pb * se_a * se_a + pa * pa * se_b * se_b), 6) AS sobel_z,
       round(pa * pb / c, 6) AS prop_mediated FROM q"""


def _register_med():
    from glossa.plans.q_text import _ORDER_FEATS_SQL
    register("mediation_sobel", _MED_SQL.replace("{_ORDER_FEATS_SQL_REF}", "").replace(
        "WITH ,", "WITH " + _ORDER_FEATS_SQL + ","))(q_mediation_sobel)


def q_mediation_sobel(spark, sf_dir):
    """Each brand share as mediator between order count (X) and account balance (Y)."""
    from glossa.operators.stats import mediation_sobel
    feats = src.order_feats(spark, sf_dir)
    ctl = src.customer_controls(spark, sf_dir).select("group_id", "n_orders")
    data = (src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
            .join(ctl, "group_id").where(F.col("n_orders") > 0))
    r = mediation_sobel(feats, data, "n_orders", "y")
    return r.select("feat", *[rnd(c).alias(c) for c in ("a", "b", "c_prime", "c", "sobel_z", "prop_mediated")])
_register_med()


# ---------------------------------------------------------------- comparisons, corrections, listings


def _corr_on(spark, sf_dir, groups_df):
    feats, kept, _ = base_feats(spark, sf_dir)
    return correlate(kept, src.label_outcomes(spark, sf_dir), ["quality"], groups=groups_df, with_p=False)


def _lang_groups(spark, sf_dir, en: bool):
    d = src.table(spark, sf_dir, "documents")
    return d.where((F.col("lang") == "en") if en else (F.col("lang") != "en")).select(F.col("doc_id").alias("group_id"))


def _corr_sql(name, group_filter):
    return f"""{name}_y AS (SELECT * FROM y WHERE outcome = 'quality' AND group_id IN ({group_filter})),
{name}_ys AS (SELECT outcome, count(*) AS n, sum(y) AS sy, sum(y*y) AS syy FROM {name}_y GROUP BY outcome),
{name}_xy AS (SELECT outcome, feat, sum(group_norm) AS sx, sum(group_norm*group_norm) AS sxx, sum(group_norm*y) AS sxy
       FROM ff JOIN {name}_y USING (group_id) GROUP BY outcome, feat),
{name} AS (SELECT outcome, feat, {S.corr_expr()} AS r, n FROM {name}_xy JOIN {name}_ys USING (outcome))"""


@register("ddla_compare", f"""WITH {_BASE_CTES},
{_corr_sql('c1', "SELECT doc_id FROM documents WHERE lang = 'en'")},
{_corr_sql('c2', "SELECT doc_id FROM documents WHERE lang <> 'en'")}
SELECT coalesce(c1.outcome, c2.outcome) AS outcome, coalesce(c1.feat, c2.feat) AS feat,
  round(c1.r, 6) AS r1, round(c2.r, 6) AS r2, round(c1.r - c2.r, 6) AS delta,
  round((atanh(c1.r) - atanh(c2.r)) / sqrt(1.0 / (c1.n - 3) + 1.0 / (c2.n - 3)), 6) AS z
FROM c1 FULL OUTER JOIN c2 ON c1.outcome = c2.outcome AND c1.feat = c2.feat""")
def q_ddla_compare(spark, sf_dir):
    """Two correlation results (English vs other documents) compared per
    feature: delta r and the Fisher z of the difference (full outer join)."""
    c1 = _corr_on(spark, sf_dir, _lang_groups(spark, sf_dir, True)).select(
        "outcome", "feat", F.col("r").alias("r1"), F.col("n").alias("n1"))
    c2 = _corr_on(spark, sf_dir, _lang_groups(spark, sf_dir, False)).select(
        "outcome", "feat", F.col("r").alias("r2"), F.col("n").alias("n2"))
    j = c1.join(c2, ["outcome", "feat"], "full")
    z = (F.atanh("r1") - F.atanh("r2")) / F.sqrt(F.lit(1.0) / (F.col("n1") - 3) + F.lit(1.0) / (F.col("n2") - 3))
    return j.select("outcome", "feat", rnd("r1").alias("r1"), rnd("r2").alias("r2"),
                    rnd(F.col("r1") - F.col("r2")).alias("delta"), rnd(z).alias("z"))


_P_APPROX = ("power(((((((0.000005383 * abs(z) + 0.0000488906) * abs(z) + 0.0000380036) * abs(z) + 0.0032776263) * abs(z)"
             " + 0.0211410061) * abs(z) + 0.049867347) * abs(z) + 1), -16)")


@register("p_adjust", f"""WITH {_SLICE_CTES},
pz AS (SELECT outcome, feat, atanh(r) * sqrt(n - 3) AS z FROM res WHERE r IS NOT NULL),
p0 AS (SELECT outcome, feat, {_P_APPROX} AS p FROM pz),
o AS (SELECT *, CAST(count(*) OVER (PARTITION BY outcome) AS DOUBLE) AS m,
             CAST(row_number() OVER (PARTITION BY outcome ORDER BY p, feat) AS DOUBLE) AS i FROM p0),
h AS (SELECT outcome, sum(1.0 / i) AS hm FROM o GROUP BY outcome),
a AS (SELECT o.*, h.hm,
  least(1, m * p) AS bonferroni,
  least(1, max((m - i + 1) * p) OVER (PARTITION BY o.outcome ORDER BY p, feat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm,
  least(1, min((m - i + 1) * p) OVER (PARTITION BY o.outcome ORDER BY p, feat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS hochberg,
  least(1, min(m * p / i) OVER (PARTITION BY o.outcome ORDER BY p, feat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh,
  least(1, min(h.hm * m * p / i) OVER (PARTITION BY o.outcome ORDER BY p, feat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS by_
  FROM o JOIN h ON o.outcome = h.outcome)
SELECT outcome, feat, round(p, 9) AS p, round(bonferroni, 9) AS bonferroni, round(holm, 9) AS holm,
  round(hochberg, 9) AS hochberg, round(bh, 9) AS bh, round(by_, 9) AS by_ FROM a""")
def q_p_adjust(spark, sf_dir):
    """Corrections of per-feature p-values (normal approximation of the Fisher
    z of r, so the oracle can compute them): bonferroni, holm, hochberg, BH, BY."""
    from glossa.operators.stats import normal_p2_approx
    c = flagship(spark, sf_dir, with_p=False).where(F.col("r").isNotNull())
    c = c.withColumn("p", normal_p2_approx(F.atanh("r") * F.sqrt(F.col("n") - 3))).select("outcome", "feat", "p")
    from glossa.operators.padjust import p_adjust_many
    c = p_adjust_many(c, {"bonferroni": "bonferroni", "holm": "holm", "hochberg": "hochberg", "bh": "BH", "by_": "BY"})
    return c.select("outcome", "feat", *[rnd(x, 9).alias(x) for x in ("p", "bonferroni", "holm", "hochberg", "bh", "by_")])


@register("corr_ci", f"""WITH {_SLICE_CTES}
SELECT outcome, feat, round(r, 6) AS r, n, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_lo,
       round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_hi FROM res""")
def q_corr_ci(spark, sf_dir):
    from glossa.operators.correlate import corr_ci
    c = corr_ci(flagship(spark, sf_dir, with_p=False))
    return c.select("outcome", "feat", rnd("r").alias("r"), "n", rnd("ci_lo").alias("ci_lo"), rnd("ci_hi").alias("ci_hi"))


@register("rmatrix", f"""WITH {_SLICE_CTES}
SELECT feat, round(max(CASE WHEN outcome = 'quality' THEN r END), 6) AS quality,
       round(max(CASE WHEN outcome = 'toxic' THEN r END), 6) AS toxic FROM res GROUP BY feat""")
def q_rmatrix(spark, sf_dir):
    """Feature x outcome matrix of r (bounded pivot over the outcome list)."""
    from glossa.operators.align import densify
    c = flagship(spark, sf_dir, with_p=False)
    m = densify(c, "feat", "outcome", "r", values=["quality", "toxic"])
    return m.select("feat", rnd("quality").alias("quality"), rnd("toxic").alias("toxic"))


@register("apply_labelmap", f"""WITH {_SLICE_CTES},
lm AS (SELECT term, min(category) AS label FROM {src.lexicon_values_sql()} GROUP BY term)
SELECT outcome, res.feat, coalesce('[' || lm.label || ']', res.feat) AS feat_label, round(r, 6) AS r
FROM res LEFT JOIN lm ON res.feat = lm.term""")
def q_apply_labelmap(spark, sf_dir):
    """Feature ids replaced by bracketed labels from a label map (lexicon term -> category)."""
    c = flagship(spark, sf_dir, with_p=False)
    lm = src.lexicon(spark).groupBy(F.col("term").alias("feat")).agg(F.min("category").alias("label"))
    j = c.join(lm, "feat", "left")
    return j.select("outcome", "feat", F.coalesce(F.concat(F.lit("["), "label", F.lit("]")), F.col("feat")).alias("feat_label"),
                    rnd("r").alias("r"))


@register("ttest_feats", f"""WITH {S.feat_ctes("(SELECT * FROM documents WHERE lang = 'en')", 'source', 1, 'fa')},
{S.feat_ctes("(SELECT * FROM documents WHERE lang <> 'en')", 'source', 1, 'fb')},
ng AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT group_id FROM fa UNION SELECT group_id FROM fb)),
d AS (SELECT coalesce(fa.feat, fb.feat) AS feat, coalesce(fa.group_norm, 0) - coalesce(fb.group_norm, 0) AS d
      FROM fa FULL OUTER JOIN fb ON fa.group_id = fb.group_id AND fa.feat = fb.feat),
s AS (SELECT feat, sum(d) AS s1, sum(d * d) AS s2 FROM d GROUP BY feat)
SELECT feat, round(s1 / (SELECT n FROM ng), 9) AS mean_diff,
  round((s1 / (SELECT n FROM ng)) / nullif(sqrt((s2 - s1 * s1 / (SELECT n FROM ng)) / ((SELECT n FROM ng) - 1)) / sqrt((SELECT n FROM ng)), 0), 6) AS t
FROM s""")
def q_ttest_feats(spark, sf_dir):
    """Paired t per feature between two feature tables over the same groups
    (sources): English documents vs documents in other languages."""
    from glossa.operators.stats import ttest_feats
    from glossa.operators.feats import ngram_feats
    d = src.table(spark, sf_dir, "documents")
    def msgs(cond):
        return d.where(cond).select(F.col("doc_id").alias("message_id"), F.col("source").alias("group_id"),
                                    F.col("text").alias("message"))
    a = ngram_feats(msgs(F.col("lang") == "en"), 1)
    b = ngram_feats(msgs(F.col("lang") != "en"), 1)
    return ttest_feats(a, b).select("feat", rnd("mean_diff", 9).alias("mean_diff"), rnd("t").alias("t"))


_PAIR_SQL = """SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr_r, 6) AS r, n FROM (
  SELECT (count(*) * sum(a * b) - sum(a) * sum(b)) / nullif(sqrt((count(*) * sum(a * a) - sum(a) * sum(a)) * (count(*) * sum(b * b) - sum(b) * sum(b))), 0) AS corr_r,
         count(*) AS n FROM (SELECT {a} AS a, {b} AS b FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""


def _doc_wide(spark, sf_dir):
    from glossa.plans.common import doc_wide
    return doc_wide(spark, sf_dir)


def _wide_sql():
    from glossa.plans.common import _DOC_WIDE
    return _DOC_WIDE


@register("outcome_corr", "WITH " + _wide_sql() + "\n" + "\nUNION ALL\n".join(
    _PAIR_SQL.format(a=a, b=b) for a, b in (("n_chars", "quality"), ("n_chars", "toxic"), ("quality", "toxic"))))
def q_outcome_corr(spark, sf_dir):
    """Outcome-with-outcome correlations, pairwise complete, one aggregate."""
    from glossa.operators.stats import pairwise_corr
    r = pairwise_corr(_doc_wide(spark, sf_dir), ["n_chars", "quality", "toxic"])
    return r.select("var_a", "var_b", rnd("r").alias("r"), "n")


@register("corrwith", "WITH " + _wide_sql() + "\n" + "\nUNION ALL\n".join(
    _PAIR_SQL.format(a="n_chars", b=b) for b in ("quality", "toxic")))
def q_corrwith(spark, sf_dir):
    """Each label column correlated with one control (document length)."""
    from glossa.operators.stats import pairwise_corr
    r = pairwise_corr(_doc_wide(spark, sf_dir), ["n_chars", "quality", "toxic"]).where(F.col("var_a") == "n_chars")
    return r.select("var_a", "var_b", rnd("r").alias("r"), "n")


@register("topic_dupe_filter", f"""WITH st AS (SELECT doc_id AS group_id, unnest({S.tokens()}) AS token FROM documents),
tc AS (SELECT group_id, CAST(length(token) % 8 AS VARCHAR) AS feat, count(*) AS value FROM st GROUP BY group_id, feat),
tf AS (SELECT group_id, feat, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM tc),
{S.label_outcomes_cte('y')},
yq AS (SELECT * FROM y WHERE outcome = 'quality' AND group_id IN (SELECT group_id FROM tf)),
ys AS (SELECT count(*) AS n, sum(y) AS sy, sum(y*y) AS syy FROM yq),
xy AS (SELECT feat, sum(group_norm) AS sx, sum(group_norm*group_norm) AS sxx, sum(group_norm*y) AS sxy FROM tf JOIN yq USING (group_id) GROUP BY feat),
rr AS (SELECT feat, {S.corr_expr()} AS r FROM xy, ys),
wc AS (SELECT CAST(length(token) % 8 AS VARCHAR) AS topic, token AS term, count(*) AS c FROM st GROUP BY topic, term),
tw AS (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY c DESC, term) AS rk FROM wc),
top AS (SELECT topic, term FROM tw WHERE rk <= 10),
ov AS (SELECT DISTINCT a.topic AS t1, b.topic AS t2 FROM top a JOIN top b ON a.term = b.term AND a.topic <> b.topic),
dr AS (SELECT ov.t1 FROM ov JOIN rr r1 ON ov.t1 = r1.feat JOIN rr r2 ON ov.t2 = r2.feat
       WHERE abs(r2.r) > abs(r1.r) OR (abs(r2.r) = abs(r1.r) AND ov.t2 < ov.t1))
SELECT feat, round(r, 6) AS r FROM rr WHERE feat NOT IN (SELECT t1 FROM dr)""")
def q_topic_dupe_filter(spark, sf_dir):
    """Drop topics that share a top-10 word with a more strongly correlated topic."""
    from glossa.operators.feats import topic_feats, topic_states
    from glossa.operators.ranks import top_k_per_key
    msgs = src.messages_by_doc(spark, sf_dir)
    st = topic_states(msgs)
    tf = topic_feats(st)
    r = correlate(tf, src.label_outcomes(spark, sf_dir), ["quality"], with_p=False).select("feat", "r")
    wc = st.groupBy(F.col("topic").cast("string").alias("topic"), F.col("token").alias("term")).agg(F.count(F.lit(1)).alias("c"))
    top = top_k_per_key(wc, "topic", [F.col("c").desc(), F.col("term")], 10, salt_col="term").select("topic", "term")
    ov = (top.alias("a").join(top.alias("b"), (F.col("a.term") == F.col("b.term")) & (F.col("a.topic") != F.col("b.topic")))
          .select(F.col("a.topic").alias("t1"), F.col("b.topic").alias("t2")).distinct())
    r1, r2 = r.select(F.col("feat").alias("t1"), F.col("r").alias("r1")), r.select(F.col("feat").alias("t2"), F.col("r").alias("r2"))
    drop = (ov.join(r1, "t1").join(r2, "t2")
            .where((F.abs("r2") > F.abs("r1")) | ((F.abs("r2") == F.abs("r1")) & (F.col("t2") < F.col("t1"))))
            .select(F.col("t1").alias("feat")))
    return r.join(drop, "feat", "left_anti").select("feat", rnd("r").alias("r"))


@register("correlate_controls", f"""WITH {_BASE_CTES},
c AS (SELECT doc_id AS group_id, CAST(n_chars AS DOUBLE) AS c FROM documents),
yc AS (SELECT y.*, c.c FROM y JOIN c USING (group_id)),
ys AS (SELECT outcome, CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y*y) AS syy, sum(c) AS sc, sum(c*c) AS scc, sum(c*y) AS scy
       FROM yc GROUP BY outcome),
xy AS (SELECT outcome, feat, sum(group_norm) AS sx, sum(group_norm*group_norm) AS sxx, sum(group_norm*y) AS sxy,
              sum(group_norm*c) AS sxc FROM ff JOIN yc USING (group_id) GROUP BY outcome, feat),
k AS (SELECT outcome, feat, n, {S.corr_expr()} AS rxy, {S.corr_expr(sy='sc', syy='scc', sxy='sxc')} AS rxc,
             {S.corr_expr(sx='sc', sxx='scc', sxy='scy')} AS ryc FROM xy JOIN ys USING (outcome))
SELECT outcome, feat, round((rxy - rxc * ryc) / sqrt((1 - rxc * rxc) * (1 - ryc * ryc)), 6) AS r,
       CAST(n AS BIGINT) AS n FROM k""")
def q_correlate_controls(spark, sf_dir):
    """Partial r of each feature with quality / toxic given document length."""
    from glossa.operators.correlate import correlate_controls
    _, kept, groups = base_feats(spark, sf_dir)
    ctl = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("group_id"), F.col("n_chars").cast("double").alias("n_chars"))
    r = correlate_controls(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], ctl, ["n_chars"], groups, with_p=False)
    return r.select("outcome", "feat", rnd("r").alias("r"), "n")


@register("correlate_controls_p")
def q_correlate_controls_p(spark, sf_dir):
    """Partial r, standardized partial beta, t and p with two controls."""
    from glossa.operators.correlate import correlate_controls
    _, kept, groups = base_feats(spark, sf_dir)
    d = src.table(spark, sf_dir, "documents")
    ctl = d.select(F.col("doc_id").alias("group_id"), F.col("n_chars").cast("double").alias("n_chars"),
                   (F.col("lang") == "en").cast("double").alias("is_en"))
    return correlate_controls(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], ctl, ["n_chars", "is_en"], groups)


@register("correlate_summary")
def q_correlate_summary(spark, sf_dir):
    """Correlations sorted by |r| per outcome with the number of features
    below the p threshold (0.05, BH-adjusted)."""
    from glossa.operators.stats_listing import correlate_summary
    return correlate_summary(p_adjust(flagship(spark, sf_dir), "BH"), 0.05)


@register("tagcloud_data")
def q_tagcloud_data(spark, sf_dir):
    """Top 15 positive and negative significant features per outcome (p < .05),
    with n-grams contained in a stronger n-gram of the same sign dropped."""
    from glossa.operators.stats_listing import tagcloud_data
    from glossa.operators.refine import feat_occ_filter as occ
    feats = doc_unigrams(spark, sf_dir).unionByName(doc_unigrams(spark, sf_dir, 2))    # both tables are written once
    groups = materialize(feats.select("group_id").distinct())
    kept = occ(feats, 0.05, n_groups=groups.count())
    c = correlate(kept, src.label_outcomes(spark, sf_dir), ["quality", "toxic"], groups=groups)
    return tagcloud_data(c, 15, 0.05)


# ---------------------------------------------------------------- per-feature models (rows-only)


@register("logistic_per_feat")
def q_logistic_per_feat(spark, sf_dir):
    """Per-feature logistic regression of quality on the feature (IRLS, absent = 0)."""
    from glossa.operators.stats_models import logistic_per_feat
    _, kept, groups = base_feats(spark, sf_dir)
    return logistic_per_feat(kept, src.label_outcomes(spark, sf_dir), "quality", groups)


def _doc_frame_en(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("group_id"),
                                                    (F.col("lang") == "en").cast("double").alias("is_en"))
    return src.label_outcomes(spark, sf_dir).join(d, "group_id")


@register("interaction")
def q_interaction(spark, sf_dir):
    """Interaction of each feature with the English flag on quality: b3, se, t, p."""
    from glossa.operators.stats_models import interaction
    _, kept, _ = base_feats(spark, sf_dir)
    return interaction(kept, _doc_frame_en(spark, sf_dir), "quality", "is_en")


@register("ddla_groups")
def q_ddla_groups(spark, sf_dir):
    """Differential analysis: features whose interaction with the English flag
    is significant (p < .001), then their correlations with quality computed
    separately for English and other documents."""
    from glossa.operators.stats_models import interaction
    _, kept, _ = base_feats(spark, sf_dir)
    fr = _doc_frame_en(spark, sf_dir)
    sig = materialize(interaction(kept, fr, "quality", "is_en").where(F.col("p") < 0.001).select("feat"))
    wl = kept.join(sig, "feat", "left_semi")
    # both sides in one pass over the features: the label of the documents of a side is its outcome
    sides = fr.groupBy("group_id").agg(*[F.max(F.col("is_en") == f).alias(k) for k, f in (("english", 1.0), ("other", 0.0))])
    lab = src.label_outcomes(spark, sf_dir).join(sides, "group_id").select("group_id", *[F.when(F.col(k), F.col("quality")).alias(k) for k in ("english", "other")])
    c = correlate(wl, lab, ["english", "other"], groups=sides.select("group_id"))
    return c.select(F.lit("quality").alias("outcome"), "feat", "r", "n", "freq", "t", "p",
                    F.when(F.col("outcome") == "english", 1.0).otherwise(0.0).alias("is_en"))


@register("combo_rmatrix")
def q_combo_rmatrix(spark, sf_dir):
    """Correlations of every feature with quality for each combination of the
    controls (none, length, English flag, both)."""
    from glossa.operators.correlate import correlate_controls
    _, kept, groups = base_feats(spark, sf_dir)
    d = src.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("group_id"), F.col("n_chars").cast("double").alias("n_chars"),
        (F.col("lang") == "en").cast("double").alias("is_en"))
    lab = src.label_outcomes(spark, sf_dir)
    out = correlate(kept, lab, ["quality"], groups=groups, with_p=True).select(
        F.lit("").alias("controls"), "outcome", "feat", "r", "n", "p")
    for combo in (["n_chars"], ["is_en"], ["n_chars", "is_en"]):
        c = correlate_controls(kept, lab, ["quality"], d, combo, groups).select(
            F.lit(",".join(combo)).alias("controls"), "outcome", "feat", "r", "n", "p")
        out = out.unionByName(c)
    return out


@register("mediation_boot")
def q_mediation_boot(spark, sf_dir):
    """Bootstrap (Poisson weights, 1,000 replicates) of the indirect effect of
    each brand share between order count and account balance."""
    from glossa.operators.stats_models import mediation_boot
    feats = src.order_feats(spark, sf_dir)
    ctl = src.customer_controls(spark, sf_dir).select("group_id", "n_orders")
    data = (src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
            .join(ctl, "group_id").where(F.col("n_orders") > 0))
    return mediation_boot(feats, data, "n_orders", "y", reps=1000)


@register("correl_filter")
def q_correl_filter(spark, sf_dir):
    """Feature rows kept because the feature correlates with quality or toxic
    at p < .05 (correlate + threshold + semi-join)."""
    c = flagship(spark, sf_dir).where(F.col("p") < 0.05).select("feat").distinct()
    _, kept, _ = base_feats(spark, sf_dir)
    return kept.join(c, "feat", "left_semi")


@register("t_pvalue")
def q_t_pvalue(spark, sf_dir):
    """Two-tailed Student-t p of each correlation (N - 2 degrees of freedom)."""
    from glossa.functions.dist import t_pvalue
    c = flagship(spark, sf_dir, with_p=False)
    return c.select("outcome", "feat", "t", (F.col("n") - 2).alias("df"),
                    t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")).alias("p"))


@register("auc_boot")
def q_auc_boot(spark, sf_dir):
    """AUC of each feature for both labels with a Poisson-weight bootstrap p (1,000 replicates)."""
    from glossa.operators.stats_models import auc_boot
    _, kept, groups = base_feats(spark, sf_dir)
    lab = src.label_outcomes(spark, sf_dir)
    return auc_boot(kept, lab, "quality", groups, reps=1000).unionByName(auc_boot(kept, lab, "toxic", groups, reps=1000))
