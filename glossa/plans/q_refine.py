"""Filters and predicates (2.2), refinement and scaling (2.8), aggregations
(2.4) and scalar functions (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import feats as FE
from glossa.operators import refine as R
from glossa.operators import scalar as SC
from glossa.operators.ranks import materialize
from glossa.plans import sqlfrag as S
from glossa.plans.common import _DOC_WIDE, doc_wide, rnd, doc_unigrams, source_unigrams
from glossa.plans.q_stats import _SLICE_CTES, flagship
from glossa.plans.q_text import _FEAT_SEL, _ORDER_FEATS_SQL, _feat_out, _lex_terms_sql
from glossa.plans.registry import register
from glossa.sources import tables as src

# ---------------------------------------------------------------- helpers


_WCOLS = ["n_chars", "quality", "toxic"]


def _cust_ctl_sql():
    segs = ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS seg_{s.lower()}" for s in src.SEGMENTS)
    return f"""ctl AS (SELECT c.c_custkey AS group_id, {segs}, CAST(c.c_nationkey AS DOUBLE) AS nationkey,
  coalesce(o.n, 0.0) AS n_orders FROM customer c
  LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""


CTL_COLS = [f"seg_{s.lower()}" for s in src.SEGMENTS] + ["nationkey", "n_orders"]

# ---------------------------------------------------------------- 2.2


@register("outlier_filter", "SELECT event_id, user_id, value FROM events WHERE abs(value) < 20")
def q_outlier_filter(spark, sf_dir):
    ev = src.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return SC.outlier_filter(ev, "value", 20.0)


@register("into_classes", """
SELECT c_custkey AS group_id, CAST(CASE WHEN abs(c_acctbal / 1000) <= 1 THEN 0
  WHEN c_acctbal / 1000 < -1 THEN -1 ELSE 1 END AS INTEGER) AS cls FROM customer""")
def q_into_classes(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("group_id"), SC.into_classes(F.col("c_acctbal") / 1000).alias("cls"))


@register("group_freq_thresh", f"""WITH {S.feat_ctes('documents', 'doc_id')}
{_FEAT_SEL} FROM f WHERE group_id IN (SELECT group_id FROM f GROUP BY group_id HAVING sum(value) > 500)""")
def q_group_freq_thresh(spark, sf_dir):
    return _feat_out(R.group_freq_thresh(doc_unigrams(spark, sf_dir), 500))


_WHERE = "lang = 'en' AND n_chars > 1000"


@register("groups_where", f"""WITH {S.feat_ctes('documents', 'doc_id')}
{_FEAT_SEL} FROM f WHERE group_id IN (SELECT doc_id FROM documents WHERE {_WHERE})""")
def q_groups_where(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    groups = src.table(spark, sf_dir, "documents").where(F.expr(_WHERE)).select(F.col("doc_id").alias("group_id"))
    return _feat_out(feats.join(groups, "group_id", "left_semi"))


@register("restrict_groups", """
SELECT 'acctbal' AS outcome, c_custkey AS group_id, round(c_acctbal, 6) AS y FROM customer WHERE c_nationkey < 10
UNION ALL
SELECT 'avg_price', o_custkey, round(avg(o_totalprice), 6) FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY o_custkey""")
def q_restrict_groups(spark, sf_dir):
    """One group set per outcome: semi-join on (outcome, group_id)."""
    from glossa.operators.correlate import long_outcomes
    y = long_outcomes(src.customer_outcomes(spark, sf_dir), ["acctbal", "avg_price"])
    c = src.table(spark, sf_dir, "customer")
    sets = (c.where(F.col("c_nationkey") < 10).select(F.lit("acctbal").alias("outcome"), F.col("c_custkey").alias("group_id"))
            .unionByName(c.where(F.col("c_mktsegment") == "MACHINERY")
                         .select(F.lit("avg_price").alias("outcome"), F.col("c_custkey").alias("group_id"))))
    return y.join(sets, ["outcome", "group_id"], "left_semi").select("outcome", "group_id", rnd("y").alias("y"))


@register("white_blacklist", f"""WITH {S.feat_ctes('documents', 'source')}
SELECT 'white' AS mode, group_id, feat, round(value, 6) AS value, round(group_norm, 6) AS group_norm
FROM f WHERE feat IN ({_lex_terms_sql()})
UNION ALL
SELECT 'black', group_id, feat, round(value, 6), round(group_norm, 6) FROM f WHERE feat NOT IN ({_lex_terms_sql()})""")
def q_white_blacklist(spark, sf_dir):
    feats = source_unigrams(spark, sf_dir)
    terms = src.lexicon(spark).where(F.col("term") != "_intercept").select(F.col("term").alias("feat"))
    w = _feat_out(R.white_blacklist(feats, terms, "white")).withColumn("mode", F.lit("white"))
    b = _feat_out(R.white_blacklist(feats, terms, "black")).withColumn("mode", F.lit("black"))
    return w.unionByName(b).select("mode", "group_id", "feat", "value", "group_norm")


@register("drop_null_cols", f"WITH {_DOC_WIDE} SELECT group_id, n_chars FROM w")
def q_drop_null_cols(spark, sf_dir):
    return SC.drop_null_cols(doc_wide(spark, sf_dir), _WCOLS)


@register("drop_null_rows", f"WITH {_DOC_WIDE} SELECT * FROM w WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def q_drop_null_rows(spark, sf_dir):
    return doc_wide(spark, sf_dir).na.drop("any")


@register("fill_mean", f"""WITH {_DOC_WIDE}
SELECT group_id, n_chars, round(coalesce(quality, (SELECT avg(quality) FROM w)), 6) AS quality,
       round(coalesce(toxic, (SELECT avg(toxic) FROM w)), 6) AS toxic FROM w""")
def q_fill_mean(spark, sf_dir):
    d = SC.fill_mean(doc_wide(spark, sf_dir), _WCOLS)
    return d.select("group_id", "n_chars", rnd("quality").alias("quality"), rnd("toxic").alias("toxic"))


@register("outcome_feats", """WITH o AS (
  SELECT c.c_custkey AS group_id, c.c_acctbal AS acctbal, a.avg_price FROM customer c
  LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey),
l AS (SELECT group_id, 'acctbal' AS feat, acctbal AS value FROM o WHERE acctbal IS NOT NULL
      UNION ALL SELECT group_id, 'avg_price', avg_price FROM o WHERE avg_price IS NOT NULL)
SELECT group_id, feat, round(value, 6) AS value, round(value, 6) AS group_norm FROM l""")
def q_outcome_feats(spark, sf_dir):
    from glossa.operators.correlate import long_outcomes
    y = long_outcomes(src.customer_outcomes(spark, sf_dir), ["acctbal", "avg_price"], "feat", "value")
    return _feat_out(y.withColumn("group_norm", F.col("value")))


@register("num_groups", f"""WITH {_DOC_WIDE}
SELECT 'n_chars' AS outcome, count(n_chars) AS n_groups FROM w
UNION ALL SELECT 'quality', count(quality) FROM w UNION ALL SELECT 'toxic', count(toxic) FROM w""")
def q_num_groups(spark, sf_dir):
    d = doc_wide(spark, sf_dir)
    a = d.agg(*[F.count(c).alias(c) for c in _WCOLS])
    stack = "stack(3, " + ", ".join(f"'{c}', {c}" for c in _WCOLS) + ") as (outcome, n_groups)"
    return a.select(F.expr(stack))


@register("c2r_keep", """WITH c AS (
  SELECT c_custkey, CASE WHEN abs(c_acctbal / 1000) <= 1 THEN 0 WHEN c_acctbal / 1000 < -1 THEN -1 ELSE 1 END AS cls
  FROM customer),
p AS (SELECT o_custkey, avg(o_totalprice) AS pred FROM orders GROUP BY o_custkey)
SELECT c.c_custkey AS group_id, round(CASE WHEN c.cls IN (1, -1) THEN coalesce(p.pred, 0) ELSE 0 END, 6) AS pred
FROM c LEFT JOIN p ON c.c_custkey = p.o_custkey""")
def q_c2r_keep(spark, sf_dir):
    """Keep the regression prediction where the classifier says 1 or -1, else 0."""
    c = src.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("group_id"), SC.into_classes(F.col("c_acctbal") / 1000).alias("cls"))
    p = src.customer_outcomes(spark, sf_dir).select("group_id", F.col("avg_price").alias("pred"))
    j = c.join(p, "group_id", "left")
    return j.select("group_id", rnd(F.when(F.col("cls").isin(1, -1), F.coalesce("pred", F.lit(0.0)))
                                    .otherwise(F.lit(0.0))).alias("pred"))

# ---------------------------------------------------------------- 2.8


@register("pmi_filter", f"""WITH {S.feat_ctes('documents', 'source', 1, 'w')},
{S.feat_ctes('documents', 'source', 2, 'b')},
t1 AS (SELECT sum(value) AS t1 FROM w),
cw AS (SELECT feat, sum(value) AS cw FROM w GROUP BY feat),
cb AS (SELECT feat, sum(value) AS c FROM b GROUP BY feat),
tb AS (SELECT sum(c) AS tn FROM cb),
parts AS (SELECT feat, c, unnest(string_split(feat, ' ')) AS wd FROM cb),
pm AS (SELECT parts.feat, ln(parts.c / (SELECT tn FROM tb)) - (sum(ln(cw.cw)) - 2 * ln((SELECT t1 FROM t1))) AS pmi
       FROM parts JOIN cw ON parts.wd = cw.feat GROUP BY parts.feat, parts.c HAVING count(*) = 2)
{_FEAT_SEL} FROM (SELECT * FROM w UNION ALL SELECT * FROM b WHERE feat IN (SELECT feat FROM pm WHERE pmi >= 3))""")
def q_pmi_filter(spark, sf_dir):
    words = source_unigrams(spark, sf_dir)          # both tables are written once and read several times
    both = words.unionByName(source_unigrams(spark, sf_dir, 2))
    return _feat_out(R.pmi_filter(both, words, 3.0))


@register("feat_norms", f"""WITH {S.feat_ctes('documents', 'doc_id')},
ng AS (SELECT count(DISTINCT group_id) AS n FROM f),
keep AS (SELECT feat FROM f GROUP BY feat HAVING count(*) >= 0.05 * (SELECT n FROM ng)),
ff AS (SELECT * FROM f WHERE feat IN (SELECT feat FROM keep)),
mo AS (SELECT feat, sum(group_norm) / (SELECT n FROM ng) AS mean,
              sqrt(sum(group_norm * group_norm) / (SELECT n FROM ng) - power(sum(group_norm) / (SELECT n FROM ng), 2)) AS sd
       FROM ff GROUP BY feat)
SELECT group_id, ff.feat, round(group_norm, 6) AS group_norm, round((group_norm - mean) / nullif(sd, 0), 6) AS feat_norm
FROM ff JOIN mo ON ff.feat = mo.feat""")
def q_feat_norms(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    n = feats.select("group_id").distinct().count()
    kept = R.feat_occ_filter(feats, 0.05, n_groups=n)
    out = R.feat_norms(kept, n_groups=n)
    return out.select("group_id", "feat", rnd("group_norm").alias("group_norm"), rnd("feat_norm").alias("feat_norm"))


def _mm_sql(c, keep_null_const=False):
    const = "NULL" if keep_null_const else f"CASE WHEN {c} IS NOT NULL THEN 0.0 END"
    return (f"round(CASE WHEN (SELECT max({c}) FROM w) = (SELECT min({c}) FROM w) THEN {const} "
            f"ELSE ({c} - (SELECT min({c}) FROM w)) / ((SELECT max({c}) FROM w) - (SELECT min({c}) FROM w)) END, 6) AS {c}")


@register("minmax", f"WITH {_DOC_WIDE} SELECT group_id, {', '.join(_mm_sql(c) for c in _WCOLS)} FROM w")
def q_minmax(spark, sf_dir):
    d = SC.minmax(doc_wide(spark, sf_dir), _WCOLS)
    return d.select("group_id", *[rnd(c).alias(c) for c in _WCOLS])


@register("minmax_drop", f"WITH {_DOC_WIDE} SELECT group_id, {_mm_sql('n_chars', True)} FROM w")
def q_minmax_drop(spark, sf_dir):
    d = SC.minmax_drop(doc_wide(spark, sf_dir), _WCOLS)
    return d.select("group_id", *[rnd(c).alias(c) for c in d.columns if c != "group_id"])


def _std_sql(c):
    return f"round(({c} - (SELECT avg({c}) FROM w2)) / nullif((SELECT stddev_pop({c}) FROM w2), 0), 6) AS {c}"


@register("standardize", f"""WITH {_DOC_WIDE},
w2 AS (SELECT group_id, {', '.join(f'coalesce({c}, (SELECT avg({c}) FROM w)) AS {c}' for c in _WCOLS)} FROM w)
SELECT group_id, {', '.join(_std_sql(c) for c in _WCOLS)} FROM w2""")
def q_standardize(spark, sf_dir):
    d = SC.standardize(doc_wide(spark, sf_dir), _WCOLS)
    return d.select("group_id", *[rnd(c).alias(c) for c in _WCOLS])


@register("transformation", """
SELECT c_custkey AS group_id, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
  / (SELECT var_samp(c_acctbal) FROM customer), 9) AS acctbal FROM customer""")
def q_transformation(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("acctbal"))
    d, _ = SC.transformation(c, "acctbal")
    return d.select("group_id", rnd("acctbal", 9).alias("acctbal"))


_F_SQL = "r * r / nullif(1 - r * r, 0) * (n - 2)"


@register("select_fwe", f"""WITH {_SLICE_CTES}
SELECT outcome, feat, round({_F_SQL}, 6) AS f, n FROM res""")
def q_select_fwe(spark, sf_dir):
    """Univariate F statistic per (outcome, feature): ``F = r^2/(1-r^2)*(n-2)``."""
    from glossa.operators.select import f_stats
    c = f_stats(flagship(spark, sf_dir, with_p=False))
    return c.select("outcome", "feat", rnd("f").alias("f"), "n")


@register("select_kbest", f"""WITH {_SLICE_CTES},
fs AS (SELECT outcome, feat, r * r / nullif(1 - r * r, 0) * (n - 2) AS f FROM res),
rk AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY f DESC NULLS LAST, feat) AS rank FROM fs)
SELECT outcome, feat, round(f, 6) AS f, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 50""")
def q_select_kbest(spark, sf_dir):
    from glossa.operators.select import f_stats
    from glossa.operators.ranks import top_k_per_key
    c = f_stats(flagship(spark, sf_dir, with_p=False))
    top = top_k_per_key(c, "outcome", [F.col("f").desc_nulls_last(), F.col("feat")], 50, salt_col="feat")
    return top.select("outcome", "feat", rnd("f").alias("f"), "rank")


@register("select_fwe_keep")
def q_select_fwe_keep(spark, sf_dir):
    """Features kept by the family-wise test ``p < alpha / m`` (alpha = 60)."""
    from glossa.operators.select import select_fwe
    return select_fwe(flagship(spark, sf_dir, with_p=False), alpha=60.0)


@register("fwe_sweep")
def q_fwe_sweep(spark, sf_dir):
    from glossa.operators.select import fwe_sweep
    return fwe_sweep(flagship(spark, sf_dir, with_p=False))

# ---------------------------------------------------------------- 2.4


@register("aggregate_group", f"""WITH {S.feat_ctes('documents', 'doc_id')},
c AS (SELECT d.source AS group_id, f.feat, sum(f.value) AS value FROM f JOIN documents d ON f.group_id = d.doc_id
      GROUP BY d.source, f.feat)
{_FEAT_SEL} FROM (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM c)""")
def q_aggregate_group(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    mapping = src.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("group_id"),
                                                           F.col("source").alias("new_group_id"))
    return _feat_out(R.aggregate_by_new_group(feats, mapping))


@register("group_by_outcome", f"""WITH {S.feat_ctes('documents', 'doc_id')},
o AS (SELECT doc_id AS group_id, CAST(quality AS DOUBLE) AS outcome_value FROM labels WHERE quality IS NOT NULL),
sz AS (SELECT outcome_value, count(*) AS n FROM o GROUP BY outcome_value),
a AS (SELECT outcome_value, feat, sum(value) AS value, sum(group_norm) AS gn FROM f JOIN o USING (group_id)
      GROUP BY outcome_value, feat)
SELECT a.outcome_value, feat, round(value, 6) AS value, round(gn / n, 6) AS group_norm FROM a JOIN sz USING (outcome_value)""")
def q_group_by_outcome(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    g = R.group_by_outcome(feats, src.label_outcomes(spark, sf_dir), "quality")
    return g.select("outcome_value", "feat", rnd("value").alias("value"), rnd("group_norm").alias("group_norm"))


@register("combine_feats", f"""WITH {S.feat_ctes('documents', 'source', 1, 'w')},
cw AS (SELECT source AS group_id, unnest({S.tokens()}) AS w FROM documents),
cg AS (SELECT group_id, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) AS feat FROM cw),
cc AS (SELECT group_id, feat, CAST(count(*) AS DOUBLE) AS value FROM cg GROUP BY group_id, feat),
c AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM cc),
u AS (SELECT *, 'words' AS src FROM w UNION ALL SELECT *, 'chars' AS src FROM c),
own AS (SELECT feat, count(DISTINCT src) AS ns FROM u GROUP BY feat)
SELECT group_id, CASE WHEN ns > 1 THEN src || ':' || u.feat ELSE u.feat END AS feat,
       round(value, 6) AS value, round(group_norm, 6) AS group_norm FROM u JOIN own ON u.feat = own.feat""")
def q_combine_feats(spark, sf_dir):
    m = src.messages_by_source(spark, sf_dir)
    return _feat_out(R.combine_feats({"words": FE.ngram_feats(m, 1), "chars": FE.char_ngram_feats(m, 3)}))


@register("flexibin", f"""WITH {S.feat_ctes('documents', 'doc_id')},
e AS (SELECT min(doc_id) AS lo, max(doc_id) + 1 AS hi FROM documents),
b AS (SELECT CAST(floor((group_id - lo) * 10 / CAST(hi - lo AS DOUBLE)) + 1 AS BIGINT) AS group_id, feat, value FROM f, e),
c AS (SELECT group_id, feat, sum(value) AS value FROM b GROUP BY group_id, feat)
{_FEAT_SEL} FROM (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM c)""")
def q_flexibin(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    e = src.table(spark, sf_dir, "documents").agg(F.min("doc_id"), F.max("doc_id") + 1).first()
    return _feat_out(R.flexibin(feats, 10, float(e[0]), float(e[1])))


_YEARS = list(range(1995, 2002))


@register("pivot_dates", f"""SELECT o_custkey AS id,
  {", ".join(f"round(avg(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END), 6) AS y{y}" for y in _YEARS)}
FROM orders GROUP BY o_custkey""")
def q_pivot_dates(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("yr"),
                                                  "o_totalprice")
    p = o.groupBy("id").pivot("yr", _YEARS).agg(F.avg("o_totalprice"))
    return p.select("id", *[rnd(F.col(str(y))).alias(f"y{y}") for y in _YEARS])


# The submission dates of the id x date grid.
GRID_DATES = ["2016-10-01", "2016-11-01", "2016-12-01", "2017-10-01", "2017-11-01", "2017-12-01"]


@register("date_grid", f"""SELECT c_custkey AS id, CAST(d AS TIMESTAMP) AS transactiondate, CAST(0.0 AS DOUBLE) AS logerror
FROM customer, (VALUES {", ".join(f"('{d}')" for d in GRID_DATES)}) AS t(d)""")
def q_date_grid(spark, sf_dir):
    """Every id x each fixed date, melted to long rows (an explode per id, no join)."""
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    dates = F.array(*[F.lit(d) for d in GRID_DATES])
    return c.select("id", F.explode(dates).alias("d")).select(
        "id", F.to_timestamp_ntz("d").alias("transactiondate"), F.lit(0.0).alias("logerror"))

# ---------------------------------------------------------------- 2.6


@register("value_funcs", f"""WITH {S.feat_ctes('documents', 'source')},
v AS (SELECT 'identity' AS func, group_id, feat, group_norm AS gn FROM f
  UNION ALL SELECT 'sqrt', group_id, feat, sqrt(group_norm) FROM f
  UNION ALL SELECT 'log', group_id, feat, ln(group_norm + 1) FROM f
  UNION ALL SELECT 'anscombe', group_id, feat, 2 * sqrt(group_norm + 0.375) FROM f
  UNION ALL SELECT 'boolean', group_id, feat, 1.0 FROM f)
SELECT func, group_id, feat, round(gn, 6) AS group_norm FROM v""")
def q_value_funcs(spark, sf_dir):
    from glossa.functions.values import VALUE_FUNCS
    feats = source_unigrams(spark, sf_dir)
    out = None
    for fn in VALUE_FUNCS:
        t = FE.apply_value_func(feats, fn).select(F.lit(fn).alias("func"), "group_id", "feat", rnd("group_norm").alias("group_norm"))
        out = t if out is None else out.unionByName(t)
    return out


@register("lex_value_funcs", f"""WITH {S.feat_ctes('documents', 'doc_id')},
lex AS (SELECT * FROM {src.lexicon_values_sql()}),
tot AS (SELECT group_id, sum(value) AS tot FROM f GROUP BY group_id),
a0 AS (SELECT f.group_id, lex.category AS feat,
              CAST(sum(CAST(f.value AS DECIMAL(20,6)) * CAST(1.0 AS DECIMAL(12,6))) AS DOUBLE) AS v
       FROM f JOIN lex ON f.feat = lex.term WHERE lex.term <> '_intercept' GROUP BY f.group_id, lex.category),
a AS (SELECT a0.group_id, feat, v / tot AS gn FROM a0 JOIN tot ON a0.group_id = tot.group_id)
SELECT 'log' AS func, group_id, feat, round(log2(gn + 1), 6) AS group_norm FROM a
UNION ALL SELECT 'sqrt', group_id, feat, round(sqrt(gn), 6) FROM a""")
def q_lex_value_funcs(spark, sf_dir):
    words = doc_unigrams(spark, sf_dir)
    plain = materialize(FE.lexicon_feats(words, src.lexicon(spark)))     # counted once for both functions
    out = None
    for fn in ("log", "sqrt"):
        t = FE.apply_value_func(plain, fn, lexicon=True)
        t = t.select(F.lit(fn).alias("func"), "group_id", "feat", rnd("group_norm").alias("group_norm"))
        out = t if out is None else out.unionByName(t)
    return out


@register("date_features", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS transaction_year,
  CAST((year(o_orderdate) - 2016) * 12 + month(o_orderdate) AS INTEGER) AS transaction_month,
  CAST((year(o_orderdate) - 2016) * 4 + quarter(o_orderdate) AS INTEGER) AS transaction_quarter FROM orders""")
def q_date_features(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return SC.date_features(o, "o_orderdate")


@register("cats_to_int", """
SELECT c_custkey, CAST(coalesce(dense_rank() OVER (ORDER BY c_mktsegment) - 1, -1) AS INTEGER) AS c_mktsegment
FROM customer""")
def q_cats_to_int(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return SC.cats_to_int(c, ["c_mktsegment"])


@register("cats_to_int_2", """WITH v AS (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code FROM v)
SELECT o_orderstatus AS frame, o_orderkey, code AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)
WHERE o_orderstatus IN ('F', 'O')""")
def q_cats_to_int_2(spark, sf_dir):
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    a, b = SC.cats_to_int_2(o.where(F.col("o_orderstatus") == "F"), o.where(F.col("o_orderstatus") == "O"),
                            ["o_orderpriority"])
    return a.unionByName(b).select(F.col("o_orderstatus").alias("frame"), "o_orderkey", "o_orderpriority")


@register("multiply", f"""WITH {_ORDER_FEATS_SQL}, {_cust_ctl_sql()},
cl AS ({" UNION ALL ".join(f"SELECT group_id, '{c}' AS ctl, {c} AS cv FROM ctl" for c in CTL_COLS)})
SELECT ofe.group_id, ofe.feat || '_' || cl.ctl AS feat, round(value * cv, 6) AS value,
       round(group_norm * cv, 6) AS group_norm FROM ofe JOIN cl ON ofe.group_id = cl.group_id""")
def q_multiply(spark, sf_dir):
    feats = src.order_feats(spark, sf_dir)
    ctl = src.customer_controls(spark, sf_dir)
    return _feat_out(SC.multiply(feats, ctl, CTL_COLS))


@register("zscore", """SELECT c_custkey AS group_id,
  round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS acctbal_z
FROM customer""")
def q_zscore(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), "c_acctbal")
    return SC.zscore(c, "c_acctbal", "acctbal_z").select("group_id", rnd("acctbal_z").alias("acctbal_z"))


@register("residuals", f"""WITH {_cust_ctl_sql()},
d AS (SELECT c.c_custkey AS group_id, c.c_acctbal AS y, ctl.n_orders AS x FROM customer c JOIN ctl ON c.c_custkey = ctl.group_id),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS my FROM d)
SELECT group_id, round(y - (a + b * x), 6) AS resid, round(y - (a + b * x) + my, 6) AS resid_plus_mean FROM d, fit""")
def q_residuals(spark, sf_dir):
    """Residual ``y - yhat`` of acctbal on the order count, and the ``+ mean(y)`` variant."""
    from glossa.operators.linear import residualize_simple
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
    d = c.join(src.customer_controls(spark, sf_dir).select("group_id", F.col("n_orders").alias("x")), "group_id")
    r = residualize_simple(d, "y", "x")
    return r.select("group_id", rnd("resid").alias("resid"), rnd("resid_plus_mean").alias("resid_plus_mean"))
