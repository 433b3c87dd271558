"""Sources (2.1) and text / feature-extraction queries (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.text import TWEET_PATTERN, tokens
from glossa.operators import feats as FE
from glossa.operators import messages as M
from glossa.operators.ranks import materialize
from glossa.operators.refine import feat_occ_filter, ngram_pmi
from glossa.plans import sqlfrag as S
from glossa.plans.common import rnd, doc_unigrams, source_unigrams
from glossa.plans.registry import register
from glossa.sources import tables as src

FEAT_OUT = ("group_id", "feat", "value", "group_norm")


def _feat_out(df):
    return df.select("group_id", "feat", rnd("value").alias("value"), rnd("group_norm").alias("group_norm"))


_FEAT_SEL = "SELECT group_id, feat, round(value, 6) AS value, round(group_norm, 6) AS group_norm"

# ---------------------------------------------------------------- 2.1 sources


@register("scan_messages", """
SELECT doc_id AS message_id, doc_id AS group_id, text AS message FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)""")
def q_scan_messages(spark, sf_dir):
    groups = src.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("group_id"))
    return M.scan_messages(src.messages_by_doc(spark, sf_dir), groups)


_ORDER_FEATS_SQL = """of_c AS (
  SELECT o.o_custkey AS group_id, p.p_brand AS feat, sum(l.l_quantity) AS value
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY o.o_custkey, p.p_brand),
ofe AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM of_c)"""


@register("load_feats", f"""WITH {_ORDER_FEATS_SQL}
{_FEAT_SEL} FROM ofe
WHERE group_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_load_feats(spark, sf_dir):
    feats = src.order_feats(spark, sf_dir).dropDuplicates(["group_id", "feat"])
    groups = src.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING") \
        .select(F.col("c_custkey").alias("group_id"))
    return _feat_out(feats.join(groups, "group_id", "left_semi"))


@register("load_controls", """
SELECT c.c_custkey AS group_id, c.c_acctbal AS ctl_acctbal, o.avg_price AS ctl_avg_price
FROM customer c JOIN (SELECT o_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey
WHERE c.c_acctbal IS NOT NULL AND o.avg_price IS NOT NULL""")
def q_load_controls(spark, sf_dir):
    o = src.customer_outcomes(spark, sf_dir)
    return o.select("group_id", F.col("acctbal").alias("ctl_acctbal"),
                    F.col("avg_price").alias("ctl_avg_price")).na.drop("any")


@register("concat_split_text", """
SELECT split, uid, chunk, string_agg(text, ' ' ORDER BY turn) AS text FROM (
  SELECT lower(role) AS split, conv_id AS uid, turn, text,
         CAST((row_number() OVER (PARTITION BY lower(role), conv_id ORDER BY turn) - 1) // 1000 AS BIGINT) AS chunk
  FROM conversations) GROUP BY split, uid, chunk""")
def q_concat_split_text(spark, sf_dir):
    """(uid, split, text) rows -> text concatenated per (split, uid); the split
    label is lower-cased.  Uses conversation roles as the split column."""
    c = src.table(spark, sf_dir, "conversations")
    m = c.select(F.col("turn").alias("message_id"),
                 F.struct(F.lower("role").alias("split"), F.col("conv_id").alias("uid")).alias("group_id"),
                 F.col("text").alias("message"))
    out = M.concat_messages(m)
    return out.select("group_id.split", "group_id.uid", "chunk", F.col("message").alias("text"))


@register("concat_messages", """
SELECT group_id, chunk, string_agg(text, ' ' ORDER BY doc_id) AS message, CAST(count(*) AS BIGINT) AS n_messages FROM (
  SELECT source AS group_id, doc_id, text,
         CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 1000 AS BIGINT) AS chunk
  FROM documents) GROUP BY group_id, chunk""")
def q_concat_messages(spark, sf_dir):
    return M.concat_messages(src.messages_by_source(spark, sf_dir))


@register("densify", """
SELECT user_id AS group_id,
  round(sum(CASE WHEN event_type = 'click' THEN value END), 6) AS "click",
  round(sum(CASE WHEN event_type = 'error' THEN value END), 6) AS "error",
  round(sum(CASE WHEN event_type = 'purchase' THEN value END), 6) AS "purchase",
  round(sum(CASE WHEN event_type = 'signup' THEN value END), 6) AS "signup",
  round(sum(CASE WHEN event_type = 'view' THEN value END), 6) AS "view"
FROM events GROUP BY user_id""")
def q_densify(spark, sf_dir):
    from glossa.operators.align import densify
    ev = src.event_feats(spark, sf_dir)
    d = densify(ev, "group_id", "feat", "value")
    return d.select("group_id", *[rnd(c).alias(c) for c in d.columns if c != "group_id"])


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@register("groups_outcomes", f"""WITH {_ORDER_FEATS_SQL},
o AS (SELECT c_custkey AS group_id, c_acctbal AS acctbal FROM customer)
SELECT o.group_id, round(o.acctbal, 6) AS acctbal,
 {", ".join(f"round(coalesce(max(CASE WHEN feat = '{b}' THEN group_norm END), 0), 6) AS " + chr(34) + b + chr(34) for b in _BRANDS)}
FROM o JOIN ofe ON o.group_id = ofe.group_id GROUP BY o.group_id, o.acctbal""")
def q_groups_outcomes(spark, sf_dir):
    """Group x (features + outcomes) rows: pivot of group_norm (absent = 0) joined to outcomes."""
    from glossa.operators.align import densify
    feats = src.order_feats(spark, sf_dir)
    wide = densify(feats, "group_id", "feat", "group_norm", fill=0.0)
    o = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"),
                                                    F.col("c_acctbal").alias("acctbal"))
    j = o.join(wide, "group_id")
    return j.select("group_id", *[rnd(c).alias(c) for c in j.columns if c != "group_id"])


@register("joined_lines", f"""WITH {S.feat_ctes('documents', 'doc_id', 1, 'f1')},
{S.feat_ctes('documents', 'doc_id', 2, 'f2')},
f AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2),
r AS (SELECT group_id, feat, rtrim(repeat(replace(feat, ' ', '_') || ' ', CAST(value AS INTEGER))) AS rr FROM f)
SELECT group_id, chunk, string_agg(rr, ' ' ORDER BY feat) AS line FROM (
  SELECT r.group_id, r.feat, rr, CAST(floor((sum(value) OVER (PARTITION BY r.group_id ORDER BY r.feat) - value) / 100000.0) AS BIGINT) AS chunk
  FROM r JOIN f ON f.group_id = r.group_id AND f.feat = r.feat) GROUP BY group_id, chunk""")
def q_joined_lines(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir).unionByName(doc_unigrams(spark, sf_dir, 2))
    return M.joined_feature_lines(feats)


def _lex_terms_sql():
    return f"SELECT DISTINCT term AS feat FROM {src.lexicon_values_sql()} WHERE term <> '_intercept'"


@register("tokenized_lines", f"""WITH t AS (
  SELECT doc_id AS message_id, doc_id AS group_id, unnest({S.tokens()}) AS feat,
         unnest(range(len({S.tokens()}))) AS pos FROM documents)
SELECT message_id, group_id, string_agg(feat, ' ' ORDER BY pos) AS line FROM t
WHERE feat IN ({_lex_terms_sql()}) GROUP BY message_id, group_id""")
def q_tokenized_lines(spark, sf_dir):
    wl = src.lexicon(spark).where(F.col("term") != "_intercept").select(F.col("term").alias("feat"))
    return M.tokenized_lines(src.messages_by_doc(spark, sf_dir), wl)


# ---------------------------------------------------------------- 2.2 / 2.7 message operators


@register("lang_filter", """
SELECT doc_id AS message_id, doc_id AS group_id, text AS message FROM documents WHERE lang IN ('en', 'de')""")
def q_lang_filter(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    return M.lang_filter(d, ["en", "de"]).select(
        F.col("doc_id").alias("message_id"), F.col("doc_id").alias("group_id"), F.col("text").alias("message"))


def _clean_sql(col):
    c = col
    for p in (M.URL_PATTERN, M.MENTION_PATTERN, M.HASHTAG_PATTERN):
        c = f"regexp_replace({c}, '{p}', '', 'g')"
    return f"trim(regexp_replace({c}, '[ \\t]+', ' ', 'g'))"


@register("clean_messages", f"""
SELECT doc_id AS message_id, doc_id AS group_id, {_clean_sql('text')} AS message FROM documents""")
def q_clean_messages(spark, sf_dir):
    return M.clean_messages(src.messages_by_doc(spark, sf_dir))


@register("dedup", f"""
SELECT min(doc_id) AS message_id, source AS group_id, {_clean_sql('text')} AS message
FROM documents GROUP BY source, {_clean_sql('text')}""")
def q_dedup(spark, sf_dir):
    return M.dedup(M.clean_messages(src.messages_by_source(spark, sf_dir)))


_SPAM_RE = r"(^|[^\p{L}\p{N}])(" + "|".join(M.SPAM_TERMS) + r")([^\p{L}\p{N}]|$)"


@register("spam_filter", f"""WITH m AS (SELECT doc_id AS message_id, source AS group_id, text AS message FROM documents),
f AS (SELECT group_id, CAST(regexp_matches(lower(message), '{_SPAM_RE}') AS INTEGER) AS is_spam FROM m),
keep AS (SELECT group_id FROM f GROUP BY group_id HAVING avg(is_spam) <= 0.1)
SELECT message_id, group_id, md5(message) AS message_md5 FROM m WHERE group_id IN (SELECT group_id FROM keep)""")
def q_spam_filter(spark, sf_dir):
    kept = M.spam_filter(src.messages_by_source(spark, sf_dir), 0.1, pattern=_SPAM_RE)
    return kept.select("message_id", "group_id", F.md5("message").alias("message_md5"))


@register("tokenize", f"""
SELECT doc_id AS message_id, doc_id AS group_id, array_to_string({S.tokens()}, ' ') AS tokens,
       CAST(len({S.tokens()}) AS INTEGER) AS n_tokens FROM documents""")
def q_tokenize(spark, sf_dir):
    t = M.tokenize(src.messages_by_doc(spark, sf_dir))
    return t.select("message_id", "group_id", F.array_join("tokens", " ").alias("tokens"),
                    F.size("tokens").alias("n_tokens"))


_TWEET_TOK = f"regexp_extract_all(lower(text), '{TWEET_PATTERN.replace(chr(39), chr(39) * 2)}')"


@register("tokenize_tweet", f"""
SELECT doc_id AS message_id, doc_id AS group_id, array_to_string({_TWEET_TOK}, ' ') AS tokens,
       CAST(len({_TWEET_TOK}) AS INTEGER) AS n_tokens FROM documents""")
def q_tokenize_tweet(spark, sf_dir):
    t = M.tokenize(src.messages_by_doc(spark, sf_dir), tweet=True)
    return t.select("message_id", "group_id", F.array_join("tokens", " ").alias("tokens"),
                    F.size("tokens").alias("n_tokens"))


_SENT = f"regexp_extract_all(text, '{M.SENTENCE_PATTERN}')"


@register("sent_per_row", f"""WITH s AS (
  SELECT doc_id AS message_id, doc_id AS group_id, unnest(range(len({_SENT}))) AS sent_pos,
         trim(unnest({_SENT})) AS sentence FROM documents)
SELECT message_id, group_id, CAST(sent_pos AS BIGINT) AS sent_pos, sentence FROM s WHERE length(sentence) > 0""")
def q_sent_per_row(spark, sf_dir):
    return M.sentences(src.messages_by_doc(spark, sf_dir))


# ---------------------------------------------------------------- 2.7 feature extraction


def _ngram_query(n):
    def q(spark, sf_dir):
        return _feat_out(FE.ngram_feats(src.messages_by_source(spark, sf_dir), n))
    return q


for _n in (1, 2, 3):
    register(f"ngrams_{_n}", f"WITH {S.feat_ctes('documents', 'source', _n)}\n{_FEAT_SEL} FROM f")(_ngram_query(_n))


@register("meta_feats", f"""WITH m AS (
  SELECT source AS group_id, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS n_tok, length(text) AS n_chr
  FROM documents),
a AS (SELECT group_id, CAST(count(*) AS DOUBLE) AS _n_msgs, CAST(sum(n_tok) AS DOUBLE) AS _total_tokens,
             avg(n_tok) AS _avg_tokens_per_msg, avg(n_chr) AS _avg_chars_per_msg FROM m GROUP BY group_id),
l AS (SELECT group_id, '_n_msgs' AS feat, _n_msgs AS value FROM a
      UNION ALL SELECT group_id, '_total_tokens', _total_tokens FROM a
      UNION ALL SELECT group_id, '_avg_tokens_per_msg', _avg_tokens_per_msg FROM a
      UNION ALL SELECT group_id, '_avg_chars_per_msg', _avg_chars_per_msg FROM a)
SELECT group_id, feat, round(value, 6) AS value, round(value, 6) AS group_norm FROM l""")
def q_meta_feats(spark, sf_dir):
    return _feat_out(FE.meta_feats(src.messages_by_source(spark, sf_dir)))


@register("ngrams_from_tok", f"""WITH j AS (SELECT source AS group_id, to_json({S.tokens()}) AS tokens_json FROM documents),
f_t AS (SELECT group_id, from_json(tokens_json, '["VARCHAR"]') AS t FROM j),
f_g AS (SELECT group_id, unnest(t) AS feat FROM f_t),
f_c AS (SELECT group_id, feat, CAST(count(*) AS DOUBLE) AS value FROM f_g GROUP BY group_id, feat),
f AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM f_c)
{_FEAT_SEL} FROM f""")
def q_ngrams_from_tok(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    tok = d.select(F.col("source").alias("group_id"), F.to_json(tokens("text")).alias("tokens_json"))
    return _feat_out(FE.ngrams_from_tokenized(tok, 1))


@register("char_ngrams", f"""WITH w AS (SELECT source AS group_id, unnest({S.tokens()}) AS w FROM documents),
g AS (SELECT group_id, unnest(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3))) AS feat FROM w),
c AS (SELECT group_id, feat, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY group_id, feat),
f AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM c)
{_FEAT_SEL} FROM f""")
def q_char_ngrams(spark, sf_dir):
    return _feat_out(FE.char_ngram_feats(src.messages_by_source(spark, sf_dir), 3))


def _lex_query(weighted):
    def q(spark, sf_dir):
        words = doc_unigrams(spark, sf_dir)
        return _feat_out(FE.lexicon_feats(words, src.lexicon(spark), weighted=weighted))
    return q


_LEX_BASE = f"""WITH {S.feat_ctes('documents', 'doc_id')},
lex AS (SELECT * FROM {src.lexicon_values_sql()}),
j AS (SELECT f.group_id, lex.category AS feat, f.value, f.group_norm, lex.weight
      FROM f JOIN lex ON f.feat = lex.term WHERE lex.term <> '_intercept'),
tot AS (SELECT group_id, sum(value) AS tot FROM f GROUP BY group_id)"""
register("lexicon", f"""{_LEX_BASE}
{_FEAT_SEL} FROM (SELECT a.group_id, feat, value, value / tot AS group_norm FROM (
  SELECT group_id, feat, CAST(sum(CAST(value AS DECIMAL(20,6)) * CAST(1.0 AS DECIMAL(12,6))) AS DOUBLE) AS value
  FROM j GROUP BY group_id, feat) a JOIN tot ON a.group_id = tot.group_id)""")(_lex_query(False))
register("lexicon_weighted", f"""{_LEX_BASE},
a0 AS (SELECT group_id, feat, CAST(sum(CAST(value AS DECIMAL(20,6)) * CAST(weight AS DECIMAL(12,6))) AS DOUBLE) AS value
       FROM j GROUP BY group_id, feat),
a AS (SELECT a0.group_id, feat, value, value / tot AS gn FROM a0 JOIN tot ON a0.group_id = tot.group_id),
ic AS (SELECT category AS feat, weight AS icpt FROM lex WHERE term = '_intercept')
{_FEAT_SEL} FROM (SELECT a.group_id, a.feat, a.value, a.gn + coalesce(ic.icpt, 0) AS group_norm
                  FROM a LEFT JOIN ic ON a.feat = ic.feat)""")(_lex_query(True))


_STATES_SQL = f"""st AS (SELECT doc_id AS message_id, source AS group_id, unnest({S.tokens()}) AS token FROM documents),
st2 AS (SELECT *, length(token) % 8 AS topic FROM st)"""


@register("topic_feats", f"""WITH {_STATES_SQL},
c AS (SELECT group_id, CAST(topic AS VARCHAR) AS feat, CAST(count(*) AS DOUBLE) AS value FROM st2 GROUP BY group_id, topic),
f AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM c)
{_FEAT_SEL} FROM f""")
def q_topic_feats(spark, sf_dir):
    st = FE.topic_states(src.messages_by_source(spark, sf_dir))
    return _feat_out(FE.topic_feats(st))


@register("topic_lex", f"""WITH {_STATES_SQL},
c AS (SELECT CAST(topic AS VARCHAR) AS category, token AS term, count(*) AS c FROM st2 GROUP BY topic, token),
a AS (SELECT 'standard' AS method, category, term, c / sum(c) OVER (PARTITION BY term) AS weight FROM c),
b AS (SELECT 'csv_lik' AS method, category, term, c / sum(c) OVER (PARTITION BY category) AS weight FROM c)
SELECT method, category, term, round(weight, 9) AS weight FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def q_topic_lex(spark, sf_dir):
    st = FE.topic_states(src.messages_by_source(spark, sf_dir))
    a = FE.topic_lexicon(st, "standard").withColumn("method", F.lit("standard"))
    b = FE.topic_lexicon(st, "csv_lik").withColumn("method", F.lit("csv_lik"))
    return a.unionByName(b).select("method", "category", "term", rnd("weight", 9).alias("weight"))


_NAME_WORDS = f"SELECT DISTINCT unnest({S.tokens()}) AS feat FROM benchmark"


@register("pnames", f"""WITH {S.feat_ctes('documents', 'doc_id')}
{_FEAT_SEL} FROM f WHERE feat IN ({_NAME_WORDS})
  AND feat NOT IN (SELECT term FROM {src.lexicon_values_sql()} WHERE category = 'func_en')""")
def q_pnames(spark, sf_dir):
    """Name features: 1-grams in a names list (the words of the benchmark
    items stand in for a names lexicon) minus a common-word list (the
    English lexicon category)."""
    words = doc_unigrams(spark, sf_dir)
    names = src.table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("feat"))
    english = src.lexicon(spark).where(F.col("category") == "func_en").select(F.col("term").alias("feat"))
    out = words.join(names.distinct(), "feat", "left_semi").join(english, "feat", "left_anti")
    return _feat_out(out)


_FK_SQL = f"""m AS (SELECT source AS group_id, {S.tokens()} AS t,
              greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s FROM documents),
fk AS (SELECT group_id, 0.39 * len(t) / s
          + 11.8 * list_sum(list_transform(t, lambda w: greatest(1, len(regexp_extract_all(w, '[{FE.VOWELS}]+'))))) / len(t)
          - 15.59 AS fk FROM m WHERE len(t) > 0)"""


@register("flesch_kincaid", f"""WITH {_FK_SQL}
SELECT group_id, 'flesch_kincaid' AS feat, round(avg(fk), 6) AS value, round(avg(fk), 6) AS group_norm
FROM fk GROUP BY group_id""")
def q_flesch_kincaid(spark, sf_dir):
    return _feat_out(FE.flesch_kincaid(src.messages_by_source(spark, sf_dir)))


@register("tf_idf", f"""WITH {S.feat_ctes('documents', 'doc_id')},
n AS (SELECT count(DISTINCT group_id) AS n FROM f),
df AS (SELECT feat, count(*) AS df FROM f GROUP BY feat)
{_FEAT_SEL} FROM (SELECT group_id, f.feat, value, group_norm * ln((SELECT n FROM n) / df) AS group_norm
                  FROM f JOIN df ON f.feat = df.feat)""")
def q_tf_idf(spark, sf_dir):
    return _feat_out(FE.tf_idf(doc_unigrams(spark, sf_dir)))


@register("colloc_feats", f"""WITH {S.feat_ctes('documents', 'source', 1, 'w')},
{S.feat_ctes('documents', 'source', 2, 'b')},
t1 AS (SELECT sum(value) AS t1 FROM w),
cw AS (SELECT feat, sum(value) AS cw FROM w GROUP BY feat),
cb AS (SELECT feat, sum(value) AS c FROM b GROUP BY feat),
tb AS (SELECT sum(c) AS tn FROM cb),
parts AS (SELECT feat, c, unnest(string_split(feat, ' ')) AS wd FROM cb),
pm AS (SELECT parts.feat, ln(parts.c / (SELECT tn FROM tb)) - (sum(ln(cw.cw)) - 2 * ln((SELECT t1 FROM t1))) AS pmi
       FROM parts JOIN cw ON parts.wd = cw.feat GROUP BY parts.feat, parts.c HAVING count(*) = 2),
col AS (SELECT feat FROM pm WHERE pmi >= 3),
bc AS (SELECT * FROM b WHERE feat IN (SELECT feat FROM col)),
sub AS (SELECT group_id, unnest(string_split(feat, ' ')) AS feat, value FROM bc),
subs AS (SELECT group_id, feat, sum(value) AS s FROM sub GROUP BY group_id, feat),
w2 AS (SELECT w.group_id, w.feat, w.value - coalesce(subs.s, 0) AS value
       FROM w LEFT JOIN subs ON w.group_id = subs.group_id AND w.feat = subs.feat),
u AS (SELECT group_id, feat, value FROM w2 WHERE value > 0 UNION ALL SELECT group_id, feat, value FROM bc),
f AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM u)
{_FEAT_SEL} FROM f""")
def q_colloc_feats(spark, sf_dir):
    from glossa.operators.feats import colloc_feats
    msgs = src.messages_by_source(spark, sf_dir)
    words = materialize(FE.ngram_counts(msgs, 1))       # both are read several times
    bigrams = materialize(FE.ngram_counts(msgs, 2))
    pmi = ngram_pmi(bigrams, words)
    collocs = materialize(pmi.where(F.col("pmi") >= 3.0).select("feat"))    # what its steps shuffled can go before the next ones
    return _feat_out(colloc_feats(words, bigrams, collocs, include_sub_collocs=False))


@register("tfidf_vectorizer")
def q_tfidf_vectorizer(spark, sf_dir):
    from glossa.operators.feats import tfidf_vectorizer
    return _feat_out(tfidf_vectorizer(src.messages_by_source(spark, sf_dir)))


@register("feat_occ_filter", f"""WITH {S.feat_ctes('documents', 'doc_id')},
ng AS (SELECT count(DISTINCT group_id) AS n FROM f),
keep AS (SELECT feat FROM f GROUP BY feat HAVING count(*) >= 0.05 * (SELECT n FROM ng) AND sum(value) >= 20)
{_FEAT_SEL} FROM f WHERE feat IN (SELECT feat FROM keep)""")
def q_feat_occ_filter(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    return _feat_out(feat_occ_filter(feats, 0.05, min_feat_sum=20))


@register("feat_occ_topn", f"""WITH {S.feat_ctes('documents', 'doc_id')},
st AS (SELECT feat, count(*) AS ng FROM f GROUP BY feat),
keep AS (SELECT feat FROM st ORDER BY ng DESC, feat ASC LIMIT 300)
{_FEAT_SEL} FROM f WHERE feat IN (SELECT feat FROM keep)""")
def q_feat_occ_topn(spark, sf_dir):
    feats = doc_unigrams(spark, sf_dir)
    return _feat_out(feat_occ_filter(feats, 300))


@register("gzip_csv_ngrams", f"WITH {S.feat_ctes('documents', 'source')}\n{_FEAT_SEL} FROM f")
def q_gzip_csv_ngrams(spark, sf_dir):
    """Messages written to a gzip CSV in the shared folder and read back
    (multi-line quoted text), then 1-grams per source."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    path = scratch_path(spark, "csv")
    IO.write_messages_csv(src.messages_by_source(spark, sf_dir), path)
    m = IO.read_messages_csv(spark, path, "message_id", "group_id", "message")
    return _feat_out(FE.ngram_feats(src.spread(m), 1))


@register("feature_table_sink")
def q_feature_table_sink(spark, sf_dir):
    """1-gram table written as a feature table, listed and read back."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    root = scratch_path(spark, "feats")
    IO.write_feature_table(FE.ngram_feats(src.messages_by_doc(spark, sf_dir), 1), f"{root}/feat_1gram_documents")
    IO.write_outcome_table(src.label_outcomes(spark, sf_dir), f"{root}/outcomes")
    listed = IO.list_feature_tables(spark, root)
    back = spark.read.parquet(f"{root}/feat_1gram_documents")
    return back.withColumn("table_name", F.lit(listed.first()["table_name"]))


@register("split_text_file", """SELECT CAST(doc_id AS VARCHAR) AS uid, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       nullif(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g'), '') AS text FROM documents""")
def q_split_text_file(spark, sf_dir):
    """Documents written as a tab-separated file (uid, TEST or TRAIN, text in one line) and read back."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    d = src.table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 5 == 0, "TEST").otherwise("TRAIN")
    line = F.concat_ws("\t", F.col("doc_id").cast("string"), split, F.regexp_replace("text", "[\t\n\r]", " "))
    path = scratch_path(spark, "split")
    d.select(line.alias("value")).write.text(path)
    return IO.read_split_text(spark, path)


@register("matrix_csv", f"""WITH {S.feat_ctes('documents', 'source')},
t AS (SELECT feat FROM f GROUP BY feat ORDER BY sum(value) DESC, feat LIMIT 20)
SELECT group_id, feat, round(group_norm, 9) AS group_norm FROM f WHERE feat IN (SELECT feat FROM t)""")
def q_matrix_csv(spark, sf_dir):
    """Relative frequencies of the 20 most frequent words by source, written as a CSV and read back."""
    from glossa.operators.ranks import scratch_path
    from glossa.sources import io as IO
    feats = source_unigrams(spark, sf_dir)
    top = feats.groupBy("feat").agg(F.sum("value").alias("n")).orderBy(F.desc("n"), "feat").limit(20)
    path = scratch_path(spark, "matrix")
    IO.write_csv(feats.join(top, "feat", "left_semi").select("group_id", "feat", "group_norm"), path)
    back = spark.read.csv(path, header=True, schema="group_id string, feat string, group_norm double")
    return back.withColumn("group_norm", F.round("group_norm", 9))
