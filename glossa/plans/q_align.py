"""Joins and alignment (2.3), folds, splits and top-k (2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import align as A
from glossa.operators import feats as FE
from glossa.operators import folds as FO
from glossa.operators.ranks import global_rank, top_k_per_key
from glossa.plans import sqlfrag as S
from glossa.plans.common import rnd, doc_unigrams, source_unigrams
from glossa.plans.q_text import _ORDER_FEATS_SQL
from glossa.plans.registry import register
from glossa.sources import tables as src

# ---------------------------------------------------------------- 2.3


@register("match_ids", """WITH a AS (SELECT doc_id AS group_id FROM documents WHERE lang = 'en'),
b AS (SELECT doc_id AS group_id FROM labels),
c AS (SELECT doc_id AS group_id FROM documents WHERE n_chars > 500),
k AS (SELECT group_id FROM a INTERSECT SELECT group_id FROM b INTERSECT SELECT group_id FROM c)
SELECT 'en_docs' AS frame, group_id FROM a WHERE group_id IN (SELECT group_id FROM k)
UNION ALL SELECT 'labels', group_id FROM b WHERE group_id IN (SELECT group_id FROM k)
UNION ALL SELECT 'long_docs', group_id FROM c WHERE group_id IN (SELECT group_id FROM k)""")
def q_match_ids(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents")
    a = d.where(F.col("lang") == "en").select(F.col("doc_id").alias("group_id"))
    b = src.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("group_id"))
    c = d.where(F.col("n_chars") > 500).select(F.col("doc_id").alias("group_id"))
    ra, rb, rc = A.match_ids([a, b, c])
    return (ra.select(F.lit("en_docs").alias("frame"), "group_id")
            .unionByName(rb.select(F.lit("labels").alias("frame"), "group_id"))
            .unionByName(rc.select(F.lit("long_docs").alias("frame"), "group_id")))


@register("merge_inner", """SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def q_merge_inner(spark, sf_dir):
    d = src.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return src.table(spark, sf_dir, "labels").join(d, "doc_id", "inner")


_TYPE_FEATS_SQL = _ORDER_FEATS_SQL.replace("p.p_brand", "p.p_type").replace("of_c", "ot_c").replace("ofe", "ote")


@register("align_dense", f"""WITH {_TYPE_FEATS_SQL},
nf AS (SELECT count(DISTINCT feat) AS k FROM ote),
full_g AS (SELECT group_id FROM ote GROUP BY group_id HAVING count(DISTINCT feat) = (SELECT k FROM nf))
SELECT ote.group_id, feat, round(group_norm, 6) AS x, round(c.c_acctbal, 6) AS y FROM ote
JOIN customer c ON ote.group_id = c.c_custkey WHERE ote.group_id IN (SELECT group_id FROM full_g) AND c.c_acctbal IS NOT NULL""")
def q_align_dense(spark, sf_dir):
    feats = src.order_feats(spark, sf_dir, "p_type")
    al = A.align_dense(feats, src.customer_outcomes(spark, sf_dir), "acctbal")
    return al.select("group_id", "feat", rnd("group_norm").alias("x"), rnd("y").alias("y"))


@register("align_sparse", f"""WITH {_ORDER_FEATS_SQL}
SELECT ofe.group_id, feat, round(group_norm, 6) AS x, round(c.c_acctbal, 6) AS y FROM ofe
JOIN customer c ON ofe.group_id = c.c_custkey WHERE c.c_acctbal IS NOT NULL""")
def q_align_sparse(spark, sf_dir):
    al = A.align_sparse(src.order_feats(spark, sf_dir), src.customer_outcomes(spark, sf_dir), "acctbal")
    return al.select("group_id", "feat", rnd("x").alias("x"), rnd("y").alias("y"))


@register("align_preds", """WITH p1 AS (SELECT o_custkey AS group_id, avg(o_totalprice) / 10 AS yhat1 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
p2 AS (SELECT o_custkey AS group_id, avg(o_totalprice) / 10 AS yhat2 FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT c.c_custkey AS group_id, round(c.c_acctbal, 6) AS y, round(yhat1, 6) AS yhat1, round(yhat2, 6) AS yhat2
FROM customer c JOIN p1 ON c.c_custkey = p1.group_id JOIN p2 ON c.c_custkey = p2.group_id""")
def q_align_preds(spark, sf_dir):
    """y aligned with k prediction tables: intersection of their keys."""
    o = src.table(spark, sf_dir, "orders")
    p1 = o.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("group_id")).agg((F.avg("o_totalprice") / 10).alias("yhat1"))
    p2 = o.where(F.col("o_orderstatus") == "O").groupBy(F.col("o_custkey").alias("group_id")).agg((F.avg("o_totalprice") / 10).alias("yhat2"))
    y = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("y"))
    j = y.join(p1, "group_id").join(p2, "group_id")
    return j.select("group_id", rnd("y").alias("y"), rnd("yhat1").alias("yhat1"), rnd("yhat2").alias("yhat2"))


@register("align_vocab", f"""WITH {S.feat_ctes('documents', 'doc_id')},
st AS (SELECT feat, count(*) AS ng FROM f GROUP BY feat),
voc AS (SELECT feat, CAST(row_number() OVER (ORDER BY ng DESC, feat) - 1 AS BIGINT) AS idx FROM st
        QUALIFY row_number() OVER (ORDER BY ng DESC, feat) <= 300),
{S.feat_ctes('conversations', 'conv_id', 1, 'cf')}
SELECT cf.group_id, cf.feat, voc.idx, round(cf.group_norm, 6) AS group_norm FROM cf JOIN voc ON cf.feat = voc.feat""")
def q_align_vocab(spark, sf_dir):
    """Conversation 1-grams aligned to a training vocabulary (top 300 document
    1-grams by group count): unseen features dropped, indices attached."""
    feats = doc_unigrams(spark, sf_dir)
    st = feats.groupBy("feat").agg(F.count(F.lit(1)).alias("ng"))
    top = st.orderBy(F.col("ng").desc(), F.col("feat")).limit(300)
    vocab = global_rank(top, [F.col("ng").desc(), F.col("feat")], "idx").withColumn("idx", F.col("idx") - 1)
    conv = FE.ngram_feats(src.messages_by_conversation(spark, sf_dir), 1)
    return A.align_vocab(conv, vocab).select("group_id", "feat", "idx", rnd("group_norm").alias("group_norm"))


@register("x_groups", f"""WITH {S.feat_ctes('documents', 'doc_id')},
lx AS (SELECT DISTINCT group_id FROM f WHERE feat IN (SELECT term FROM {src.lexicon_values_sql()})),
ng AS (SELECT DISTINCT group_id FROM f WHERE feat IN (SELECT feat FROM f GROUP BY feat HAVING count(*) >= 0.5 * (SELECT count(*) FROM documents)))
SELECT 'intersect' AS kind, group_id FROM (SELECT group_id FROM lx INTERSECT SELECT group_id FROM ng)
UNION ALL SELECT 'union', group_id FROM (SELECT group_id FROM lx UNION SELECT group_id FROM ng)""")
def q_x_groups(spark, sf_dir):
    """Groups present in every feature table (intersection) and in any (union)."""
    words = doc_unigrams(spark, sf_dir)
    lex = FE.lexicon_feats(words, src.lexicon(spark)).select("group_id").distinct()
    # words of at least half of the documents
    half = 0.5 * src.table(spark, sf_dir, "documents").count()
    frequent = words.groupBy("feat").count().where(F.col("count") >= half).select("feat")
    common = words.join(frequent, "feat", "left_semi").select("group_id").distinct()
    return (lex.intersect(common).select(F.lit("intersect").alias("kind"), "group_id")
            .unionByName(lex.union(common).distinct().select(F.lit("union").alias("kind"), "group_id")))


@register("topic_state_join", f"""WITH di AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents),
st AS (SELECT di.doc_index, unnest(range(len({S.tokens('d.text')}))) AS pos, unnest({S.tokens('d.text')}) AS token
       FROM documents d JOIN di ON d.doc_id = di.doc_id),
mi AS (SELECT doc_id AS message_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents)
SELECT mi.message_id, CAST(st.pos AS BIGINT) AS pos, st.token, CAST(length(st.token) % 8 AS INTEGER) AS topic
FROM st JOIN mi ON st.doc_index = mi.doc_index""")
def q_topic_state_join(spark, sf_dir):
    """Topic-state rows carry only a document index (file order); message ids
    are attached by numbering messages in id order and joining on the index."""
    msgs = src.messages_by_doc(spark, sf_dir)
    states = FE.topic_states(msgs).drop("group_id")
    st_idx = global_rank(msgs.select("message_id"), [F.col("message_id")], "doc_index")
    states = states.join(st_idx, "message_id").drop("message_id")   # what a state file holds
    m_idx = global_rank(msgs.select("message_id"), [F.col("message_id")], "doc_index")
    return states.join(m_idx, "doc_index").select("message_id", F.col("pos").cast("bigint").alias("pos"),
                                                  "token", "topic")

# ---------------------------------------------------------------- 2.5


_CUST_RN = """g AS (SELECT c_custkey AS group_id, row_number() OVER (ORDER BY md5('1' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rn,
  count(*) OVER () AS n FROM customer)"""


def _cust(spark, sf_dir):
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))


@register("k_fold", f"WITH {_CUST_RN} SELECT group_id, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM g")
def q_k_fold(spark, sf_dir):
    return FO.k_fold(_cust(spark, sf_dir), 5)


@register("fold_n", f"WITH {_CUST_RN} SELECT group_id, CAST(least(floor((rn - 1) / (n // 5)), 4) AS INTEGER) AS fold FROM g")
def q_fold_n(spark, sf_dir):
    return FO.fold_n(_cust(spark, sf_dir), 5)


@register("fold_labels", """SELECT c_custkey AS group_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS fold
FROM customer WHERE c_mktsegment IS NOT NULL""")
def q_fold_labels(spark, sf_dir):
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), "c_mktsegment")
    return FO.fold_labels(c, "c_mktsegment")


@register("fold_strat", """SELECT doc_id AS group_id, quality,
  CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('1' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def q_fold_strat(spark, sf_dir):
    lab = src.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("group_id"), "quality")
    return FO.fold_strat(lab, "quality", 5)


@register("train_test_split", f"""WITH {_CUST_RN}
SELECT group_id, CASE WHEN rn <= round(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM g""")
def q_train_test_split(spark, sf_dir):
    """20 % test by md5 order, all others train."""
    return FO.train_test_split(_cust(spark, sf_dir), 0.2)


@register("split3", f"""WITH {_CUST_RN}, t AS (SELECT round(0.2 * max(n)) AS nt, max(n) AS n FROM g)
SELECT group_id, CASE WHEN rn <= (SELECT nt FROM t) THEN 'test'
  WHEN rn <= (SELECT nt FROM t) + round(0.15 * ((SELECT n FROM t) - (SELECT nt FROM t))) THEN 'combiner'
  ELSE 'train' END AS split FROM g""")
def q_split3(spark, sf_dir):
    return FO.split3(_cust(spark, sf_dir), 0.2, 0.15)


@register("top_messages", f"""WITH st AS (SELECT doc_id AS message_id, unnest({S.tokens()}) AS token FROM documents),
c AS (SELECT message_id, CAST(length(token) % 8 AS VARCHAR) AS feat, count(*) AS value FROM st GROUP BY message_id, feat),
f AS (SELECT message_id, feat, value / sum(value) OVER (PARTITION BY message_id) AS group_norm FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY group_norm DESC, message_id) AS rank FROM f)
SELECT feat, message_id, round(group_norm, 6) AS group_norm, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""")
def q_top_messages(spark, sf_dir):
    """Top 10 messages per topic by topic share (ties by message id); two-round
    salted top-k so a topic present in every message is not one task."""
    msgs = src.messages_by_doc(spark, sf_dir)
    tf = FE.topic_feats(FE.topic_states(msgs)).withColumnRenamed("group_id", "message_id")
    top = top_k_per_key(tf, "feat", [F.col("group_norm").desc(), F.col("message_id")], 10, salt_col="message_id")
    return top.select("feat", "message_id", rnd("group_norm").alias("group_norm"), "rank")


@register("topic_labels", f"""WITH st AS (SELECT unnest({S.tokens()}) AS token FROM documents),
c AS (SELECT CAST(length(token) % 8 AS VARCHAR) AS category, token AS term, count(*) AS c FROM st GROUP BY category, term),
w AS (SELECT category, term, c / sum(c) OVER (PARTITION BY category) AS weight FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS rk FROM w)
SELECT category AS topic, string_agg(term, ' ' ORDER BY rk) AS label FROM r WHERE rk <= 5 GROUP BY category""")
def q_topic_labels(spark, sf_dir):
    """Label per topic: its 5 most probable words, p(word | topic) order."""
    st = FE.topic_states(src.messages_by_doc(spark, sf_dir))
    lex = FE.topic_lexicon(st, "csv_lik")
    top = top_k_per_key(lex, "category", [F.col("weight").desc(), F.col("term")], 5, salt_col="term", rank_col="rk")
    agg = top.groupBy(F.col("category").alias("topic")).agg(F.array_sort(F.collect_list(F.struct("rk", "term"))).alias("_t"))
    return agg.select("topic", F.array_join(F.expr("transform(_t, s -> s.term)"), " ").alias("label"))
