"""Readers that map the driver tables onto the package's data model.

Data model (see README):
* messages   ``(message_id, group_id, message)``
* features   ``(group_id, feat, value, group_norm)`` long, an absent row is 0
* outcomes   one row per group, one nullable double column per outcome
* lexicon    ``(category, term, weight)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.feats import attach_group_norm

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry long texts: per-row work (tokenizing) dominates.
TEXT_TABLES = ("documents", "conversations", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when the scan yields fewer partitions than the
    cluster has cores (e.g. a single-row-group file).  At scale the scan is
    already split into many partitions and this is a no-op, so no shuffle
    is added there."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def messages_by_doc(spark, sf_dir) -> DataFrame:
    """One message per document, the document is the group."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("doc_id").alias("group_id"),
        F.col("text").alias("message"))


def messages_by_source(spark, sf_dir) -> DataFrame:
    """Documents as messages grouped by their source (20 groups)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("message_id"), F.col("source").alias("group_id"),
        F.col("text").alias("message"))


def messages_by_conversation(spark, sf_dir) -> DataFrame:
    """Conversation turns as ordered messages of the conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("message_id"), F.col("conv_id").alias("group_id"),
        F.col("text").alias("message"))


def label_outcomes(spark, sf_dir) -> DataFrame:
    """Binary outcomes per document: quality, toxic (double)."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("group_id"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"))


def customer_outcomes(spark, sf_dir) -> DataFrame:
    """Continuous outcomes per customer: account balance, mean order price."""
    cust = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_acctbal").alias("acctbal"))
    price = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id"))
             .agg(F.avg("o_totalprice").alias("avg_price")))
    return cust.join(price, "group_id", "left")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def customer_controls(spark, sf_dir) -> DataFrame:
    """Controls per customer: one-hot market segment, nation key, order count."""
    cust = table(spark, sf_dir, "customer")
    n_orders = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id"))
                .agg(F.count(F.lit(1)).cast("double").alias("n_orders")))
    cols = [F.col("c_custkey").alias("group_id")]
    cols += [F.when(F.col("c_mktsegment") == s, 1.0).otherwise(0.0).alias(f"seg_{s.lower()}")
             for s in SEGMENTS]
    cols.append(F.col("c_nationkey").cast("double").alias("nationkey"))
    return cust.select(*cols).join(n_orders, "group_id", "left").fillna(0.0, ["n_orders"])


def order_feats(spark, sf_dir, feat_col: str = "p_brand") -> DataFrame:
    """Numeric feature table: customer x part brand (or type), summed quantity."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = table(spark, sf_dir, "part").select("p_partkey", feat_col)
    counts = (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
              .groupBy(F.col("o_custkey").alias("group_id"), F.col(feat_col).alias("feat"))
              .agg(F.sum("l_quantity").alias("value")))
    return attach_group_norm(counts)


def order_states(spark, sf_dir) -> DataFrame:
    """Numeric feature table: customer x order priority and status, summed price."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("feat"), "o_totalprice")
    return attach_group_norm(o.groupBy("group_id", "feat").agg(F.sum("o_totalprice").alias("value")))


def event_feats(spark, sf_dir) -> DataFrame:
    """Small dense feature table: user x event type, summed value."""
    counts = (table(spark, sf_dir, "events")
              .groupBy(F.col("user_id").alias("group_id"), F.col("event_type").alias("feat"))
              .agg(F.sum("value").alias("value")))
    return attach_group_norm(counts)


# The inline test lexicon (our own; terms drawn from frequent
# 1-grams of the driver documents).  category, term, weight.
LEXICON_ROWS = [
    ("func_en", "the", 1.0), ("func_en", "of", 0.9), ("func_en", "and", 0.8),
    ("func_en", "to", 0.7), ("func_en", "in", 0.6), ("func_en", "is", 0.5),
    ("func_en", "that", 0.4), ("func_en", "it", 0.3), ("func_en", "for", 0.2),
    ("func_en", "was", 0.1), ("func_en", "on", -0.1), ("func_en", "with", -0.2),
    ("func_en", "be", -0.3), ("func_en", "as", -0.4), ("func_en", "by", -0.5),
    ("func_en", "this", -0.6), ("func_en", "are", -0.7), ("func_en", "at", -0.8),
    ("func_en", "from", -0.9), ("func_en", "an", -1.0),
    ("func_other", "de", 1.5), ("func_other", "la", 1.25), ("func_other", "der", 1.0),
    ("func_other", "en", 0.75), ("func_other", "die", 0.5), ("func_other", "que", 0.25),
    ("func_other", "le", -0.25), ("func_other", "des", -0.5), ("func_other", "und", -0.75),
    ("func_other", "et", -1.0), ("func_other", "les", -1.25), ("func_other", "un", -1.5),
    ("func_other", "es", 2.0), ("func_other", "el", -2.0), ("func_other", "den", 0.6),
    ("func_other", "von", -0.6), ("func_other", "a", 0.3), ("func_other", "er", -0.3),
    ("func_en", "_intercept", 0.05), ("func_other", "_intercept", -0.05),
]


def lexicon(spark) -> DataFrame:
    """The inline lexicon; its few fixed rows are broadcast, so no join deals the features out by word."""
    return F.broadcast(spark.createDataFrame(LEXICON_ROWS, "category string, term string, weight double"))


def lexicon_values_sql() -> str:
    """The same lexicon as a SQL VALUES list (for oracle queries)."""
    rows = ", ".join(f"('{c}', '{t}', {w!r})" for c, t, w in LEXICON_ROWS)
    return f"(VALUES {rows}) AS lex(category, term, weight)"
