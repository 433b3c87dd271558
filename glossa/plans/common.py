"""Shared building blocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators.feats import lone_message_feats, ngram_feats
from glossa.sources import tables as src


def rnd(c, k: int = 6):
    """Round doubles the same way in Spark and the oracle (6 decimals)."""
    return F.round(c if not isinstance(c, str) else F.col(c), k)


_STORE: dict = {}


def input_state(spark, sf_dir: str) -> int:
    """A number that changes with the files of a folder's tables (names, lengths, times), from any
    file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for table in fs.listStatus(path):
        files = fs.listStatus(table.getPath()) if table.isDirectory() else [table]
        seen += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return hash(tuple(sorted(seen)))


def stored(spark, key: tuple, build):
    """Feature-table store: a derived table is written once (parquet in the session's checkpoint folder) and
    later queries of the same session read it, as feature tables are extracted once and analysed many
    times.  ``key`` is (name, input folder, ...); it is built anew when the input's files have changed, or
    its own are gone."""
    from glossa.operators.ranks import scratch_path
    k, state = (spark.sparkContext.applicationId,) + key, input_state(spark, key[1])
    hit = _STORE.get(k)
    if hit is not None and hit[0] == state:
        at = spark._jvm.org.apache.hadoop.fs.Path(hit[1])
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return hit[2]
    path = scratch_path(spark, "store")
    build().write.parquet(path)
    df = spark.read.parquet(path)
    _STORE[k] = (state, path, df)
    return df


def doc_unigrams(spark, sf_dir, n: int = 1):
    return stored(spark, ("doc_ngrams", sf_dir, n), lambda: lone_message_feats(src.messages_by_doc(spark, sf_dir), n))


def source_unigrams(spark, sf_dir, n: int = 1):
    return stored(spark, ("source_ngrams", sf_dir, n), lambda: ngram_feats(src.messages_by_source(spark, sf_dir), n))


def doc_wide(spark, sf_dir):
    """Documents with their (partial) labels: group_id, n_chars, quality, toxic."""
    d = src.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("group_id"), F.col("n_chars").cast("double").alias("n_chars"))
    return d.join(src.label_outcomes(spark, sf_dir), "group_id", "left")


_DOC_WIDE = """w AS (SELECT d.doc_id AS group_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
  CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
