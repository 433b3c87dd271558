"""File sources and table sinks (section 2.1).

Sinks are plain DataFrame writers with the reference's modes: feature tables
are created once (``errorifexists``), outcome tables are replaced, metric
logs are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_SCHEMA = "group_id string, feat string, value double, group_norm double"


def read_split_text(spark: SparkSession, path: str) -> DataFrame:
    """TSV ``uid, TEST|TRAIN, text`` (no header) -> (uid, split lower-cased, text)."""
    df = spark.read.csv(path, sep="\t", schema="uid string, split string, text string", quote="\u0000")
    return df.withColumn("split", F.lower("split"))


def read_messages_csv(spark: SparkSession, path: str, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """CSV (optionally .gz, decompressed transparently) -> messages."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(F.col(id_col).cast("bigint").alias("message_id"), F.col(group_col).alias("group_id"),
                     F.col(text_col).alias("message"))


def write_messages_csv(messages: DataFrame, path: str, compression: str = "gzip") -> None:
    messages.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path, compression=compression)


def write_feature_table(feats: DataFrame, path: str) -> None:
    """Create a feature table (fails if it exists, like a CREATE TABLE)."""
    feats.select("group_id", "feat", "value", "group_norm").write.mode("errorifexists").parquet(path)


def write_outcome_table(outcomes: DataFrame, path: str) -> None:
    """Replace an outcome table."""
    outcomes.write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows to a metrics log table."""
    metrics.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def list_feature_tables(spark: SparkSession, root: str) -> DataFrame:
    """Feature tables under a folder: sub-folders whose schema has the
    feature-table columns."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(conf)
    names = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            if st.isDirectory():
                name = st.getPath().getName()
                try:
                    cols = set(spark.read.parquet(st.getPath().toString()).columns)
                except Exception:  # noqa: BLE001 - not a parquet table
                    continue
                if {"group_id", "feat", "value", "group_norm"} <= cols:
                    names.append((name,))
    return spark.createDataFrame(names, "table_name string")
