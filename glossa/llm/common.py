"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import session
from glossa.session import checkpoint_dir, local_fallback_dir

__all__ = ["ship_package", "Scratch", "fresh", "remainder5", "read", "ascii_lower"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Rows of one Arrow batch.  Whole texts vary from a few bytes to megabytes, and a
#: Python worker holds a batch and what is made of it at a time.
BATCH_ROWS = 500


def ship_package(spark: SparkSession) -> None:
    """The package for the Python workers, and batches that fit their memory."""
    session.ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a session on a
    ``local`` master may do without that setting and gets its own folder."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return checkpoint_dir(spark)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return checkpoint_dir(spark, local_fallback_dir())


class Scratch:
    """Intermediate tables of one operator run, in the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it back, which cuts the
    lineage and survives lost executors, and lets go of what its jobs left.  ``drop`` removes tables that the
    result no longer reads; what the lazy result still needs stays until the
    caller's shared folder is cleared (``Scratch.clear`` removes the rest).
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/glossa-{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        session.tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            self._delete(self.path(n))

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(where)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each wish."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def remainder5(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; null for a null key."""
    return F.crc32(key.cast("string")) % F.lit(5)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def spread_join(big: DataFrame, small: DataFrame, on: list[str], by: list[str], how: str = "left",
                salts: int = 16) -> DataFrame:
    """Join in which a key with a large share of ``big`` is dealt over
    ``salts`` tasks (by a hash of ``by``); ``small`` has few rows for each key
    and is repeated ``salts`` times."""
    s, = fresh(big, "_salt")
    b = big.withColumn(s, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    k = small.withColumn(s, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return b.join(k, [*on, s], how).drop(s)
