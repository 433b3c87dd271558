"""Fold assignment and splits (section 2.5); deterministic by md5 order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranks import global_rank, rank_within


def hash_order(key: str = "group_id", seed: int = 1):
    return F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))


def k_fold(groups: DataFrame, k: int = 5, seed: int = 1, key: str = "group_id") -> DataFrame:
    """Shuffled k-fold: rank groups by md5(seed || id), fold = (rank - 1) % k."""
    g = groups.select(key).distinct().withColumn("_h", hash_order(key, seed))
    r = global_rank(g, [F.col("_h"), F.col(key)])
    return r.select(key, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def fold_n(groups: DataFrame, k: int = 5, seed: int = 1, key: str = "group_id") -> DataFrame:
    """Contiguous folds of size n div k over the shuffled order, remainder into the last."""
    g = groups.select(key).distinct().withColumn("_h", hash_order(key, seed))
    n = g.count()
    size = max(n // k, 1)
    r = global_rank(g, [F.col("_h"), F.col(key)])
    return r.select(key, F.least(F.floor((F.col("rn") - 1) / F.lit(size)), F.lit(k - 1)).cast("int").alias("fold"))


def fold_labels(df: DataFrame, label_col: str, key: str = "group_id") -> DataFrame:
    """Explicit folds from a label column: dense rank of the label (0-based)."""
    labels = df.select(label_col).distinct().where(F.col(label_col).isNotNull())
    codes = global_rank(labels, [F.col(label_col)], "_c")
    return df.join(codes, label_col).select(key, (F.col("_c") - 1).cast("int").alias("fold"))


def fold_strat(df: DataFrame, class_col: str, k: int = 5, seed: int = 1, key: str = "group_id") -> DataFrame:
    """Stratified folds: position inside the class (md5 order) modulo k."""
    d = df.select(key, class_col).withColumn("_h", hash_order(key, seed))
    r = rank_within(d, class_col, [F.col("_h"), F.col(key)])
    return r.select(key, class_col, ((F.col("rn") - 1) % k).cast("int").alias("fold"))


def train_test_split(groups: DataFrame, test_share: float = 0.2, train_cap: int | None = None,
                     seed: int = 1, key: str = "group_id") -> DataFrame:
    """First ``round(test_share * n)`` groups in md5 order are test, the others
    train.  Only where the caller gives a ``train_cap``, groups beyond that many
    in the same order are ``unused``."""
    g = groups.select(key).distinct().withColumn("_h", hash_order(key, seed))
    n = g.count()
    n_test = int(round(test_share * n))
    r = global_rank(g, [F.col("_h"), F.col(key)])
    split = (F.when(F.col("rn") <= n_test, F.lit("test"))
             .when(F.lit(train_cap is None) | (F.col("rn") <= n_test + (train_cap or 0)), F.lit("train"))
             .otherwise(F.lit("unused")))
    return r.select(key, split.alias("split"))


def split3(groups: DataFrame, test_share: float = 0.2, comb_share: float = 0.15, seed: int = 1,
           key: str = "group_id") -> DataFrame:
    """Test share first, then a combiner share of the rest, then train."""
    g = groups.select(key).distinct().withColumn("_h", hash_order(key, seed))
    n = g.count()
    n_test = int(round(test_share * n))
    n_comb = int(round(comb_share * (n - n_test)))
    r = global_rank(g, [F.col("_h"), F.col(key)])
    split = (F.when(F.col("rn") <= n_test, F.lit("test"))
             .when(F.col("rn") <= n_test + n_comb, F.lit("combiner")).otherwise(F.lit("train")))
    return r.select(key, split.alias("split"))
