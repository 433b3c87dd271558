"""Joins and alignment (section 2.3) plus bounded pivots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def densify(df: DataFrame, row: str, col: str, value: str, fill=None, max_cols: int = 1000,
            values: list | None = None) -> DataFrame:
    """Pivot ``(row, col, value)`` to one column per distinct ``col``.

    The column list is computed first and capped (``max_cols``): wide output
    is only for bounded vocabularies; larger ones stay long / sparse.
    """
    if values is None:
        values = [r[0] for r in df.select(col).distinct().orderBy(col).limit(max_cols + 1).collect()]
    if len(values) > max_cols:
        raise ValueError(f"{col} has more than {max_cols} values; keep it long")
    wide = df.groupBy(row).pivot(col, values).agg(F.first(value))
    if fill is not None:
        wide = wide.fillna(fill, subset=[str(v) for v in values])
    return wide


def match_ids(frames: list, key: str = "group_id") -> list:
    """Restrict every frame to the keys present in all of them."""
    common = reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])
    return [f.join(common, key, "left_semi") for f in frames]


def align_dense(feats: DataFrame, outcomes: DataFrame, outcome_col: str, n_feats: int | None = None) -> DataFrame:
    """Groups having the outcome and *every* feature (dense alignment)."""
    if n_feats is None:
        n_feats = feats.select("feat").distinct().count()
    full = feats.groupBy("group_id").agg(F.countDistinct("feat").alias("_k")).where(F.col("_k") == n_feats)
    y = outcomes.select("group_id", F.col(outcome_col).alias("y")).where(F.col("y").isNotNull())
    return feats.join(full.select("group_id"), "group_id", "left_semi").join(y, "group_id")


def align_sparse(feats: DataFrame, outcomes: DataFrame, outcome_col: str) -> DataFrame:
    """Groups with the outcome and *any* feature, as long rows
    ``(group_id, feat, x, y)``; absent features stay implicit zeros (no grid)."""
    y = outcomes.select("group_id", F.col(outcome_col).alias("y")).where(F.col("y").isNotNull())
    x = feats.select("group_id", "feat", F.col("group_norm").alias("x"))
    return x.join(y, "group_id")


def align_vocab(feats: DataFrame, vocab: DataFrame) -> DataFrame:
    """Align a feature table to a training vocabulary ``(feat, idx)``: unseen
    features dropped (semi-join), indices attached."""
    return feats.join(vocab.select("feat", "idx"), "feat")
