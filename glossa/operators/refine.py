"""Long -> long refinement: occurrence, PMI and frequency filters, scaling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranks import materialize

_FEAT_COLS = ["group_id", "feat", "value", "group_norm"]


def feat_occ_filter(feats: DataFrame, p: float = 0.05, min_feat_sum: float | None = None,
                    n_groups: int | None = None) -> DataFrame:
    """Keep features used by at least ``p`` of all groups.

    ``0 < p <= 1``: share of groups; ``p > 1``: the top ``p`` features by
    group count (ties by name).  Optionally also ``sum(value) >= min_feat_sum``.
    """
    stats = feats.groupBy("feat").agg(F.count(F.lit(1)).alias("_ng"), F.sum("value").alias("_sum"))
    if p > 1:
        keep = stats.orderBy(F.col("_ng").desc(), F.col("feat").asc()).limit(int(p))
    else:
        if n_groups is None:
            n_groups = feats.select("group_id").distinct().count()
        keep = stats.where(F.col("_ng") >= F.lit(p * n_groups))
    if min_feat_sum is not None:
        keep = keep.where(F.col("_sum") >= F.lit(float(min_feat_sum)))
    # written first: a share leaves few features, which are then sent to the rows instead of the rows to them
    return feats.join(materialize(keep.select("feat")), "feat", "left_semi")


def group_freq_thresh(feats: DataFrame, thresh: float) -> DataFrame:
    """Keep groups whose total ``value`` is strictly above ``thresh``."""
    keep = feats.groupBy("group_id").agg(F.sum("value").alias("_s")).where(F.col("_s") > F.lit(float(thresh)))
    return feats.join(keep.select("group_id"), "group_id", "left_semi")


def pmi_filter(ngram_feats: DataFrame, word_feats: DataFrame, threshold: float = 3.0) -> DataFrame:
    """PMI of each n-gram: ``ln( (c(g)/T_n) / prod_i (c(w_i)/T_1) )``; keep ``>= threshold``.

    1-grams are always kept.  Counts are corpus totals of ``value``.
    Returns the kept long rows plus nothing else.
    """
    pmi = ngram_pmi(ngram_feats, word_feats)
    keep = pmi.where(F.col("pmi") >= F.lit(threshold)).select("feat")
    multi = ngram_feats.where(F.instr("feat", " ") > 0)
    uni = ngram_feats.where(F.instr("feat", " ") == 0)
    return uni.unionByName(multi.join(keep, "feat", "left_semi"))


def ngram_pmi(ngram_feats: DataFrame, word_feats: DataFrame) -> DataFrame:
    """``(feat, n, count, pmi)`` for every multi-word feature."""
    g = ngram_feats.where(F.instr("feat", " ") > 0).groupBy("feat").agg(F.sum("value").alias("c"))
    g = materialize(g.withColumn("n", F.size(F.split("feat", " "))))    # read for the totals and for the words
    tot_n = g.groupBy("n").agg(F.sum("c").alias("tn"))
    w = word_feats.groupBy("feat").agg(F.sum("value").alias("cw"))
    t1 = float(word_feats.agg(F.sum("value")).first()[0])
    parts = g.select("feat", "n", "c", F.posexplode(F.split("feat", " ")).alias("_pos", "_w"))
    lw = (parts.join(w.withColumnRenamed("feat", "_w"), "_w")
          .groupBy("feat", "n", "c").agg(F.sum(F.log("cw")).alias("_slog"), F.count(F.lit(1)).alias("_k")))
    # tot_n has one row per n-gram order: bounded broadcast
    j = lw.join(F.broadcast(tot_n), "n")
    pmi = F.log(F.col("c") / F.col("tn")) - (F.col("_slog") - F.col("n") * F.lit(math.log(t1)))
    return j.where(F.col("_k") == F.col("n")).select("feat", "n", F.col("c").alias("count"), pmi.alias("pmi"))


def feat_norms(feats: DataFrame, n_groups: int | None = None) -> DataFrame:
    """Add ``feat_norm = (group_norm - mean) / sd`` with absent groups as zeros.

    Moments come from sparse sums: mean = S1/N, var = S2/N - mean^2, N = all groups.
    """
    if n_groups is None:
        n_groups = feats.select("group_id").distinct().count()
    n = float(n_groups)
    mom = feats.groupBy("feat").agg(F.sum("group_norm").alias("_s1"), F.sum(F.col("group_norm") ** 2).alias("_s2"))
    mean = F.col("_s1") / F.lit(n)
    sd = F.sqrt(F.col("_s2") / F.lit(n) - mean * mean)
    return (feats.join(mom, "feat")
            .withColumn("feat_norm", (F.col("group_norm") - mean) / F.nullif(sd, F.lit(0.0)))
            .drop("_s1", "_s2"))


def white_blacklist(feats: DataFrame, terms: DataFrame, mode: str = "white") -> DataFrame:
    """Keep (white) or drop (black) features listed in ``terms.feat``."""
    how = "left_semi" if mode == "white" else "left_anti"
    return feats.join(terms.select("feat").distinct(), "feat", how)


def combine_feats(tables: dict) -> DataFrame:
    """Union named feature tables; a feature present in several sources is
    prefixed with its source name (``source:feat``)."""
    parts = [t.select(*_FEAT_COLS).withColumn("_src", F.lit(name)) for name, t in tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    u = materialize(u)      # read twice
    owners = u.groupBy("feat").agg(F.countDistinct("_src").alias("_ns"))
    return (u.join(owners, "feat")
            .withColumn("feat", F.when(F.col("_ns") > 1, F.concat_ws(":", "_src", "feat")).otherwise(F.col("feat")))
            .select(*_FEAT_COLS))


def aggregate_by_new_group(feats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Re-key groups through ``mapping(group_id, new_group_id)``; sum values and renormalize."""
    from glossa.operators.feats import attach_group_norm
    m = feats.join(mapping, "group_id")
    counts = m.groupBy(F.col("new_group_id").alias("group_id"), "feat").agg(F.sum("value").alias("value"))
    return attach_group_norm(counts)


def group_by_outcome(feats: DataFrame, outcomes: DataFrame, outcome_col: str) -> DataFrame:
    """Features per distinct outcome value: summed value, mean group_norm over member groups."""
    o = outcomes.select("group_id", F.col(outcome_col).alias("outcome_value")).where(F.col("outcome_value").isNotNull())
    size = o.groupBy("outcome_value").agg(F.count(F.lit(1)).alias("_n"))
    agg = (feats.join(o, "group_id").groupBy("outcome_value", "feat")
           .agg(F.sum("value").alias("value"), F.sum("group_norm").alias("_gn")))
    # a row per distinct outcome value, as many as groups at worst: Spark decides on the join
    return (agg.join(size, "outcome_value")
            .select("outcome_value", "feat", "value", (F.col("_gn") / F.col("_n")).alias("group_norm")))


def flexibin(feats: DataFrame, num_bins: int, lo: float, hi: float) -> DataFrame:
    """Bin groups by numeric id range into ``num_bins`` bins; sum values per (bin, feat), renormalize."""
    from glossa.operators.feats import attach_group_norm
    b = F.expr(f"width_bucket(cast(group_id as double), {float(lo)}, {float(hi)}, {int(num_bins)})")
    counts = feats.groupBy(b.cast("bigint").alias("group_id"), "feat").agg(F.sum("value").alias("value"))
    return attach_group_norm(counts)


def top_per_key(df: DataFrame, key: str, order_cols, k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per key (row_number over a key partition)."""
    w = Window.partitionBy(key).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).where(F.col(rank_col) <= k)
