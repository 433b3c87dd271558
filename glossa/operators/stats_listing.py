"""Listings over correlation results: sorted summaries and tag-cloud data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranks import materialize, rank_within, top_k_per_key

# Words masked in tag-cloud output (ours).
EXPLETIVES = ("damn", "hell", "crap")


def correlate_summary(corrs: DataFrame, p_max: float = 0.05, p_col: str = "p_adj") -> DataFrame:
    """Rank of each feature by |r| per outcome plus the count with p < p_max."""
    corrs = materialize(corrs)      # read twice
    cnt = corrs.groupBy("outcome").agg(F.count(F.when(F.col(p_col) < p_max, 1)).alias("n_significant"))
    c = corrs.where(F.col("r").isNotNull()).withColumn("_absr", F.abs("r"))
    ranked = rank_within(c, ["outcome"], [F.col("_absr").desc(), F.col("feat")], "rank")
    return ranked.join(F.broadcast(cnt), "outcome").select("outcome", "rank", "feat", "r", "p", p_col, "n_significant")


def tagcloud_data(corrs: DataFrame, k: int = 15, p_max: float = 0.05, clean: bool = True) -> DataFrame:
    sig = materialize(corrs.where((F.col("p") < p_max) & F.col("r").isNotNull()).withColumn(
        "sign", F.when(F.col("r") > 0, F.lit("pos")).otherwise(F.lit("neg"))))      # read three times
    # drop a feature contained (as whole words) in a stronger feature of the
    # same sign: every phrase emits its proper contiguous sub-phrases, which
    # are equi-joined to the features (no pairwise comparison)
    words = F.split("feat", " ")
    subs = sig.select("outcome", "sign", F.abs("r").alias("_rb"), F.explode(F.expr(
        "flatten(transform(sequence(1, size(split(feat, ' '))), i -> "
        "transform(sequence(i, size(split(feat, ' '))), j -> array_join(slice(split(feat, ' '), i, j - i + 1), ' '))))"))
        .alias("feat"), F.size(words).alias("_nb"))
    subs = subs.where(F.size(F.split("feat", " ")) < F.col("_nb"))
    contained = (sig.join(subs, ["outcome", "sign", "feat"]).where(F.col("_rb") > F.abs(F.col("r")))
                 .select("outcome", "feat").distinct())
    sig = sig.join(contained, ["outcome", "feat"], "left_anti")
    top = top_k_per_key(sig, ["outcome", "sign"], [F.abs("r").desc(), F.col("feat")], k, salt_col="feat")
    word = F.col("feat")
    if clean:
        for w in EXPLETIVES:
            word = F.regexp_replace(word, rf"\b{w}\b", w[0] + "*" * (len(w) - 1))
    return top.select("outcome", "sign", "rank", word.alias("feat"), "r", "p", "freq")
