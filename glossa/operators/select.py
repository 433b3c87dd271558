"""Univariate feature selection in long form (section 2.8).

The F statistic of a one-feature regression equals ``r^2/(1-r^2)*(n-2)``,
so selection for any number of features is one long-form aggregate (the
correlation pass) plus a tail probability on the result table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.dist import f_pvalue
from glossa.operators.ranks import materialize

# The alpha sweep of the family-wise selector.
FWE_ALPHAS = (0.25, 0.5, 1.0, 1.5, 2.0, 4.0, 5.0, 7.5, 10.0, 20.0, 30.0, 50.0, 100.0, 200.0)


def f_stats(corrs: DataFrame) -> DataFrame:
    """Add ``f`` and its upper-tail ``p_f`` (1, n-2 df) to a correlation table."""
    r2 = F.col("r") * F.col("r")
    out = corrs.withColumn("f", r2 / F.nullif(1 - r2, F.lit(0.0)) * (F.col("n") - 2))
    return out.withColumn("p_f", f_pvalue(F.col("f"), F.lit(1.0), (F.col("n") - 2).cast("double")))


def select_fwe(corrs: DataFrame, alpha: float = 60.0) -> DataFrame:
    """Keep features with ``p < alpha / m`` per outcome (m = features tested)."""
    s = f_stats(corrs)
    m = s.groupBy("outcome").agg(F.count(F.lit(1)).alias("_m"))
    return (s.join(F.broadcast(m), "outcome").where(F.col("p_f") < F.lit(alpha) / F.col("_m"))
            .select("outcome", "feat", "r", "n", "f", "p_f"))


def fwe_sweep(corrs: DataFrame, alphas=FWE_ALPHAS) -> DataFrame:
    """Number of features kept per outcome for each alpha of the sweep."""
    s = materialize(f_stats(corrs))     # read twice
    m = s.groupBy("outcome").agg(F.count(F.lit(1)).alias("_m"))
    x = s.join(F.broadcast(m), "outcome").select(
        "outcome", "p_f", "_m", F.explode(F.array(*[F.lit(float(a)) for a in alphas])).alias("alpha"))
    return x.groupBy("outcome", "alpha").agg(
        F.count(F.when(F.col("p_f") < F.col("alpha") / F.col("_m"), 1)).alias("n_kept"))
