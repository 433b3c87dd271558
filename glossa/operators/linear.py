"""Linear-model helpers computed from sums on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def residualize_simple(df: DataFrame, y: str, x: str) -> DataFrame:
    """Residual of ``y`` on one regressor with intercept, and ``+ mean(y)``."""
    fit = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(y).alias("my")).first()
    yhat = F.lit(fit["a"]) + F.lit(fit["b"]) * F.col(x)
    return (df.withColumn("resid", F.col(y) - yhat)
            .withColumn("resid_plus_mean", F.col(y) - yhat + F.lit(fit["my"])))
