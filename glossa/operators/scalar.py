"""Row-level scalar operators (sections 2.2 and 2.6) and wide-table scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranks import global_rank


def outlier_filter(df: DataFrame, column: str, thresh: float = 1.0) -> DataFrame:
    """Keep rows with ``abs(column) < thresh`` (strict)."""
    return df.where(F.abs(F.col(column)) < F.lit(thresh))


def into_classes(c):
    """3-way class: ``|x| <= 1 -> 0``, ``x < -1 -> -1``, else 1."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) <= 1, F.lit(0)).when(c < -1, F.lit(-1)).otherwise(F.lit(1))


def date_features(df: DataFrame, col: str, prefix: str = "transaction", drop: bool = True,
                  base_year: int = 2016) -> DataFrame:
    """year, ``(year - base)*12 + month`` and ``(year - base)*4 + quarter``."""
    y = F.year(col)
    out = (df.withColumn(f"{prefix}_year", y)
           .withColumn(f"{prefix}_month", (y - base_year) * 12 + F.month(col))
           .withColumn(f"{prefix}_quarter", (y - base_year) * 4 + F.quarter(col)))
    return out.drop(col) if drop else out


def cats_to_int(df: DataFrame, cols) -> DataFrame:
    """Integer codes per column: position of the value among the sorted
    distinct values (0-based); null -> -1.  Codes are computed by a
    distributed rank of the distinct values and joined back."""
    for c in cols:
        codes = global_rank(df.select(c).distinct().where(F.col(c).isNotNull()), [F.col(c)], "_code")
        df = (df.join(codes, c, "left")
              .withColumn(c, F.coalesce(F.col("_code") - 1, F.lit(-1)).cast("int")).drop("_code"))
    return df


def cats_to_int_2(df1: DataFrame, df2: DataFrame, cols, skip=()) -> tuple:
    """Shared codes across two frames (codes of the union of values, sorted);
    nulls stay null; columns in ``skip`` are left unchanged."""
    for c in cols:
        if c in skip:
            continue
        vals = df1.select(c).union(df2.select(c)).distinct().where(F.col(c).isNotNull())
        codes = global_rank(vals, [F.col(c)], "_code")
        df1 = df1.join(codes, c, "left").withColumn(c, (F.col("_code") - 1).cast("int")).drop("_code")
        df2 = df2.join(codes, c, "left").withColumn(c, (F.col("_code") - 1).cast("int")).drop("_code")
    return df1, df2


def column_moments(df: DataFrame, cols) -> dict:
    """mean, var_pop, var_samp, stddev_pop, min, max, null count per column (one aggregate)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.var_pop(c).alias(f"{c}__varp"),
                 F.var_samp(c).alias(f"{c}__vars"), F.stddev_pop(c).alias(f"{c}__sdp"),
                 F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls")]
    row = df.agg(*aggs).first().asDict()
    return {c: {k.split("__")[1]: row[k] for k in row if k.split("__")[0] == c} for c in cols}


def fill_mean(df: DataFrame, cols) -> DataFrame:
    m = column_moments(df, cols)
    return df.fillna({c: m[c]["mean"] for c in cols if m[c]["mean"] is not None})


def minmax(df: DataFrame, cols, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Scale to [lo, hi]; a constant column maps to ``lo``; nulls stay null."""
    m = column_moments(df, cols)
    out = df
    for c in cols:
        mn, mx = m[c]["min"], m[c]["max"]
        if mn is None:
            continue
        if mx == mn:
            out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.lit(float(lo))))
        else:
            out = out.withColumn(c, F.lit(float(lo)) + (F.col(c) - F.lit(float(mn))) / F.lit(float(mx - mn)) * F.lit(hi - lo))
    return out


def drop_null_cols(df: DataFrame, cols) -> DataFrame:
    """Drop the columns (among ``cols``) that contain any null: one count aggregate."""
    m = column_moments(df, cols)
    return df.drop(*[c for c in cols if m[c]["nulls"] > 0])


def minmax_drop(df: DataFrame, cols) -> DataFrame:
    """Min-max to [0, 1] keeping nulls (constant -> null), then drop columns with nulls."""
    m = column_moments(df, cols)
    out = df
    for c in cols:
        mn, mx = m[c]["min"], m[c]["max"]
        rng = None if (mn is None or mx == mn) else float(mx - mn)
        out = out.withColumn(c, (F.col(c) - F.lit(mn)) / F.lit(rng) if rng else F.lit(None).cast("double"))
    return drop_null_cols(out, cols)


def standardize(df: DataFrame, cols) -> DataFrame:
    """Mean-fill, then ``(x - mean) / stddev_pop`` fitted on the filled
    columns (constant column -> 0)."""
    out = fill_mean(df, cols)
    m = column_moments(out, cols)
    for c in cols:
        sd = m[c]["sdp"] or 0.0
        out = out.withColumn(c, (F.col(c) - F.lit(m[c]["mean"])) / F.lit(sd) if sd > 0 else F.lit(0.0))
    return out


def transformation(df: DataFrame, col: str) -> tuple:
    """``(x - mean) / var_samp`` (divides by the variance, as specified); returns
    the frame and the (mean, var) pair for the inverse."""
    m = column_moments(df, [col])[col]
    return df.withColumn(col, (F.col(col) - F.lit(m["mean"])) / F.lit(m["vars"])), (m["mean"], m["vars"])


def transform_back(c, mean: float, var: float):
    return F.col(c) * F.lit(var) + F.lit(mean) if isinstance(c, str) else c * F.lit(var) + F.lit(mean)


def zscore(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    m = column_moments(df, [col])[col]
    return df.withColumn(out or col, (F.col(col) - F.lit(m["mean"])) / F.lit(m["sdp"]))


def multiply(feats: DataFrame, controls: DataFrame, control_cols, inclusive: bool = False) -> DataFrame:
    """Interaction features ``feat_control = value * control`` in long form
    (controls unpivoted and joined on group); ``inclusive`` keeps the originals."""
    cols = list(control_cols)
    stack = f"stack({len(cols)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols) + ") as (_ctl, _cv)"
    cl = controls.select("group_id", F.expr(stack)).where(F.col("_cv").isNotNull())
    j = feats.join(cl, "group_id")
    inter = j.select("group_id", F.concat_ws("_", "feat", "_ctl").alias("feat"),
                     (F.col("value") * F.col("_cv")).alias("value"),
                     (F.col("group_norm") * F.col("_cv")).alias("group_norm"))
    return feats.select(*inter.columns).unionByName(inter) if inclusive else inter
