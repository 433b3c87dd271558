"""Feature x outcome correlation with absent features counted as zeros.

One pass over the long feature table: per feature the sums
``Sx, Sxx, Sxy`` of every outcome over the groups where the feature is present (a row per feature,
not per feature and outcome, is shuffled), joined with the per-outcome ``N, Sy, Syy`` (one row per outcome, so bounded).  The
closed form then gives Pearson r exactly as if every absent (group, feat)
cell were a 0, without ever densifying.  Partial aggregation makes the
shuffle skew-proof: a hot feature collapses to one row per map task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.dist import t_pvalue


def long_outcomes(outcomes: DataFrame, cols, name: str = "outcome", value: str = "y") -> DataFrame:
    """Wide outcome table -> ``(group_id, outcome, y)`` keeping non-null values."""
    cols = list(cols)
    stack = f"stack({len(cols)}, " + ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols) + \
        f") as ({name}, {value})"
    return outcomes.select("group_id", F.expr(stack)).where(F.col(value).isNotNull())


def wide_outcomes(outcomes: DataFrame, cols, extra=()) -> DataFrame:
    """``(group_id, *extra, _y0, _y1, ...)``: the rows with any outcome, a double column for each."""
    cols = list(cols)
    y = outcomes.select("group_id", *extra, *[F.col(f"`{c}`").cast("double").alias(f"_y{i}") for i, c in enumerate(cols)])
    return y.where(F.coalesce(*[F.col(f"_y{i}") for i in range(len(cols))]).isNotNull())


def by_outcome(df: DataFrame, cols, names, keep=("feat",)) -> DataFrame:
    """Columns ``<name>_<i>`` of the i-th outcome as rows: (outcome, *keep, *names)."""
    rows = F.array(*[F.struct(F.lit(c).alias("outcome"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, c in enumerate(cols)])
    return df.select(*keep, F.explode(rows).alias("_o")).select("_o.outcome", *keep, *[f"_o.{n}" for n in names])


def _r(n, sx, sy, sxx, syy, sxy) -> Column:
    num = n * sxy - sx * sy
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return num / F.nullif(den, F.lit(0.0))


def correlate(feats: DataFrame, outcomes: DataFrame, outcome_cols, groups: DataFrame | None = None,
              value_col: str = "group_norm", with_p: bool = True) -> DataFrame:
    """Pearson r of each feature with each outcome over all groups with the outcome.

    ``groups`` (``group_id``) restricts the population; default: groups that
    appear in ``feats``.  Columns: outcome, feat, r, n, freq, t[, p].
    """
    if groups is None:
        groups = feats.select("group_id").distinct()
    outcome_cols = list(outcome_cols)
    y = wide_outcomes(outcomes, outcome_cols).join(groups, "group_id", "left_semi")
    ys = [F.col(f"_y{i}") for i in range(len(outcome_cols))]
    ystats = by_outcome(y.agg(*[c for i, v in enumerate(ys) for c in (
        F.count(v).alias(f"n_{i}"), F.sum(v).alias(f"sy_{i}"), F.sum(v * v).alias(f"syy_{i}"))]), outcome_cols, ("n", "sy", "syy"), ())
    x = feats.select("group_id", "feat", F.col(value_col).alias("x"))
    aggs = []
    for i, v in enumerate(ys):
        at = F.when(v.isNotNull(), F.col("x"))
        aggs += [F.count(v).alias(f"k_{i}"), F.sum(at).alias(f"sx_{i}"), F.sum(at * at).alias(f"sxx_{i}"), F.sum(at * v).alias(f"sxy_{i}"),
                 F.count(F.when(at > 0, 1)).alias(f"freq_{i}")]
    xy = by_outcome(x.join(y, "group_id").groupBy("feat").agg(*aggs), outcome_cols, ("k", "sx", "sxx", "sxy", "freq")).where(F.col("k") > 0)
    # ystats has one row per outcome: broadcasting it is bounded by the outcome count
    j = xy.join(F.broadcast(ystats), "outcome")
    n = F.col("n").cast("double")
    r = _r(n, F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.col("sxy"))
    out = j.select("outcome", "feat", r.alias("r"), F.col("n").cast("bigint").alias("n"),
                   F.col("freq").cast("bigint").alias("freq"))
    out = out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))))
    if with_p:
        out = out.withColumn("p", t_pvalue(F.col("t"), (F.col("n") - 2).cast("double")))
    return out


def corr_ci(corrs: DataFrame, z: float = 1.96) -> DataFrame:
    """Fisher-z confidence interval ``tanh(atanh r -+ z/sqrt(n-3))``."""
    at = F.atanh(F.col("r"))
    se = F.lit(1.0) / F.sqrt(F.col("n") - F.lit(3.0))
    return corrs.withColumn("ci_lo", F.tanh(at - F.lit(z) * se)).withColumn("ci_hi", F.tanh(at + F.lit(z) * se))


def correlate_controls(feats: DataFrame, outcomes: DataFrame, outcome_cols, controls: DataFrame,
                       control_cols, groups: DataFrame | None = None,
                       value_col: str = "group_norm", with_p: bool = True) -> DataFrame:
    """Partial association of each feature with each outcome given controls.

    Frisch-Waugh from sums: with ``Z = [1, C]`` the per-outcome ``Z'Z`` and
    ``Z'y`` are small (controls + 1) and solved on the driver; one shuffle
    gives per (feat, outcome) ``Sx, Sxx, Sxy, Sxc_j``.  Returns the partial
    r, the standardized partial coefficient ``beta`` (b_x * sd_x / sd_y), t
    with ``N - 2 - c`` degrees of freedom, and p.
    """
    control_cols = list(control_cols)
    c = len(control_cols)
    if groups is None:
        groups = feats.select("group_id").distinct()
    ctl = controls.select("group_id", *[F.col(k).cast("double").alias(f"_c{i}") for i, k in enumerate(control_cols)])
    ctl = ctl.na.drop()
    y = long_outcomes(outcomes, outcome_cols).join(groups, "group_id", "left_semi").join(ctl, "group_id")
    zc = [F.lit(1.0)] + [F.col(f"_c{i}") for i in range(c)]
    # per-outcome moments of Z = [1, C] and y (bounded: (c+2)^2 numbers per outcome)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy")]
    for i in range(c + 1):
        aggs.append(F.sum(zc[i] * F.col("y")).alias(f"zy{i}"))
        for k in range(i, c + 1):
            aggs.append(F.sum(zc[i] * zc[k]).alias(f"zz{i}_{k}"))
    mom = y.groupBy("outcome").agg(*aggs).collect()
    rows = []
    for m in mom:
        zz = np.zeros((c + 1, c + 1))
        for i in range(c + 1):
            for k in range(i, c + 1):
                zz[i, k] = zz[k, i] = m[f"zz{i}_{k}"]
        zy = np.array([m[f"zy{i}"] for i in range(c + 1)])
        inv = np.linalg.pinv(zz)
        eyy = float(m["syy"] - zy @ inv @ zy)
        n = int(m["n"])
        vy = (m["syy"] - m["sy"] ** 2 / n) / n
        rows.append([m["outcome"], n, eyy, float(np.sqrt(max(vy, 0.0)))] + list(map(float, inv.ravel()))
                    + list(map(float, inv @ zy)))
    schema = ("outcome string, n long, eyy double, sdy double, "
              + ", ".join(f"inv{i} double" for i in range((c + 1) ** 2)) + ", "
              + ", ".join(f"iy{i} double" for i in range(c + 1)))
    ostats = feats.sparkSession.createDataFrame(rows, schema)
    x = feats.select("group_id", "feat", F.col(value_col).alias("x"))
    outcome_cols = list(outcome_cols)
    wide = wide_outcomes(outcomes, outcome_cols).join(groups, "group_id", "left_semi").join(ctl, "group_id")
    xaggs = []
    for o in range(len(outcome_cols)):
        v = F.col(f"_y{o}")
        at = F.when(v.isNotNull(), F.col("x"))
        xaggs += [F.count(v).alias(f"k_{o}"), F.sum(at).alias(f"zx0_{o}"), F.sum(at ** 2).alias(f"sxx_{o}"), F.sum(at * v).alias(f"sxy_{o}"),
                  F.count(F.when(at > 0, 1)).alias(f"freq_{o}")]
        xaggs += [F.sum(at * F.col(f"_c{i}")).alias(f"zx{i + 1}_{o}") for i in range(c)]
    xy = by_outcome(x.join(wide, "group_id").groupBy("feat").agg(*xaggs), outcome_cols,
                    ("k", "sxx", "sxy", "freq", *[f"zx{i}" for i in range(c + 1)])).where(F.col("k") > 0)
    j = xy.join(F.broadcast(ostats), "outcome")
    # quadratic forms with the small inverse
    zx = [F.col(f"zx{i}") for i in range(c + 1)]
    quad_xx = sum(zx[i] * F.col(f"inv{i * (c + 1) + k}") * zx[k] for i in range(c + 1) for k in range(c + 1))
    quad_xy = sum(zx[i] * F.col(f"iy{i}") for i in range(c + 1))
    exx = F.col("sxx") - quad_xx
    exy = F.col("sxy") - quad_xy
    n = F.col("n").cast("double")
    sdx = F.sqrt((F.col("sxx") - zx[0] * zx[0] / n) / n)
    out = j.select("outcome", "feat", F.col("n"), F.col("freq").cast("bigint").alias("freq"),
                   (exy / F.sqrt(F.nullif(exx * F.col("eyy"), F.lit(0.0)))).alias("r"),
                   (exy / F.nullif(exx, F.lit(0.0)) * sdx / F.nullif(F.col("sdy"), F.lit(0.0))).alias("beta"))
    dfree = F.col("n") - F.lit(2 + c)
    out = out.withColumn("t", F.col("r") * F.sqrt(dfree / F.nullif(1 - F.col("r") ** 2, F.lit(0.0))))
    if with_p:
        out = out.withColumn("p", t_pvalue(F.col("t"), dfree.cast("double")))
    return out
