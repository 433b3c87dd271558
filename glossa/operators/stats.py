"""Rank, contrast and mediation statistics over long feature tables (2.9).

All statistics treat an absent (group, feature) cell as 0 and never build
the dense matrix: the zero block of each feature is handled in closed form
from per-outcome totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.correlate import by_outcome, long_outcomes, wide_outcomes
from glossa.operators.ranks import materialize, running_sums, tie_ranks

# Polynomial coefficients of the normal-tail approximation used
# by the Fisher r-to-z comparison (Abramowitz and Stegun 26.2.19), in order
# of increasing power: .049867347, .0211410061, .0032776263, .0000380036,
# .0000488906, .000005383; p2 = poly(|z|) ** -16, one tail = p2 / 2.
NORMAL_POLY = (0.049867347, 0.0211410061, 0.0032776263, 0.0000380036, 0.0000488906, 0.000005383)


def normal_p2_approx(z: Column) -> Column:
    """Two-tailed normal p from the polynomial approximation."""
    a = F.abs(z)
    acc = F.lit(NORMAL_POLY[5])
    for c in reversed(NORMAL_POLY[:5]):
        acc = acc * a + F.lit(c)
    acc = acc * a + F.lit(1.0)
    return F.pow(acc, F.lit(-16.0))


def fisher_z_compare(r1: Column, r2: Column, n1: Column, n2: Column) -> tuple:
    """z of the difference of two correlations and its one-tailed p."""
    z = (F.atanh(r1) - F.atanh(r2)) / F.sqrt(F.lit(1.0) / (n1 - 3) + F.lit(1.0) / (n2 - 3))
    return z, normal_p2_approx(z) / 2


def _prep(feats, outcomes, outcome_cols, groups, value_col):
    if groups is None:
        groups = feats.select("group_id").distinct()
    y = long_outcomes(outcomes, outcome_cols).join(groups, "group_id", "left_semi")
    x = feats.select("group_id", "feat", F.col(value_col).alias("x")).where(F.col("x") != 0)
    return x, y, wide_outcomes(outcomes, outcome_cols).join(groups, "group_id", "left_semi")


def _value_sums(x: DataFrame, wide: DataFrame, outcome_cols: list) -> DataFrame:
    """(outcome, feat, x, c, sy, rx) for each distinct value of a feature: its groups, the sum of their outcome and
    their average rank.  All sums over groups follow from these, so no rank goes back to the groups' rows."""
    k = range(len(outcome_cols))
    per = x.join(wide, "group_id").groupBy("feat", "x").agg(*[a for i in k for a in (
        F.count(f"_y{i}").cast("double").alias(f"c_{i}"), F.sum(f"_y{i}").alias(f"sy_{i}"))])
    per = running_sums(per, ["feat"], [F.col("x")], {f"below_{i}": f"c_{i}" for i in k}, inclusive=False)
    rows = by_outcome(per, outcome_cols, ("c", "sy", "below"), ("feat", "x")).where(F.col("c") > 0)
    return rows.withColumn("rx", F.col("below") + (F.col("c") + 1) / 2.0)


def spearman(feats: DataFrame, outcomes: DataFrame, outcome_cols, groups: DataFrame | None = None,
             value_col: str = "group_norm") -> DataFrame:
    """Spearman rho per (outcome, feature) with absent = 0.

    The zero block of size ``z = N - nnz`` stands after the ``neg`` negative
    values, at average rank ``neg + (z+1)/2``; positive values rank ``z``
    higher than among the present rows.
    """
    outcome_cols = list(outcome_cols)
    x, y, wide = _prep(feats, outcomes, outcome_cols, groups, value_col)
    ranks = materialize(tie_ranks(y, ["outcome"], "y", "ry"))
    for i, o in enumerate(outcome_cols):
        wide = wide.join(ranks.where(F.col("outcome") == o).select(F.col("y").alias(f"_y{i}"), F.col("ry").alias(f"_r{i}")), f"_y{i}", "left")
    wide = materialize(wide.select("group_id", *[F.col(f"_r{i}").alias(f"_y{i}") for i in range(len(outcome_cols))]))
    rys = [F.col(f"_y{i}") for i in range(len(outcome_cols))]
    ys = by_outcome(wide.agg(*[c for i, v in enumerate(rys) for c in (
        F.count(v).alias(f"n_{i}"), F.sum(v).alias(f"sry_{i}"), F.sum(v ** 2).alias(f"sry2_{i}"))]), outcome_cols, ("n", "sry", "sry2"), ())
    a = _value_sums(x, wide, outcome_cols).groupBy("outcome", "feat").agg(
        F.sum("c").alias("nnz"), F.sum(F.col("c") * F.col("rx") ** 2).alias("s2"),
        F.sum(F.col("rx") * F.col("sy")).alias("sxy"), F.sum("sy").alias("sy_nz"),
        F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("c"))), F.lit(0.0)).alias("neg"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("c"))), F.lit(0.0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("c") * F.col("rx"))), F.lit(0.0)).alias("s1p"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("sy"))), F.lit(0.0)).alias("syp"))
    j = a.join(F.broadcast(ys), "outcome")
    n = F.col("n").cast("double")
    z = n - F.col("nnz")
    r0 = F.col("neg") + (z + 1) / 2
    srx = n * (n + 1) / 2
    srx2 = F.col("pos") * z * z + 2 * z * F.col("s1p") + F.col("s2") + z * r0 * r0
    srxy = z * F.col("syp") + F.col("sxy") + r0 * (F.col("sry") - F.col("sy_nz"))
    num = n * srxy - srx * F.col("sry")
    den = F.sqrt((n * srx2 - srx * srx) * (n * F.col("sry2") - F.col("sry") ** 2))
    return j.select("outcome", "feat", (num / F.nullif(den, F.lit(0.0))).alias("rho"),
                    F.col("n").cast("bigint").alias("n"))


def auc(feats: DataFrame, outcomes: DataFrame, outcome_cols, groups: DataFrame | None = None,
        value_col: str = "group_norm") -> DataFrame:
    """AUC of each feature for binary (0/1) outcomes by the rank sum, absent = 0."""
    x, y, wide = _prep(feats, outcomes, outcome_cols, groups, value_col)
    ys = y.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    a = _value_sums(x, wide, list(outcome_cols)).groupBy("outcome", "feat").agg(
        F.sum("c").alias("nnz"), F.sum(F.col("rx") * F.col("sy")).alias("s_pos"), F.sum("sy").alias("nnz_pos"),
        F.coalesce(F.sum(F.when(F.col("x") < 0, F.col("c"))), F.lit(0.0)).alias("neg"),
        F.coalesce(F.sum(F.when(F.col("x") > 0, F.col("sy"))), F.lit(0.0)).alias("high_pos"))
    j = a.join(F.broadcast(ys), "outcome")
    n = F.col("n").cast("double")
    z = n - F.col("nnz")
    r0 = F.col("neg") + (z + 1) / 2       # the zero block, after the negative values
    r1 = z * F.col("high_pos") + F.col("s_pos") + (F.col("n1") - F.col("nnz_pos")) * r0
    n1 = F.col("n1")
    n0 = n - n1
    auc_ = (r1 - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0.0))
    return j.select("outcome", "feat", auc_.alias("auc"), F.col("n").cast("bigint").alias("n"))


def idp(feats: DataFrame, outcomes: DataFrame, outcome_col: str, prior: DataFrame | None = None) -> DataFrame:
    """Weighted log-odds with an informative Dirichlet prior (Monroe et al. 2008).

    Sample 1 = groups with outcome 1, sample 2 = outcome 0; counts are
    ``value``; the prior is the corpus count of each feature in ``prior``
    (default: the whole feature table).
    """
    o = outcomes.select("group_id", F.col(outcome_col).alias("_o")).where(F.col("_o").isNotNull())
    return idp_samples(feats, o.where(F.col("_o") == 1).select("group_id"),
                       o.where(F.col("_o") == 0).select("group_id"), prior)


def idp_samples(feats: DataFrame, groups1: DataFrame, groups2: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    prior = feats if prior is None else prior
    a = prior.groupBy("feat").agg(F.sum("value").alias("a"))
    a0 = float(prior.agg(F.sum("value")).first()[0])
    def side(g, tag):
        s = feats.join(g.select("group_id").distinct(), "group_id", "left_semi")
        tot = float(s.agg(F.sum("value")).first()[0] or 0.0)
        return s.groupBy("feat").agg(F.sum("value").alias(f"y{tag}")), tot
    s1, n1 = side(groups1, 1)
    s2, n2 = side(groups2, 2)
    j = a.join(s1, "feat", "left").join(s2, "feat", "left").fillna(0.0, ["y1", "y2"])
    y1a = F.col("y1") + F.col("a")
    y2a = F.col("y2") + F.col("a")
    delta = (F.log(y1a / (F.lit(n1 + a0) - y1a)) - F.log(y2a / (F.lit(n2 + a0) - y2a)))
    return j.select("feat", delta.alias("delta"),
                    (delta / F.sqrt(F.lit(1.0) / y1a + F.lit(1.0) / y2a)).alias("z"))


def zscore_group(feats: DataFrame, outcomes: DataFrame, flag_col: str, value_col: str = "group_norm") -> DataFrame:
    """z of each feature's mean in the flagged groups against all groups with
    the flag (absent = 0): ``(mean_1 - mean) / sd_pop``."""
    o = outcomes.select("group_id", F.col(flag_col).alias("_f")).where(F.col("_f").isNotNull())
    tot = o.agg(F.count(F.lit(1)).alias("n"), F.sum("_f").alias("n1")).first()
    n, n1 = float(tot["n"]), float(tot["n1"])
    x = feats.select("group_id", "feat", F.col(value_col).alias("x")).join(o, "group_id")
    a = x.groupBy("feat").agg(F.sum("x").alias("s"), F.sum(F.col("x") ** 2).alias("s2"),
                              F.sum(F.col("x") * F.col("_f")).alias("s_1"))
    mean = F.col("s") / n
    sd = F.sqrt(F.col("s2") / n - mean * mean)
    if n1 == 0:
        return a.select("feat", F.lit(None).cast("double").alias("z"))
    return a.select("feat", ((F.col("s_1") / n1 - mean) / F.nullif(sd, F.lit(0.0))).alias("z"))


def ttest_feats(a: DataFrame, b: DataFrame, n_groups: int | None = None, value_col: str = "group_norm") -> DataFrame:
    """Paired t per feature of two feature tables over the same groups
    (absent = 0): ``d = x_a - x_b``, ``t = mean(d) / (sd_samp(d) / sqrt(N))``."""
    if n_groups is None:
        n_groups = a.select("group_id").union(b.select("group_id")).distinct().count()
    n = float(n_groups)
    j = (a.select("group_id", "feat", F.col(value_col).alias("xa"))
         .join(b.select("group_id", "feat", F.col(value_col).alias("xb")), ["group_id", "feat"], "full")
         .select("feat", (F.coalesce("xa", F.lit(0.0)) - F.coalesce("xb", F.lit(0.0))).alias("d")))
    s = j.groupBy("feat").agg(F.sum("d").alias("sd1"), F.sum(F.col("d") ** 2).alias("sd2"))
    mean = F.col("sd1") / n
    var = (F.col("sd2") - F.col("sd1") * F.col("sd1") / n) / (n - 1)
    return s.select("feat", mean.alias("mean_diff"),
                    (mean / F.nullif(F.sqrt(var) / F.lit(n ** 0.5), F.lit(0.0))).alias("t"))


def pairwise_corr(df: DataFrame, cols) -> DataFrame:
    """Pairwise-complete Pearson r for every pair ``a < b`` of wide columns,
    as one aggregate over the wide table (no self-join)."""
    cols = list(cols)
    aggs, pairs = [], []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            xa, xb = F.when(both, F.col(a)), F.when(both, F.col(b))
            k = f"{a}__{b}"
            aggs += [F.count(xa).alias(f"{k}_n"), F.sum(xa).alias(f"{k}_sa"), F.sum(xb).alias(f"{k}_sb"),
                     F.sum(xa * xa).alias(f"{k}_saa"), F.sum(xb * xb).alias(f"{k}_sbb"),
                     F.sum(xa * xb).alias(f"{k}_sab")]
            pairs.append((a, b, k))
    agg = df.agg(*aggs)
    parts = []
    for a, b, k in pairs:
        n = F.col(f"{k}_n").cast("double")
        num = n * F.col(f"{k}_sab") - F.col(f"{k}_sa") * F.col(f"{k}_sb")
        den = F.sqrt((n * F.col(f"{k}_saa") - F.col(f"{k}_sa") ** 2) * (n * F.col(f"{k}_sbb") - F.col(f"{k}_sb") ** 2))
        parts.append(F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                              (num / F.nullif(den, F.lit(0.0))).alias("r"), F.col(f"{k}_n").alias("n")))
    return agg.select(F.explode(F.array(*parts)).alias("s")).select("s.*")


def mediation_sobel(feats: DataFrame, data: DataFrame, x_col: str, y_col: str,
                    value_col: str = "group_norm") -> DataFrame:
    """Baron-Kenny paths with each feature as the mediator (absent = 0).

    a: M ~ X; (b, c'): Y ~ X + M; c: Y ~ X; Sobel ``z = ab / sqrt(b^2 se_a^2 + a^2 se_b^2)``.
    Population: rows of ``data`` (group_id, X, Y) with both values.
    """
    d = data.select("group_id", F.col(x_col).alias("X"), F.col(y_col).alias("Y")).na.drop()
    t = d.agg(F.count(F.lit(1)).alias("n"), F.sum("X").alias("sx"), F.sum("Y").alias("sy"),
              F.sum(F.col("X") ** 2).alias("sxx"), F.sum(F.col("Y") ** 2).alias("syy"),
              F.sum(F.col("X") * F.col("Y")).alias("sxy")).first()
    n = float(t["n"])
    cxx = t["sxx"] - t["sx"] ** 2 / n
    cyy = t["syy"] - t["sy"] ** 2 / n
    cxy = t["sxy"] - t["sx"] * t["sy"] / n
    m = feats.select("group_id", "feat", F.col(value_col).alias("M")).join(d, "group_id")
    a = m.groupBy("feat").agg(F.sum("M").alias("sm"), F.sum(F.col("M") ** 2).alias("smm"),
                              F.sum(F.col("M") * F.col("X")).alias("sxm"), F.sum(F.col("M") * F.col("Y")).alias("smy"))
    cmm = F.col("smm") - F.col("sm") ** 2 / n
    cxm = F.col("sxm") - F.lit(t["sx"]) * F.col("sm") / n
    cmy = F.col("smy") - F.col("sm") * F.lit(t["sy"]) / n
    pa = cxm / F.nullif(F.lit(cxx), F.lit(0.0))
    sse_a = cmm - pa * cxm
    se_a = F.sqrt(sse_a / (n - 2) / F.nullif(F.lit(cxx), F.lit(0.0)))
    det = F.lit(cxx) * cmm - cxm * cxm
    pb = (F.lit(cxx) * cmy - cxm * F.lit(cxy)) / F.nullif(det, F.lit(0.0))
    pc_ = (cmm * F.lit(cxy) - cxm * cmy) / F.nullif(det, F.lit(0.0))
    sse = F.lit(cyy) - pb * cmy - pc_ * F.lit(cxy)
    se_b = F.sqrt(sse / (n - 3) * F.lit(cxx) / F.nullif(det, F.lit(0.0)))
    c = cxy / cxx if cxx else None
    sobel = pa * pb / F.nullif(F.sqrt(pb * pb * se_a * se_a + pa * pa * se_b * se_b), F.lit(0.0))
    cl = F.lit(c).cast("double")
    return a.select("feat", pa.alias("a"), pb.alias("b"), pc_.alias("c_prime"), cl.alias("c"),
                    sobel.alias("sobel_z"), (pa * pb / F.nullif(cl, F.lit(0.0))).alias("prop_mediated"))
