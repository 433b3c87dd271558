"""Multiple-comparison corrections of p-values, per outcome.

Ranks come from the distributed rank-within-class (ties by feature name);
the step-down / step-up procedures are distributed running max / min
(``ranks.running_extreme``), so no task ever holds all features of an
outcome.  Hommel's correction needs the lower convex hull of the sorted p-values
only (Meijer, Krebs and Goeman, 2019): the hulls of parts are merged per outcome, and every
p-value is then corrected by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glossa.operators.ranks import rank_within, running_extreme

METHODS = ("none", "bonferroni", "holm", "hochberg", "hommel", "simes", "BH", "fdr_bh", "BY")


def p_adjust(df: DataFrame, method: str = "BH", p_col: str = "p", by: str = "outcome",
             order_col: str = "feat", out_col: str = "p_adj") -> DataFrame:
    return p_adjust_many(df, {out_col: method}, p_col, by, order_col)


def p_adjust_many(df: DataFrame, methods: dict, p_col: str = "p", by: str = "outcome",
                  order_col: str = "feat") -> DataFrame:
    """Several corrections ``{out_col: method}`` sharing one ranking pass.

    A null p-value (a constant feature) is no test: it is left out of the
    number of tests and of the ranking, and its corrected value is null."""
    known = df.where(F.col(p_col).isNotNull())
    absent = df.where(F.col(p_col).isNull())
    r = rank_within(known, [by], [F.col(p_col), F.col(order_col)], "_i")   # reads its pinned copy
    m = r.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("_m"))   # one row per outcome
    d = r.join(F.broadcast(m), by)
    d = d.withColumn("_i", F.col("_i").cast("double"))
    for out_col, method in methods.items():
        d = _one(d, method, p_col, by, order_col, out_col)
    d = d.drop("_m", "_i")
    return d.unionByName(absent.withColumns({c: F.lit(None).cast("double") for c in methods}).select(*d.columns))


def _one(d: DataFrame, method: str, p_col: str, by: str, order_col: str, out_col: str) -> DataFrame:
    if method in ("none", None):
        return d.withColumn(out_col, F.col(p_col))
    order = [F.col(p_col), F.col(order_col)]
    p = F.col(p_col)
    if method == "hommel":
        return _hommel(d, p_col, by, out_col)
    if method == "bonferroni":
        return d.withColumn(out_col, F.least(F.lit(1.0), F.col("_m") * p))
    if method == "holm":
        d = d.withColumn("_v", (F.col("_m") - F.col("_i") + 1) * p)
        r = running_extreme(d, [by], order, "_v", "max", "prefix", "_r")
    elif method == "hochberg":
        d = d.withColumn("_v", (F.col("_m") - F.col("_i") + 1) * p)
        r = running_extreme(d, [by], order, "_v", "min", "suffix", "_r")
    elif method in ("BH", "fdr_bh", "simes", "fdr"):
        d = d.withColumn("_v", F.col("_m") * p / F.col("_i"))
        r = running_extreme(d, [by], order, "_v", "min", "suffix", "_r")
    elif method == "BY":
        h = d.groupBy(by).agg(F.sum(F.lit(1.0) / F.col("_i")).alias("_h"))    # harmonic number of m
        d = d.join(F.broadcast(h), by).withColumn("_v", F.col("_h") * F.col("_m") * p / F.col("_i"))
        r = running_extreme(d, [by], order, "_v", "min", "suffix", "_r").drop("_h")
    else:
        raise ValueError(f"unknown correction {method!r}")
    return r.withColumn(out_col, F.least(F.lit(1.0), F.col("_r"))).drop("_v", "_r")


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the vertices of the lower convex hull of points in ascending ``x``."""
    out: list[int] = []
    for i in range(len(x)):
        while len(out) > 1:
            a, b = out[-2], out[-1]
            if (y[b] - y[a]) * (x[i] - x[a]) < (y[i] - y[a]) * (x[b] - x[a]):
                break
            out.pop()
        out.append(i)
    return np.array(out, int)


def hommel_from_hull(p: np.ndarray, m: float, hx: np.ndarray, hy: np.ndarray) -> np.ndarray:
    """Hommel's corrected values of ``p`` among ``m`` tests, given the lower hull of
    (rank, p) of all of them.

    With alpha(i) = min over ranks k > m - i of i p(k) / (k - m + i), which falls with i, the largest i with
    i p < alpha(i) gives the corrected value max(alpha(i + 1), i p)."""
    def alpha(i: np.ndarray) -> np.ndarray:
        """alpha at whole i from 1 to m: the tangent from (m - i, 0) to the hull."""
        x0 = m - i
        low = np.searchsorted(hx, x0, side="right")
        high = np.full(len(i), len(hx) - 1)
        low = np.minimum(low, high)
        while (low < high).any():       # slopes from a point below fall, then rise along the hull
            mid = (low + high) // 2
            nxt = np.minimum(mid + 1, len(hx) - 1)
            falls = hy[nxt] * (hx[mid] - x0) < hy[mid] * (hx[nxt] - x0)
            open_ = low < high
            low, high = np.where(open_ & falls, nxt, low), np.where(open_ & ~falls, mid, high)
        return i * hy[low] / (hx[low] - x0)
    low, high = np.zeros(len(p)), np.full(len(p), float(m))
    while (low < high).any():
        mid = np.ceil((low + high) / 2)
        ok = mid * p < alpha(np.maximum(mid, 1))
        open_ = low < high
        low, high = np.where(open_ & ok, mid, low), np.where(open_ & ~ok, mid - 1, high)
    above = np.where(low < m, alpha(np.minimum(low + 1, m)), 0.0)
    return np.minimum(1.0, np.maximum(above, low * p))


def _hulls(batches):
    """The hull of each outcome's points in a task, batch by batch."""
    kept: dict = {}
    for b in batches:
        by, x, y = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(), b.column(2).to_numpy()
        for k in dict.fromkeys(by.tolist()):
            at = by == k
            ox, oy = kept.get(k, (np.empty(0), np.empty(0)))
            ax, ay = np.r_[ox, x[at]], np.r_[oy, y[at]]
            order = np.argsort(ax, kind="stable")
            ax, ay = ax[order], ay[order]
            v = lower_hull(ax, ay)
            kept[k] = ax[v], ay[v]
    for k, (x, y) in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(x)), pa.array(x), pa.array(y)], ["by", "x", "y"])


def _hommel(d: DataFrame, p_col: str, by: str, out_col: str) -> DataFrame:
    """Hull vertices of all parts go to the driver (few for unrelated p-values, at most one a test),
    which merges them per outcome."""
    spark = d.sparkSession
    kind = dict(d.dtypes)[by]
    parts = d.select(F.col(by).alias("by"), F.col("_i").alias("x"), F.col(p_col).alias("y")).mapInArrow(_hulls, f"by {kind}, x double, y double")
    found: dict = {}
    for r in parts.toLocalIterator():
        found.setdefault(r["by"], []).append((r["x"], r["y"]))
    hulls = {}
    for k, points in found.items():
        a = np.array(sorted(points))
        v = lower_hull(a[:, 0], a[:, 1])
        hulls[k] = a[v, 0], a[v, 1]
    bc = spark.sparkContext.broadcast(hulls)
    cols = d.columns
    schema = StructType([*d.schema.fields, StructField(out_col, DoubleType())])
    key, p, m = cols.index(by), cols.index(p_col), cols.index("_m")

    def run(batches):
        for b in batches:
            k, out = np.array(b.column(key).to_pylist(), object), np.empty(b.num_rows)
            for one in dict.fromkeys(k.tolist()):
                at = k == one
                out[at] = hommel_from_hull(b.column(p).to_numpy()[at], b.column(m).to_numpy()[at][0], *bc.value[one])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*cols, out_col])
    return d.mapInArrow(run, schema)
