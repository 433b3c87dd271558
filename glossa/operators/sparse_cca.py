"""Canonical correlation with L1 bounds between features and a few columns.

The penalized matrix decomposition (Witten, Tibshirani and Hastie, 2009) of the cross-covariance K of the
standardized features (rows of a ``SparseDesign``) and the standardized columns (its
outcomes, or any others given as such, controls among them): u and v of length 1 with |u|_1 <= c sqrt(p) and
|v|_1 <= c' sqrt(q) that maximize u'Kv, by soft-thresholded power steps, the threshold found by
bisection; further pairs after taking d u v' off K.

K is one pass over the rows (p x q numbers).  For permutation tests the columns' rows are dealt anew
with keyed permutations of the groups' order; a group carries its columns under all
permutations as one array, so all permuted K are one pass too.  Groups that lack one of the columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.operators.folds import hash_order
from glossa.operators.ranks import global_rank, materialize
from glossa.operators.sparse import Rows, SparseDesign, column_sd, summed


@dataclass
class Pairs:
    u: np.ndarray           # p x components, of standardized columns
    v: np.ndarray           # q x components
    d: np.ndarray           # u'Kv
    correlation: np.ndarray     # of the scores
    mean: np.ndarray
    inv: np.ndarray         # one over the features' sd (0: constant)


def _shrunk(a: np.ndarray, bound: float) -> np.ndarray:
    """a, soft-thresholded so far that it has |.|_1 <= bound at length 1."""
    size = np.linalg.norm(a)
    if size == 0:
        return a
    if np.abs(a).sum() / size <= bound:
        return a / size
    low, high = 0.0, np.abs(a).max()
    for _ in range(100):
        mid = (low + high) / 2
        s = np.sign(a) * np.maximum(np.abs(a) - mid, 0)
        n = np.linalg.norm(s)
        if n == 0 or np.abs(s).sum() / n <= bound:
            high = mid
        else:
            low = mid
    s = np.sign(a) * np.maximum(np.abs(a) - high, 0)
    n = np.linalg.norm(s)
    if n == 0:      # several entries of the same greatest size: one of them
        s = np.zeros_like(a)
        s[np.argmax(np.abs(a))] = np.sign(a[np.argmax(np.abs(a))])
        return s
    return s / n


def decompose(K: np.ndarray, bound_u: float, bound_v: float, components: int, steps: int = 200, tol: float = 1e-9) -> tuple:
    """(u, v, d) of the leading pairs; signs so that v's largest entry is positive."""
    K = K.copy()
    p, q = K.shape
    us, vs, ds = [], [], []
    for _ in range(min(components, p, q)):
        v = np.linalg.svd(K, full_matrices=False)[2][0] if p and q else np.zeros(q)
        u = np.zeros(p)
        for _ in range(steps):
            new = _shrunk(K @ v, bound_u)
            v = _shrunk(K.T @ new, bound_v)
            moved, u = np.abs(new - u).max(initial=0.0), new
            if moved <= tol:
                break
        if v[np.argmax(np.abs(v))] < 0:
            u, v = -u, -v
        d = float(u @ K @ v)
        K -= d * np.outer(u, v)
        us.append(u)
        vs.append(v)
        ds.append(d)
    return np.array(us).T.reshape(p, -1), np.array(vs).T.reshape(q, -1), np.array(ds)


def _turned(right: np.ndarray, key: int, turn: int) -> np.ndarray:
    h = (right + np.uint64((key * 6 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def permuted_places(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1 (a Feistel network over the next even number of bits; values
    beyond n are sent through again), or with ``back`` its inverse."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for turn in reversed(range(6)) if back else range(6):
                if back:
                    left, right = right ^ (_turned(left, key, turn) & mask), left
                else:
                    left, right = right, left ^ (_turned(right, key, turn) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = out >= np.uint64(n)
    return out.astype(np.int64)


def _complete(design: SparseDesign) -> DataFrame:
    return design.rows.where(" AND ".join(["TRUE"] + [f"y[{i}] IS NOT NULL" for i in range(len(design.outcomes))]))


def _with_permutations(design: SparseDesign, perms: int, seed: int) -> DataFrame:
    """The complete rows, y followed by the columns of the group that each permutation assigns."""
    rows = _complete(design).withColumn("_h", hash_order("group_id", seed))
    ranked = materialize(global_rank(rows, [F.col("_h"), F.col("group_id")], "_i").drop("_h"))
    return materialize(_dealt(ranked, ranked.count(), perms, seed))


def _dealt(ranked: DataFrame, n: int, perms: int, seed: int) -> DataFrame:
    """The ranked rows with y of the group at each permutation's place after their own.  A group sends its y to
    the rows that it is assigned to, so the n x perms rows pass one shuffle and meet in no join, and what is joined is
    never broadcast: the size of exploded rows isn't known beforehand."""
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def places(i):
        import pandas as pd
        a = i.to_numpy() - 1
        return pd.Series(list(np.stack([permuted_places(a, n, seed * 1_000_003 + r, back=True) for r in range(perms)], 1)))
    given = ranked.select(F.col("y").alias("of"), F.posexplode(places("_i")).alias("r", "i"))
    arrays = (given.groupBy((F.col("i") + 1).alias("_i")).agg(F.sort_array(F.collect_list(F.struct("r", "of"))).alias("a"))
              .select("_i", F.flatten(F.col("a.of")).alias("more")))
    return ranked.join(arrays.hint("merge"), "_i").select("group_id", "fold", "idx", "val", F.concat("y", "more").alias("y"))


def _cross(rows: DataFrame, p: int, width: int) -> tuple:
    """(n, mean and 1 / sd of the features, K of standardized columns: p x width)."""
    def work(r: Rows, total: np.ndarray) -> None:
        one = np.ones((r.n, 1))
        total[0, 0] += r.n
        total[1, :width] += r.y.sum(0)
        total[2, :width] += (r.y ** 2).sum(0)
        x = total[3:]
        r.add_transposed(r.y, x[:, :width])
        r.add_transposed(one, x[:, width:width + 1])
        r.add_transposed(one, x[:, width + 1:], 2)
    s = summed(rows, work, p + 3, width + 2)
    n = max(s[0, 0], 1)
    my, sy = s[1, :width] / n, column_sd(s[1, :width] / n, s[2, :width] / n)
    mean, second = s[3:, width] / n, s[3:, width + 1] / n
    sd = column_sd(mean, second)
    inv = np.divide(1.0, sd, out=np.zeros(p), where=sd > 0)
    iy = np.divide(1.0, sy, out=np.zeros(width), where=sy > 0)
    return n, mean, inv, (s[3:, :width] / n - np.outer(mean, my)) * inv[:, None] * iy


def _correlations(design: SparseDesign, rows: DataFrame, mean, inv, u, v) -> np.ndarray:
    """Correlation of each pair's scores."""
    k, q = u.shape[1], len(design.outcomes)
    w = u * inv[:, None]

    def work(r: Rows, total: np.ndarray) -> None:
        a, y = r.times(w) - mean @ w, r.y[:, :q]
        total[0, 0] += r.n
        total[1, :k] += a.sum(0)
        total[2, :k] += (a ** 2).sum(0)
        total[3, :q] += y.sum(0)
        total[4:4 + q, :q] += y.T @ y
        total[4 + q:, :q] += a.T @ y
    s = summed(rows, work, 4 + q + k, max(k, q))
    n = max(s[0, 0], 1)
    my = s[3, :q] / n
    cyy = s[4:4 + q, :q] / n - np.outer(my, my)
    sy = np.sqrt(np.maximum(np.diag(cyy), 0))
    vy = v * np.divide(1.0, sy, out=np.zeros(q), where=sy > 0)[:, None]
    cay = s[4 + q:, :q] / n - np.outer(s[1, :k] / n, my)
    va = s[2, :k] / n - (s[1, :k] / n) ** 2
    vv = np.einsum("ik,ij,jk->k", vy, cyy, vy)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((va > 0) & (vv > 0), (cay * vy.T).sum(1) / np.sqrt(va * vv), np.nan)


def penalized_cca(design: SparseDesign, components: int = 2, penalty_x: float = 0.3, penalty_y: float = 1.0) -> Pairs:
    """The leading pairs; a penalty is the share of sqrt(number of columns) that an L1 norm may reach."""
    rows = _complete(design)
    _, mean, inv, K = _cross(rows, design.p, len(design.outcomes))
    u, v, d = decompose(K, max(1.0, penalty_x * np.sqrt(design.p)), max(1.0, penalty_y * np.sqrt(len(design.outcomes))), components)
    return Pairs(u, v, d, _correlations(design, rows, mean, inv, u, v), mean, inv)


def permutation_table(design: SparseDesign, penalties=(0.1, 0.3, 0.5, 0.7, 0.9), perms: int = 100, penalty_y: float | None = None, seed: int = 1) -> list:
    """(penalty, d, mean and sd of the permuted d, z, p) of the
    first pair for each penalty; the best one has the greatest z."""
    q = len(design.outcomes)
    rows = _with_permutations(design, perms, seed)
    _, _, _, K = _cross(rows, design.p, q * (perms + 1))
    out = []
    for pen in penalties:
        bounds = max(1.0, pen * np.sqrt(design.p)), max(1.0, (pen if penalty_y is None else penalty_y) * np.sqrt(q))
        d = np.array([decompose(K[:, i * q:(i + 1) * q], *bounds, 1)[2].sum() for i in range(perms + 1)])
        sd = float(d[1:].std())
        out.append((float(pen), float(d[0]), float(d[1:].mean()), sd, float((d[0] - d[1:].mean()) / sd) if sd > 0 else None,
                    float((1 + (d[1:] >= d[0]).sum()) / (perms + 1))))
    return out


def pair_weights(design: SparseDesign, pairs: Pairs) -> DataFrame:
    """(component, side, name, weight): non-zero weights of features and columns."""
    spark = design.rows.sparkSession
    x = [(j, int(i), float(pairs.u[i, j])) for j in range(pairs.u.shape[1]) for i in np.flatnonzero(pairs.u[:, j])]
    y = [(j, "column", design.outcomes[i], float(pairs.v[i, j])) for j in range(pairs.v.shape[1]) for i in np.flatnonzero(pairs.v[:, j])]
    xs = spark.createDataFrame(x, "component int, idx int, weight double").join(design.names(), "idx").select(
        "component", F.lit("feature").alias("side"), F.col("feat").alias("name"), "weight")
    return xs.unionByName(spark.createDataFrame(y, "component int, side string, name string, weight double"))
