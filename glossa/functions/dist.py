"""Tail probabilities for t, F and normal statistics.

Spark has no Student-t / F distribution functions, so these run as
Arrow-batched pandas UDFs.  They are only ever applied to *result* tables
(one row per feature x outcome), never to group-level data.  The kernel is
the regularized incomplete beta function evaluated by the modified Lentz
continued fraction, vectorized over the batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _betacf(a, b, x, iters: int = 400, eps: float = 3e-16):
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2.0 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        de = d * c
        h = h * de
        if np.all(np.abs(de - 1.0) < eps):
            break
    return h


def betainc(a, b, x) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) for arrays (NaN propagates)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lbt = (_lgamma(am + bm) - _lgamma(am) - _lgamma(bm)
               + am * np.log(xm) + bm * np.log1p(-xm))
        bt = np.exp(lbt)
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty_like(xm)
        if direct.any():
            res[direct] = bt[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        inv = ~direct
        if inv.any():
            res[inv] = 1.0 - bt[inv] * _betacf(bm[inv], am[inv], 1.0 - xm[inv]) / bm[inv]
        out[mid] = res
    return out


def t_sf2(t, df) -> np.ndarray:
    """Two-tailed p of a Student-t statistic."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df / (df + t * t)
    p = betainc(df / 2.0, 0.5, x)
    return np.where(np.isinf(t), 0.0, p)


def f_sf(f, df1, df2) -> np.ndarray:
    """Upper tail of an F(df1, df2) statistic."""
    f = np.asarray(f, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df2 / (df2 + df1 * f)
    return betainc(np.asarray(df2, float) / 2.0, np.asarray(df1, float) / 2.0, x)


def norm_sf2(z) -> np.ndarray:
    """Two-tailed p of a standard normal statistic."""
    z = np.asarray(z, dtype=float)
    return _erfc(np.abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t.to_numpy(dtype=float, na_value=np.nan),
                           df.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(dtype=float, na_value=np.nan),
                          df1.to_numpy(dtype=float, na_value=np.nan),
                          df2.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(T.DoubleType())
def norm_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf2(z.to_numpy(dtype=float, na_value=np.nan)))
