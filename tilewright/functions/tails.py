"""Tail probabilities of aggregated test statistics.

Spark has no error, beta or gamma functions, so these are the only Python functions of the package: Arrow-batched, and
applied to result rows (one per test), never to observations.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ship the functions themselves, so that executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _normal(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2.0))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (DLMF 8.17.22), evaluated from the tail inwards."""
    f = np.ones_like(x)
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1.0 + even / (1.0 + odd / f)
    first = -(a + b) * x / (a + 1.0)
    return 1.0 / (1.0 + first / f)


def _beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        part = np.where(z <= 0, 0.0, front * _beta_fraction(p, q, z))
    return np.where(swap, 1.0 - part, part)


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, Lentz continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = acc = 1.0 / a
        n = a
        while term > acc * 1e-16:
            n += 1.0
            term *= x / n
            acc += term
        return max(0.0, 1.0 - acc * front)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided standard normal tail."""
    return pd.Series(_normal(z.to_numpy(dtype=float, na_value=np.nan)))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t tail."""
    t, v = t.to_numpy(dtype=float, na_value=np.nan), df.to_numpy(dtype=float, na_value=np.nan)
    ok = np.isfinite(t) & np.isfinite(v) & (v > 0)
    out = np.full(len(t), np.nan)
    tt, vv = t[ok], v[ok]
    out[ok] = _beta_cdf(vv / 2.0, np.full_like(vv, 0.5), vv / (vv + tt * tt))
    return pd.Series(out).where(np.isfinite(out), None)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper chi-square tail."""
    out = [
        None if not (math.isfinite(a) and math.isfinite(b) and b > 0) else _gamma_upper(b / 2.0, a / 2.0)
        for a, b in zip(x.astype(float), df.astype(float))
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def hypergeom_p(hits: pd.Series, drawn: pd.Series, marked: pd.Series, universe: pd.Series) -> pd.Series:
    """P(X >= hits) for ``drawn`` out of ``universe`` with ``marked`` marked."""
    out = []
    for k, n, m, u in zip(hits, drawn, marked, universe):
        k, n, m, u = int(k), int(n), int(m), int(u)
        i = np.arange(max(k, n + m - u, 0), min(n, m) + 1, dtype=float)
        choose = lambda a, b: _lgamma(a + 1.0) - _lgamma(b + 1.0) - _lgamma(a - b + 1.0)
        if not len(i):
            out.append(0.0)
            continue
        log_p = choose(np.full_like(i, m), i) + choose(np.full_like(i, u - m), n - i) - choose(np.array([float(u)]), np.array([float(n)]))
        out.append(min(1.0, float(np.exp(log_p).sum())))
    return pd.Series(out, dtype="float64")


@lru_cache(512)
def _rank_counts(n: int) -> np.ndarray:
    """Number of sign patterns by signed-rank sum for n untied ranks."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[: len(counts) - r].copy()
    return counts


@F.pandas_udf(DoubleType())
def signed_rank_p(w_plus: pd.Series, n: pd.Series, tie_term: pd.Series, exact: pd.Series) -> pd.Series:
    """Two-sided signed-rank tail: the exact one where ``exact`` is true, else the tie-corrected normal one.

    ``tie_term`` is the sum of t^3 - t over tie groups.
    """
    out = []
    for w, k, tie, whole in zip(w_plus, n, tie_term, exact):
        if k is None or not k or math.isnan(k):
            out.append(None)
            continue
        k = int(k)
        top = k * (k + 1) / 2.0
        low = min(w, top - w)
        if bool(whole):
            out.append(min(1.0, 2.0 * float(_rank_counts(k)[: int(low) + 1].sum()) / 2.0**k))
            continue
        var = k * (k + 1) * (2 * k + 1) / 24.0 - tie / 48.0
        out.append(math.erfc(abs(w - top / 2.0) / math.sqrt(var) / math.sqrt(2.0)) if var > 0 else 1.0)
    return pd.Series(out, dtype="float64")
