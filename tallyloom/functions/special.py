"""Tail probabilities that Spark has no function for, in numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        front = np.where(x <= 0, 0.0, front)
        c = np.ones_like(x)
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = d * c
                h = h * step
            if np.nanmax(np.abs(step - 1), initial=0) < 1e-14:
                break
    value = front * h
    return np.where(swap, 1 - value, value)


def t_two_sided(t, dof) -> np.ndarray:
    """P(|T| > |t|)."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    return betainc(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * lead
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * lead


def chi2_upper(x: float, dof: float) -> float:
    return gammainc_upper(dof / 2, x / 2)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided; null for a null statistic and for one degree of freedom or less."""
    use = (t.notna() & dof.notna() & (dof > 1)).to_numpy(bool)
    out = np.full(len(t), np.nan)
    out[use] = t_two_sided(t.to_numpy(float)[use], dof.to_numpy(float)[use])
    return pd.Series(out).where(use, None)
