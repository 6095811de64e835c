"""Distribution tails Spark lacks, as Arrow-batched helpers for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_tail(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 / (1 - (p + q) * y / (p + 1))
        f = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)),
                        -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                f = f * d * c
        r = np.where(y <= 0, 0.0, front * f)
    return np.where(flip, 1 - r, r)


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    x = df / (df + t * t)
    ok = x.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = beta_tail(df[ok].to_numpy() / 2, 0.5, x[ok].to_numpy())
    return out


def _null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p value of Student's t."""
    return _null(_t_tail(t.cast("double"), df.cast("double")))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function: power series near zero, continued fraction in the tails."""
    z = z.cast("double")
    y = F.abs(z)
    density = F.exp(-y * y / 2) / math.sqrt(2 * math.pi)
    down = F.sequence(F.lit(80), F.lit(1))
    series = F.aggregate(down, F.lit(1.0), lambda acc, k: 1 + y * y / (2 * k + 1) * acc)
    fraction = F.aggregate(down, y, lambda acc, k: y + k / acc)
    upper = F.when(y <= 3, 0.5 - density * y * series).otherwise(density / fraction)
    return F.when(z <= 0, upper).otherwise(1 - upper)


def log_normal_cdf(z: Column) -> Column:
    """Logarithm of the normal distribution function, also where the function itself is 0 as a double."""
    y = -z.cast("double")
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), y, lambda acc, k: y + k / acc)
    tail = -y * y / 2 - F.log(fraction) - 0.5 * math.log(2 * math.pi)
    return F.when(y > 20, tail).otherwise(F.log(normal_cdf(z)))


def kolmogorov_sf(x: Column, terms: int = 100) -> Column:
    """Asymptotic tail of the Kolmogorov statistic."""
    k = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(k, F.lit(0.0), lambda acc, i: acc + F.when(i % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * i * i * x * x))
    return F.when(x < 0.05, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))
