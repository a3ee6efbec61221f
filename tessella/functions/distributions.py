"""Distribution tails. Discrete tails are sums of log-factorials kept in Spark expressions; the
normal and Student tails have no Spark built-in and use Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series shifted to x >= 10; relative error below 1e-14 for x >= 1."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    inv = 1.0 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def hypergeom_upper(q, m, n, k, inclusive: bool = False) -> np.ndarray:
    """P(X > q) (or P(X >= q)) for k draws from m marked and n unmarked items.

    All records advance together through the terms of their tails; sums are kept as logarithms.
    """
    q, m, n, k = (np.asarray(v, dtype=float) for v in (q, m, n, k))
    x = np.maximum.reduce([q + (0 if inclusive else 1), np.zeros_like(q), k - n])
    stop = np.minimum(m, k)
    live = x <= stop

    def choose(a, b):
        return _log_gamma(a + 1) - _log_gamma(b + 1) - _log_gamma(a - b + 1)

    x0 = np.where(live, x, np.minimum(stop, np.maximum(0, k - n)))
    term = np.where(live, choose(m, x0) + choose(n, k - x0) - choose(m + n, k), -np.inf)
    total = term.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        while True:
            # a tail is done at its end or once its falling terms no longer count
            live = live & (x < stop) & ~((term < total - 45) & (x > k * m / (m + n)))
            if not live.any():
                break
            ratio = (m - x) * (k - x) / ((x + 1) * (n - k + x + 1))
            term = np.where(live, term + np.log(ratio), term)
            total = np.where(live, np.logaddexp(total, term), total)
            x = np.where(live, x + 1, x)
    return np.exp(total)


@F.pandas_udf(T.DoubleType())
def hypergeom_tail(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_upper(q, m, n, k))


@F.pandas_udf(T.DoubleType())
def hypergeom_tail_inclusive(q: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(hypergeom_upper(q, m, n, k, inclusive=True))


def norm_cdf_values(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2.0)) if v == v else math.nan for v in np.asarray(z, dtype=float)])


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_cdf_values(z.to_numpy(dtype=float)))


def normal_quantile(p: float) -> float:
    """Inverse normal CDF by bisection on erfc."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz continued fraction for the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def student_upper(t: float, df: float) -> float:
    """P(T > t)."""
    if t != t or df != df or df <= 0:
        return math.nan
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1.0 - half


@F.pandas_udf(T.DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_upper(a, b) for a, b in zip(t.astype(float), df.astype(float))])


def poisson_upper(count: Column, mean: float) -> Column:
    """P(X > count) for a Poisson mean; counts are cluster memberships, so the table is short."""
    return F.lit(1.0) - poisson_lower(count, mean)


def poisson_lower(count: Column, mean: float) -> Column:
    """P(X <= count)."""
    log_mean = math.log(mean)
    terms = F.transform(
        F.sequence(F.lit(0), F.greatest(count.cast("int"), F.lit(0))),
        lambda i: F.exp(i * F.lit(log_mean) - F.lit(mean) - F.log(F.greatest(F.factorial(F.least(i, F.lit(20))), F.lit(1)).cast("double"))
                        - F.when(i > 20, F.aggregate(F.sequence(F.lit(21), F.greatest(i, F.lit(21))), F.lit(0.0), lambda a, v: a + F.log(v.cast("double")))).otherwise(F.lit(0.0))),
    )
    return F.least(F.lit(1.0), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v))
