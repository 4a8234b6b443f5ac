"""Tail probabilities of correlations, for tables of a few results: plain Python behind Arrow functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d), 1 + term / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a Pearson or Spearman correlation by Student's t with n - 2 degrees of freedom; NaN below 3 points."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return beta_share(df / (df + r * r * df / (1 - r * r)), df / 2, 0.5)


def kendall_p(tau: float, n: int) -> float:
    """Two-sided p of Kendall's tau without ties: exact up to 33 points, normal beyond."""
    if n < 2 or tau is None or math.isnan(tau):
        return math.nan
    pairs = n * (n - 1) // 2
    if n > 33:
        z = abs(tau) * pairs / math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
        return math.erfc(z / math.sqrt(2))
    apart = round((1 - tau) * pairs / 2)  # discordant pairs
    low = min(apart, pairs - apart)
    ways = [1]
    for k in range(2, n + 1):  # permutations of k by inversions
        total = [sum(ways[max(0, i - k + 1) : i + 1]) for i in range(len(ways) + k - 1)]
        ways = total
    return min(1.0, 2 * sum(ways[: low + 1]) / math.factorial(n))


def _tail(of, value, n) -> Column:
    def run(values: pd.Series, numbers: pd.Series) -> pd.Series:
        found = pd.Series([of(float(a), int(b)) if a is not None else math.nan for a, b in zip(values, numbers, strict=True)], dtype="float64")
        return found.astype(object).where(found.notna(), None)

    return F.pandas_udf(run, T.DoubleType())(value, n)


def correlation_tail(r, n) -> Column:
    return _tail(correlation_p, r, n)


def kendall_tail(tau, n) -> Column:
    return _tail(kendall_p, tau, n)
