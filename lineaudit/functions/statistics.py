"""Closed-form test statistics as column expressions over small count columns.

Tails are computed as logarithms, so that a p-value below the smallest double still has its order of magnitude; every p-value
has a ``log10`` form next to it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _log_erfc(x: float) -> float:
    """Natural logarithm of erfc(x), x >= 0."""
    if x < 20.0:
        return math.log(math.erfc(x))
    u = 1 / (2 * x * x)
    return -x * x - math.log(x * math.sqrt(math.pi)) + math.log1p(-u * (1 - 3 * u * (1 - 5 * u * (1 - 7 * u))))


@F.pandas_udf(DoubleType())
def log_erfc(x: pd.Series) -> pd.Series:
    """Logarithm of the complementary error function; applied to one-row results only."""
    return x.map(lambda v: _log_erfc(v) if v is not None and v == v else None)


def two_sided_normal_log_p(z: Column) -> Column:
    return log_erfc(F.abs(z) / math.sqrt(2.0))


def _correction(n: float) -> float:
    """log n! minus its Stirling approximation."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m) / m) / m) / n


def _log_half_mass(n: float, k: float) -> float:
    """log P(X = k) for X ~ Bin(n, 1/2), k <= n/2, without differences of large logarithms."""
    if k == 0:
        return -n * math.log(2)
    d = (n - 2 * k) / n
    apart = n / 2 * ((1 - d) * math.log1p(-d) + (1 + d) * math.log1p(d))
    return (_correction(n) - _correction(k) - _correction(n - k) - apart
            + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(k) - math.log(n - k)))


def _log_half_tail(n: float, k: float, last: float) -> float:
    """log of P(X < k) + last * P(X = k) for X ~ Bin(n, 1/2), k <= n/2: from the largest term down, in any size."""
    term, total, i = 1.0, last, k
    while i > 0:
        term *= i / (n - i + 1)
        total += term
        if term <= 1e-17 * total:
            break
        i -= 1
    return _log_half_mass(n, k) + math.log(total)


def binomial_half_log_p(b: Column, c: Column, mid_p: bool = False) -> Column:
    """Logarithm of the two-sided exact p of b against c discordant pairs; 0 when there are none. For one-row results only."""
    @F.pandas_udf(DoubleType())
    def tail(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_log_half_tail(x, y, 0.5 if mid_p else 1.0) if x == x and y == y and x > 0 else None
                          for x, y in zip(n, k)], dtype="float64")

    n, lo = (b + c).cast("double"), F.least(b, c).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), math.log(2) + tail(n, lo)))


def mcnemar_log_p(b: Column, c: Column) -> Column:
    """Exact below 25 discordant pairs, chi-square with continuity correction above (a named convention, both smooth in size)."""
    n = b + c
    chi2 = F.pow(F.abs(b - c) - 1, F.lit(2.0)) / F.nullif(n, F.lit(0))
    return F.when(n < 25, binomial_half_log_p(b, c)).otherwise(log_erfc(F.sqrt(chi2 / 2.0)))


def log10_of(log_p: Column) -> Column:
    return log_p / math.log(10)


def two_sided_normal_p(z: Column) -> Column:
    return F.exp(two_sided_normal_log_p(z))


def binomial_half_two_sided(b: Column, c: Column, mid_p: bool = False) -> Column:
    return F.exp(binomial_half_log_p(b, c, mid_p))


def mcnemar_p(b: Column, c: Column) -> Column:
    return F.exp(mcnemar_log_p(b, c))
