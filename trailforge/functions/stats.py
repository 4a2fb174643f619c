"""Small closed-form statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z95 = 1.959964


def chi2_sf(q: float, df: int) -> float:
    """P(X > q) of a chi-square variable with a whole number of degrees of freedom, by its finite sum."""
    if q <= 0:
        return 1.0
    h = q / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(1, df // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return min(1.0, total)


def chi2_sf_column(q: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def sf(q: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else chi2_sf(float(a), int(b)) for a, b in zip(q, df)], dtype="float64")

    return sf(q, df)


def mcnemar_p(b: int, c: int) -> float:
    """Exact two-sided p of b against c discordant pairs."""
    n = b + c
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)


def _stirling_rest(x: Column) -> Column:
    """log(x!) less Stirling's (x + 1/2) log(x) - x + log(2 pi) / 2, for whole x from 1 on."""
    small = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double")) - (x + 0.5) * F.log(x) + x - 0.5 * math.log(2 * math.pi)
    return F.when(x <= 20, small).otherwise(1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7))))


def mcnemar_column(b: Column, c: Column) -> Column:
    """The same in SQL functions: the tail's largest term, times the sum of all terms relative to it.

    Term j is at most exp(-2 j (j - 1) / n) of the largest one, so all terms beyond 20 sqrt(n) + 2 are 0 as doubles.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    off = (n - 2 * m) / n
    apart = F.when(off < 0.5, m * F.log1p(-off) + (n - m) * F.log1p(off)).otherwise(m * F.log(2 * m / n) + (n - m) * F.log(2 * (n - m) / n))
    largest = F.sqrt(n / (2 * math.pi * m * (n - m))) * F.exp(_stirling_rest(n) - _stirling_rest(m) - _stirling_rest(n - m) - apart)
    largest = F.when(m == 0, F.exp(-n * math.log(2))).otherwise(largest)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, j: F.struct((a["term"] * (m - j) / (n - m + j + 1)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    terms = F.sequence(F.lit(0).cast("long"), F.least(m, F.ceil(20 * F.sqrt(n)) + 2).cast("long"))
    total = F.aggregate(terms, start, step, lambda a: a["sum"])
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * largest * total))


def phi(n: Column, n11: Column, n1: Column, n2: Column) -> Column:
    """Correlation of two yes/no columns from counts; null where one is constant."""
    n, n11, n1, n2 = (x.cast("double") for x in (n, n11, n1, n2))
    return F.try_divide(n * n11 - n1 * n2, F.sqrt(n1 * (n - n1) * n2 * (n - n2)))
