"""Tail probabilities for the few rows of an aggregated result."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi_square_1df_tail(statistic: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom exceeds the statistic)."""
    return statistic.map(lambda s: math.erfc(math.sqrt(s / 2.0)), na_action="ignore").astype("float64")


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore").astype("float64")


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz iteration)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    fraction = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            fraction *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return math.exp(log_front) * fraction / a


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_tail(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student t probability."""
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b)) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper F probability."""
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) or pd.isna(c) else f_upper(float(a), float(b), float(c))
            for a, b, c in zip(f, df1, df2)
        ],
        dtype="float64",
    )
