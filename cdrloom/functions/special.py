"""Tail probabilities for summary rows (small tables only)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return math.exp(log_front) * value / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(x, k) for x, k in zip(t, df)])


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic; null in, null out."""
    p = _t_two_sided(t.cast("double"), df.cast("double"))
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(p), p)


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation coefficient of n pairs."""
    df = (n - 2).cast("double")
    t = r * F.sqrt(F.try_divide(df, 1 - r * r))
    # a perfect correlation divides by zero: its p is 0
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p_value(t, df))
