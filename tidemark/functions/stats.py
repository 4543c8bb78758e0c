"""Distribution functions that the engine lacks, on small results only."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def _cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(-v / math.sqrt(2)))


def _inverse(p: pd.Series) -> pd.Series:
    return p.map(lambda v: None if v is None or not 0 < v < 1 else _NORMAL.inv_cdf(v))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d or 1e-300), 1 + top / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def _two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or v != v or n <= 0 else _beta(n / 2, 0.5, n / (n + v * v)) for v, n in zip(t, df)], dtype="float64")


def normal_cdf(x: Column) -> Column:
    return F.pandas_udf(_cdf, "double")(x)


def normal_inverse(p: Column) -> Column:
    return F.pandas_udf(_inverse, "double")(p)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) with df degrees of freedom."""
    return F.pandas_udf(_two_sided, "double")(t, df)
