"""Distribution functions that SQL lacks, on columns of aggregated rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float, stop: float = 1e-14) -> float:
    """The regularised incomplete beta function, by its continued fraction where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x, stop)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 10_000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d), 1 + up / c
            total *= c * d
        if abs(c * d - 1) < stop:
            break
    return front * total


@F.pandas_udf(DoubleType())
def _two_sided(t: pd.Series, freedom: pd.Series) -> pd.Series:
    out = [incomplete_beta(n / 2, 0.5, n / (n + x * x)) if np.isfinite(x) and n > 0 else None for x, n in zip(t, freedom)]
    return pd.Series(out, dtype="float64")


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t; null without degrees of freedom."""
    return _two_sided(t.cast("double"), freedom.cast("double"))
