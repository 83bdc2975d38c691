"""Tail probabilities.  Spark has no ``erf``, so these are Arrow-batched UDFs.

They run on tables of test statistics (one row per feature or model).  A gate
``p < level`` stays JVM-side: compare |z| with :func:`critical_z`.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(DoubleType())
def chi_square_1(statistic: pd.Series) -> pd.Series:
    return statistic.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2.0)), na_action="ignore")


def critical_z(level: float) -> float:
    """|z| above this value is the same as a two-sided p below ``level``."""
    return NormalDist().inv_cdf(1.0 - level / 2.0)
