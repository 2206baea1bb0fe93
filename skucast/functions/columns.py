"""Small Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skucast.schema import EPS


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den, null where den is 0 or null (ANSI-safe; pandas would give inf/NaN)."""
    return F.try_divide(col_(num), col_(den))


def cv(std, mean) -> Column:
    """Coefficient of variation std / (mean + 1e-8)."""
    return col_(std) / (col_(mean) + F.lit(EPS))
