"""Rounding of result columns, the same on both sides of a check.

Sums run in different orders in two engines; results are reported to a fixed number of digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; negative zero becomes zero."""
    return df.select(*[
        (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rd(columns: str, digits: int = 6) -> str:
    """The same columns in SQL: ``round(a, 6) AS a, ...``."""
    return ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in columns.split())
