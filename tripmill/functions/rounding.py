"""Rounding of doubles: what ``F.round`` and ``F.bround`` return, at a fraction of their time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quick(x: Column, digits: int, exact: Callable) -> Column:
    """Spark rounds doubles through decimals. Away from ties, and where multiples of the last digit are exact, the nearest multiple is the same double:
    both are the quotient nearest to a whole number over a power of ten. All else, null and values that are not finite included, is left to ``exact``."""
    y = x * 10.0**digits
    return F.when((F.abs(y) < 1e12) & (F.abs(y - F.rint(y)) < 0.499), F.rint(y) / 10.0**digits).otherwise(exact(x, digits)) + F.lit(0.0)


def with_rounded(df: DataFrame, values: dict[str, Column], digits: int, even: bool = False) -> DataFrame:
    """``withColumns`` of doubles rounded half up or half to even, without negative zeros. They go through one array and one lambda: as many separate
    expressions make the code of a row longer than the 8000 bytes that the JVM compiles, and a long chain of columns then runs interpreted."""
    if not values:
        return df
    each = F.transform(F.array(*values.values()), lambda x: _quick(x, digits, F.bround if even else F.round))
    return df.withColumn("_rounded", each).withColumns({c: F.col("_rounded")[i] for i, c in enumerate(values)}).drop("_rounded")
