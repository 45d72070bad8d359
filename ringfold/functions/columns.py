"""Small Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def tidy(col: Column | str, digits: int = 6) -> Column:
    """Round and drop the sign of zero, so equal results print equally."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, digits) + F.lit(0.0)


def total(cols: list[Column]) -> Column:
    return reduce(add, cols, F.lit(0.0)) if cols else F.lit(0.0)


def finite(col: Column) -> Column:
    """NaN becomes 0 and infinities the largest finite double; null stays null."""
    big = F.lit(1.7976931348623157e308)
    return (
        F.when(F.isnan(col), F.lit(0.0))
        .when(col == F.lit(float("inf")), big)
        .when(col == F.lit(float("-inf")), -big)
        .otherwise(col)
    )


def as_doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
