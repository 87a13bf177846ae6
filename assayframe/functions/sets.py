"""Sets as arrays and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_except(rows: DataFrame, taken: DataFrame, *keys: str) -> DataFrame:
    """The distinct ``keys`` of ``rows`` that ``taken`` (the same columns) lacks; nulls are equal to none."""
    return rows.select(*keys).join(taken.select(*keys), list(keys), "left_anti").distinct()


def overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def equal(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same items, repeats and order aside."""
    return subset(a, b) & subset(b, a)


def saturating_minus(a: Column, b: Column) -> Column:
    """The difference of whole numbers, not below zero."""
    return F.greatest(a - b, F.lit(0))


def div_ceil(a: Column, b: Column) -> Column:
    return F.ceil(a / b)
