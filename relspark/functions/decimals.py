"""Decimal functions; comparisons and sums follow Spark's DECIMAL(p, s)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column, precision: int = 38, scale: int = 18) -> Column:
    return text.cast(f"decimal({precision},{scale})")


def to_string(c: Column) -> Column:
    return c.cast("string")


def add(a: Column, b: Column) -> Column:
    return a + b


def is_positive(c: Column) -> Column:
    """Zero counts as positive."""
    return c >= 0


def scale_digits(text: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.when(F.contains(text, F.lit(".")), F.length(text) - F.locate(".", text)).otherwise(F.lit(0))
