"""Opt-in variants with the older engine's conventions: places from 0, inclusive ends, whole strings for odd arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import strings
from ..operators.sorting import SortKey


def all_blank(c: Column) -> Column:
    return (F.length(c) > 0) & (F.length(strings.trim(c)) == 0)


def charindex(needle: str | Column, c: Column, start: int = 0) -> Column:
    """From 0; -1 if absent; 0 where either string is empty, start is beyond the string, or needle is the longer one."""
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    odd = (F.length(needle) == 0) | (F.length(c) == 0) | F.lit(start < 0) | (F.length(c) <= start) | (F.length(needle) > F.length(c))
    return F.when(odd, 0).otherwise(F.call_function("locate", needle, c, F.lit(start + 1)) - 1)


def left(c: Column, n: int = 0) -> Column:
    return c if n <= 0 else strings.left(c, n)


def right(c: Column, n: int = 0) -> Column:
    return c if n <= 0 else strings.right(c, n)


def length(c: Column) -> Column:
    """Of the string trimmed on both sides; one that is all blanks counts whole."""
    return F.when(all_blank(c), F.length(c)).otherwise(strings.length_trimmed(c))


def trim(c: Column) -> Column:
    return F.when(all_blank(c), c).otherwise(strings.trim(c))


def ltrim(c: Column) -> Column:
    return F.when(all_blank(c), c).otherwise(strings.ltrim(c))


def substring(c: Column, start: int = 0, end: int = 0) -> Column:
    """From start to end, both from 0 and inclusive; the whole string where they lie outside it."""
    odd = F.lit(start < 0 or end < start) | (F.length(c) <= end)
    return F.when(odd, c).otherwise(F.substring(c, start + 1, max(0, end - start + 1)))


def string_order(name: str) -> list[SortKey]:
    """Shorter strings first, and falling byte order among equally long ones."""
    return [SortKey(F.octet_length(name)), SortKey(name, descending=True)]
