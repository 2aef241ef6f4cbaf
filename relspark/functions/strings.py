"""String functions with standard semantics; positions count from 1, and a null argument gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming removes. Spelled out because Spark's SQL literals have no escapes for some of them.
BLANKS = " \t\n\r\x0b\x0c"


def concat(*columns: Column) -> Column:
    return F.concat(*columns)


def ascii_(c: Column) -> Column:
    """The first character's code point; 0 for an empty string."""
    return F.ascii(c)


def char(n: Column) -> Column:
    return F.char(n)


def charindex(needle: str | Column, c: Column, start: int = 1) -> Column:
    """The first place of needle from start on; 0 if there is none."""
    needle = needle if isinstance(needle, Column) else F.lit(needle)
    return F.call_function("locate", needle, c, F.lit(start))


def datalength(c: Column) -> Column:
    """Bytes in UTF-8."""
    return F.octet_length(c)


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def length(c: Column) -> Column:
    return F.length(c)


def length_trimmed(c: Column) -> Column:
    return F.length(trim(c))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def replace(c: Column, old: str, new: str) -> Column:
    """Every occurrence, in one pass."""
    return F.replace(c, F.lit(old), F.lit(new))


def substring(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n)
