"""Datetime functions over TIMESTAMP without zone; epochs are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import DATETIME_FORMAT


def now() -> Column:
    return F.localtimestamp()


def make(year, month, day, hour=0, minute=0, second=0) -> Column:
    """From its parts, each a number or a column; parts out of range are errors."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in (year, month, day, hour, minute, second)]
    return F.make_timestamp_ntz(*parts)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def year(c: Column) -> Column:
    return F.year(c)


def month(c: Column) -> Column:
    return F.month(c)


def day(c: Column) -> Column:
    return F.dayofmonth(c)


def hour(c: Column) -> Column:
    return F.hour(c)


def minute(c: Column) -> Column:
    return F.minute(c)


def second(c: Column) -> Column:
    return F.second(c)


def add_days(c: Column, n: int) -> Column:
    return F.timestamp_add("DAY", F.lit(n), c)


def add_seconds(c: Column, n: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(n), c)


def parse(text: Column, fmt: str = DATETIME_FORMAT) -> Column:
    return F.to_timestamp_ntz(text, F.lit(fmt))


def epoch(c: Column) -> Column:
    """Seconds since 1970, UTC, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def epoch_of_text(text: Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Of a datetime written in ``fmt``."""
    return epoch(parse(text, fmt))


def epoch_of_parts(year, month, day, hour=0, minute=0, second=0) -> Column:
    return epoch(make(year, month, day, hour, minute, second))


def format_(c: Column, fmt: str = DATETIME_FORMAT) -> Column:
    return F.date_format(c, fmt)


def is_valid(year: Column, month: Column, day: Column) -> Column:
    """Whether the parts are a date of 1970 or later."""
    return F.coalesce(F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)).isNotNull() & (year >= 1970), F.lit(False))
