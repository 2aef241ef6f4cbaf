"""The nine column types, by their literals, as Spark types; and text to typed values with range checks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The type literals.
TYPES: dict[str, T.DataType] = {
    "TinyInt": T.ByteType(),
    "SmallInt": T.ShortType(),
    "Int": T.IntegerType(),
    "BigInt": T.LongType(),
    "Decimal": T.DecimalType(38, 18),
    "String": T.StringType(),
    "UnicodeString": T.StringType(),
    "Bool": T.BooleanType(),
    "DateTime": T.TimestampNTZType(),
}
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def spark_type(literal: str) -> T.DataType:
    """Of a literal, ``Decimal(p,s)`` included. An unknown one is an error."""
    if m := re.fullmatch(r"Decimal\((\d+),\s*(\d+)\)", literal):
        return T.DecimalType(int(m[1]), int(m[2]))
    if literal not in TYPES:
        raise ValueError(f"unknown column type {literal!r}; known: {', '.join(TYPES)}")
    return TYPES[literal]


def coerced(column: Column, literal: str) -> Column:
    """Text as a value of the type. Out of range, trailing junk, and Bool other than 0 or 1 are errors when evaluated; null stays null."""
    kind = spark_type(literal)
    if literal == "Bool":
        wrong = F.raise_error(F.concat(F.lit("Bool takes 0 or 1, not "), column))
        return F.when(column.isNull(), None).when(column == "1", True).when(column == "0", False).otherwise(wrong.cast("boolean"))
    if literal == "DateTime":
        return F.to_timestamp_ntz(column, F.lit(DATETIME_FORMAT))
    if isinstance(kind, T.StringType):
        return column.cast("string")
    return F.trim(column).cast(kind)


def try_coerced(column: Column, literal: str) -> Column:
    """As coerced, with null where the text isn't such a value."""
    kind = spark_type(literal)
    if literal == "Bool":
        return F.when(column == "1", True).when(column == "0", False)
    if literal == "DateTime":
        return F.try_to_timestamp(column, F.lit(DATETIME_FORMAT)).cast("timestamp_ntz")
    return column.try_cast(kind)
