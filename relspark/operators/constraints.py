"""Checks before rows are written: NOT NULL, unique keys, and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ConstraintError(ValueError):
    pass


def nulls_in(df: DataFrame, not_null: Sequence[str]) -> dict[str, int]:
    """How many nulls each of the columns has, if any; one pass over the rows."""
    if not not_null:
        return {}
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in not_null]).first()
    return {c: row[c] for c in not_null if row[c]}


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Values of ``key`` that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def within(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Rows of ``old`` whose value lies between the least and the greatest that ``new`` has, so that a scan of sorted files skips most row groups."""
    c = F.col(column)
    span = new.agg(F.min(c).alias("least"), F.max(c).alias("most"), F.count(F.when(c.isNull(), 1)).alias("nulls")).first()
    near = c.between(F.lit(span["least"]), F.lit(span["most"])) if span["least"] is not None else F.lit(False)
    return old.where(near | c.isNull() if span["nulls"] else near)


def check_rows(new: DataFrame, old: DataFrame | None, not_null: Sequence[str], keys: Sequence[Sequence[str]]) -> None:
    """Raises ConstraintError if the rows ``new`` may not join the rows ``old``. The new keys are the side that Spark broadcasts where they are small."""
    if found := nulls_in(new, not_null):
        raise ConstraintError(f"NULL in NOT NULL columns: {found}")
    for key in keys:
        some = duplicate_keys(new, key).take(1)
        if not some and old is not None:
            same = [F.col(f"n.`{c}`").eqNullSafe(F.col(f"o.`{c}`")) for c in key]
            some = within(old.select(*key), new, key[0]).alias("o").join(new.select(*key).alias("n"), same, "left_semi").take(1)
        if some:
            raise ConstraintError(f"duplicate key {key}: {some[0].asDict()}")
