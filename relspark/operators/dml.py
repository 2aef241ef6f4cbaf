"""INSERT, UPDATE, DELETE and TRUNCATE as transformations: from the rows before to the rows after."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Predicate, as_column


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table and the rows, by column name, with the table's types."""
    return table.unionAll(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]))


def update(table: DataFrame, values: dict[str, Any], where: Predicate | Column | None = None) -> DataFrame:
    """``values`` (constants or columns over the old row) in the rows where the predicate is true; a null predicate changes nothing."""
    if unknown := set(values) - set(table.columns):
        raise ValueError(f"no such column: {sorted(unknown)}")
    hit = as_column(where)
    kinds = {f.name: f.dataType for f in table.schema}

    def of(c: str) -> Column:
        if c not in values:
            return F.col(c)
        new = values[c] if isinstance(values[c], Column) else F.lit(values[c])
        new = new.cast(kinds[c])
        return (new if hit is None else F.when(hit, new).otherwise(F.col(c))).alias(c)

    return table.select(*[of(c) for c in table.columns])


def delete(table: DataFrame, where: Predicate | Column | None = None) -> DataFrame:
    """Without the rows where the predicate is true; a null predicate keeps its row."""
    hit = as_column(where)
    return truncate(table) if hit is None else table.filter(~F.coalesce(hit, F.lit(False)))


def truncate(table: DataFrame) -> DataFrame:
    return table.filter(F.lit(False))
