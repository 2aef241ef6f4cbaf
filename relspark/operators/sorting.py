"""Sort keys with directions and explicit places of nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SortKey:
    of: str | Column
    descending: bool = False
    nulls_last: bool = False

    def column(self) -> Column:
        c = F.col(self.of) if isinstance(self.of, str) else self.of
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()


def asc(of: str | Column, **how) -> SortKey:
    return SortKey(of, False, **how)


def desc(of: str | Column, **how) -> SortKey:
    return SortKey(of, True, **how)


def sort_columns(keys) -> list[Column]:
    """Names and SortKeys as columns; a name sorts upwards."""
    return [k.column() if isinstance(k, SortKey) else asc(k).column() for k in keys]
