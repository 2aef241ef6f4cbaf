"""COUNT, SUM, AVG, MIN and MAX over a column or a constant. Nulls are skipped; without rows all but COUNT are null."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Agg:
    """``kind`` over ``of``: a column's name, a Column, or None for all rows (COUNT only). ``cast`` types the result."""

    kind: str
    of: str | Column | None
    name: str
    cast: str | None = None

    def column(self) -> Column:
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate {self.kind!r}; known: {', '.join(KINDS)}")
        if self.of is None and self.kind != "count":
            raise ValueError(f"{self.kind} needs a column")
        of = F.lit(1) if self.of is None else F.col(self.of) if isinstance(self.of, str) else self.of
        out = KINDS[self.kind](of)
        return (out.cast(self.cast) if self.cast else out).alias(self.name)


def constant(kind: str, value: Any, name: str) -> Agg:
    """An aggregate of a constant: COUNT counts all rows, SUM adds it once a row."""
    return Agg(kind, F.lit(value), name)
