"""Predicate trees: comparisons, null tests, and their combinations, by column name."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "=": operator.eq,
    "!=": operator.ne,
    "<>": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


class Predicate:
    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Cond(Predicate):
    """name op value; a null on either side is neither true nor false."""

    name: str
    op: str
    value: Any

    def column(self) -> Column:
        if self.op not in COMPARE:
            raise ValueError(f"unknown operator {self.op!r}; known: {' '.join(COMPARE)}")
        return COMPARE[self.op](F.col(self.name), self.value if isinstance(self.value, Column) else F.lit(self.value))


@dataclass(frozen=True)
class Between(Predicate):
    """low <= name <= high, as a seek in an index."""

    name: str
    low: Any
    high: Any

    def column(self) -> Column:
        return F.col(self.name).between(self.low, self.high)


@dataclass(frozen=True)
class IsNull(Predicate):
    name: str

    def column(self) -> Column:
        return F.col(self.name).isNull()


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def column(self) -> Column:
        return ~self.inner.column()


class And(Predicate):
    def __init__(self, *parts: Predicate):
        self.parts = parts

    def column(self) -> Column:
        out = F.lit(True)
        for i, p in enumerate(self.parts):
            out = p.column() if i == 0 else out & p.column()
        return out


class Or(Predicate):
    def __init__(self, *parts: Predicate):
        self.parts = parts

    def column(self) -> Column:
        out = F.lit(False)
        for i, p in enumerate(self.parts):
            out = p.column() if i == 0 else out | p.column()
        return out


def as_column(where: Predicate | Column | None) -> Column | None:
    return where.column() if isinstance(where, Predicate) else where
