"""Inner joins on equalities and other comparisons; Catalyst picks the strategy, adaptive execution splits skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import COMPARE


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str, str]], how: str = "inner", suffix: str = "_right") -> DataFrame:
    """Rows where every (left column, op, right column) holds: left columns, then right ones.

    A right column whose name the left side has gets ``suffix``, more than once if need be. Semi and anti joins give left columns only.
    """
    if not on:
        raise ValueError("a join needs a condition")
    taken, names = set(left.columns), []
    for c in right.columns:
        new = c
        while new in taken:
            new += suffix
        taken.add(new)
        names.append(new)
    renamed = right.toDF(*names)
    name = dict(zip(right.columns, names, strict=True))
    a, b = left.alias("_l"), renamed.alias("_r")
    condition = None
    for x, op, y in on:
        part = COMPARE[op](F.col(f"_l.`{x}`"), F.col(f"_r.`{name[y]}`"))
        condition = part if condition is None else condition & part
    return a.join(b, condition, how)
