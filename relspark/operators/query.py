"""One SELECT: filter, group, having, project, order, limit, as one lazily planned DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .aggregates import Agg
from .predicates import Predicate, as_column
from .sorting import SortKey, sort_columns


def select(
    df: DataFrame,
    columns: Sequence[str | Column] | None = None,
    where: Predicate | Column | None = None,
    group_by: Sequence[str] | None = None,
    aggs: Sequence[Agg] = (),
    having: Predicate | Column | None = None,
    order_by: Sequence[str | SortKey] = (),
    limit: int | None = None,
) -> DataFrame:
    """Columns come out in the order asked for; None gives all. An unknown name is an error.

    ``group_by`` without ``aggs`` gives the distinct keys (a null key is one of its own); ``aggs`` without ``group_by`` one row.
    ``limit`` with ``order_by`` keeps the first rows of that order without sorting the rest.
    """
    out = df if where is None else df.filter(as_column(where))
    if aggs:
        out = out.groupBy(*(group_by or ())).agg(*[a.column() for a in aggs])
    elif group_by is not None:
        out = out.select(*group_by).distinct()
    if having is not None:
        if not aggs and group_by is None:
            raise ValueError("having needs groups")
        out = out.filter(as_column(having))
    keys = sort_columns(order_by)
    # sorted before the projection, so that a key needn't be among the columns
    if keys:
        out = out.orderBy(*keys)
    if limit is not None:
        out = out.limit(limit)
    return out if columns is None else out.select(*columns)
