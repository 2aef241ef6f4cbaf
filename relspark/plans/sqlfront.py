"""SQL text over named tables: queries over frames, and statements over a catalog's tables.

Spark's parser reads the text. Tables are views of a session of their own, which shares the caller's settings and functions, so no view of the
caller's is replaced and none is left behind.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Database

#: (kind, pattern), tried in this order; what none of them matches is unknown, one character at a time.
TOKENS = (
    ("identifier", re.compile(r"[A-Za-z][A-Za-z0-9_]*")),
    ("number", re.compile(r"[0-9]+")),
    ("operator", re.compile(r">=|<=|!=|[<>=!]")),
    ("separator", re.compile(r"[,;]")),
    ("wildcard", re.compile(r"\*")),
)
#: The words of the grammar.
KEYWORDS = {"SELECT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "ASC", "DESC", "INSERT", "UPDATE", "DELETE", "AND", "OR", "COUNT", "SUM", "AVG", "MIN", "MAX"}


def tokenize(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each token."""
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        for kind, pattern in TOKENS:
            if m := pattern.match(text, at):
                out.append(("keyword" if kind == "identifier" and m[0].upper() in KEYWORDS else kind, m[0]))
                at = m.end()
                break
        else:
            out.append(("unknown", text[at]))
            at += 1
    return out


def apart(spark: SparkSession) -> SparkSession:
    """A session with the settings, functions and views of this one, whose own views the other doesn't see."""
    return SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())


def trimmed(text: str) -> str:
    return text.strip().rstrip(";")


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None, **more: DataFrame) -> DataFrame:
    """The statement's result, with ``tables`` under their names."""
    own = apart(spark)
    for name, df in {**(tables or {}), **more}.items():
        _view(own, name, df)
    return own.sql(trimmed(text))


def _view(session: SparkSession, name: str, df: DataFrame) -> None:
    DataFrame(_of(session, df._jdf.logicalPlan()), session).createOrReplaceTempView(name)


def _of(session: SparkSession, plan):
    return session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)


def execute(database: Database, text: str) -> DataFrame:
    """One statement over the tables of a catalog's database. SELECT gives its rows; INSERT, UPDATE, DELETE and TRUNCATE change the table and give its rows afterwards.

    Constraints hold as for the table's own methods; a statement that breaks one changes nothing.
    """
    words = [t for kind, t in tokenize(text) if kind in ("keyword", "identifier")]
    if not words:
        raise ValueError("an empty statement")
    plan = database.spark._jsparkSession.sessionState().sqlParser().parsePlan(trimmed(text))
    kind = plan.nodeName()
    if words[0].upper() in ("INSERT", "UPDATE", "DELETE", "TRUNCATE"):
        change = {"InsertIntoStatement": _insert, "UpdateTable": _update, "DeleteFromTable": _delete, "TruncateTable": _truncate}.get(kind)
        if change is None:
            raise ValueError(f"not supported: {kind}")
        target = plan.child() if kind == "TruncateTable" else plan.table()
        while target.nodeName() == "SubqueryAlias":
            target = target.child()
        table = database.open_table(_names(target.multipartIdentifier())[-1])
        change(database, table, plan, text)
        return table.rows()
    return query(database.spark, text, _mentioned(database, text))


def _names(seq) -> list[str]:
    return [seq.apply(i) for i in range(seq.length())]


def _mentioned(database: Database, text: str) -> dict[str, DataFrame]:
    """The database's tables whose names are in the text; others aren't opened."""
    held = {t for kind, t in tokenize(text) if kind in ("identifier", "keyword")}
    return {name: database.open_table(name).rows() for name in database.tables() if any(name.lower() == h.lower() for h in held)}


def _insert(database: Database, table, plan, text: str) -> None:
    if plan.overwrite():
        raise ValueError("INSERT OVERWRITE isn't supported; delete and insert")
    given = _names(plan.userSpecifiedCols()) or [c.name for c in table.definition.columns]
    own = apart(database.spark)
    for name, df in _mentioned(database, text).items():
        _view(own, name, df)
    rows = DataFrame(_of(own, plan.query()), own)
    if len(rows.columns) != len(given):
        raise ValueError(f"{len(given)} values are needed, not {len(rows.columns)}")
    rows = rows.toDF(*[f"c{i}" for i in range(len(given))])
    at = {n.lower(): f"c{i}" for i, n in enumerate(given)}
    if unknown := set(at) - {c.name.lower() for c in table.definition.columns}:
        raise ValueError(f"no such column: {sorted(unknown)}")
    table.insert(rows.select(*[(F.col(at[c.name.lower()]) if c.name.lower() in at else F.lit(None)).alias(c.name) for c in table.definition.columns]))


def _condition(option) -> Column | None:
    return F.expr(option.sql()) if option is not None else None


def _update(database: Database, table, plan, text: str) -> None:
    columns = {c.name.lower(): c.name for c in table.definition.columns}
    values = {}
    for a in _names(plan.assignments()):
        name = _names(a.key().nameParts())[-1]
        values[columns.get(name.lower(), name)] = F.expr(a.value().sql())
    table.update(values, _condition(plan.condition().get() if plan.condition().isDefined() else None))


def _delete(database: Database, table, plan, text: str) -> None:
    always = plan.condition().nodeName() == "Literal" and plan.condition().sql().lower() == "true"
    table.delete(None if always else _condition(plan.condition()))


def _truncate(database: Database, table, plan, text: str) -> None:
    table.truncate()
