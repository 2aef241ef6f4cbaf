"""The query catalogue: every relational operator as a plan over the tables of a folder.

Each query is a function of (spark, sf_dir); ``oracle`` has the SQL that gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, datetimes, decimals, strings
from ..operators import dml
from ..operators.aggregates import Agg
from ..operators.constraints import duplicate_keys
from ..operators.joins import join
from ..operators.predicates import And, Between, Cond, IsNull, Not, Or, Predicate
from ..operators.query import select
from ..operators.sorting import asc, desc
from ..session import shared_folder
from ..sources import files
from ..sources.catalog import Column as CatalogColumn
from ..sources.catalog import Database
from . import sqlfront
from .oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
__all__ = ["ORACLE_SQL", "QUERIES"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return files.read(spark, f"{sf_dir}/{table}.parquet")


def over(name: str, *tables: str):
    """Registers a plan over tables under a name."""

    def registered(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(*[load(spark, sf_dir, t) for t in tables])
        return plan

    return registered


def selected(name: str, table: str, **clauses) -> None:
    over(name, table)(lambda df: select(df, **clauses))


def mapped(name: str, table: str, key: str, **values: Callable[[], F.Column]) -> None:
    """A key and functions of a row; built when the query is, as columns need a session."""
    over(name, table)(lambda df: df.select(key, *[make().alias(n) for n, make in values.items()]))


def sql(name: str, text: str, *tables: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: sqlfront.query(spark, text, **{t: load(spark, sf_dir, t) for t in tables})


# scans, projection, predicates, limits

selected("scan_full", "nation")
selected("project_columns", "orders", columns=["o_totalprice", "o_orderkey"])
selected("filter_eq", "lineitem", columns=["l_orderkey", "l_quantity"], where=Cond("l_returnflag", "=", "R"))
selected("filter_ne", "customer", columns=["c_custkey", "c_mktsegment"], where=Cond("c_mktsegment", "!=", "BUILDING"))
selected("filter_gt", "orders", columns=["o_orderkey"], where=Cond("o_totalprice", ">", 100000))
selected("filter_lt", "orders", columns=["o_orderkey"], where=Cond("o_totalprice", "<", 50000))
selected("filter_ge", "lineitem", columns=["l_orderkey", "l_linenumber"], where=Cond("l_quantity", ">=", 45))
selected("filter_le", "part", columns=["p_partkey"], where=Cond("p_size", "<=", 10))
selected("filter_and", "lineitem", columns=["l_orderkey"], where=And(Cond("l_returnflag", "=", "A"), Cond("l_linestatus", "=", "F"), Cond("l_quantity", "=", 10)))
selected("filter_or", "orders", columns=["o_orderkey"], where=Or(Cond("o_orderstatus", "=", "P"), Cond("o_orderpriority", "=", "1-URGENT")))
NESTED: Predicate = Or(
    And(Cond("o_orderstatus", "=", "F"), Cond("o_totalprice", ">", 90000)), And(Cond("o_orderstatus", "=", "O"), Not(Cond("o_totalprice", ">=", 30000)))
)
selected("filter_nested_bool", "orders", columns=["o_orderkey"], where=NESTED)
selected("seek_point", "orders", where=Cond("o_orderkey", "=", 25))
selected("seek_range", "orders", columns=["o_orderkey", "o_custkey"], where=Between("o_orderkey", 9000, 9500))
selected("index_scan_nonleading", "lineitem", columns=["l_orderkey", "l_linenumber", "l_suppkey"], where=Cond("l_linenumber", "=", 3))
selected("secondary_range", "orders", columns=["o_orderkey", "o_custkey"], where=Between("o_custkey", 900, 950))
selected("limit_topk", "orders", columns=["o_orderkey", "o_totalprice"], order_by=[desc("o_totalprice"), asc("o_orderkey")], limit=20)


@over("filter_is_null", "customer")
def filter_is_null(customer: DataFrame) -> DataFrame:
    return select(customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s")), ["c_custkey"], IsNull("s"))


@over("filter_datetime", "lineitem")
def filter_datetime(lineitem: DataFrame) -> DataFrame:
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1998-01-01 00:00:00", "1998-02-01 00:00:00"))
    return select(lineitem, ["l_orderkey", "l_shipdate"], Cond("l_shipdate", ">=", start) & Cond("l_shipdate", "<", end))


@over("large_text", "documents")
def large_text(documents: DataFrame) -> DataFrame:
    n = strings.length(F.col("text"))
    return select(documents, ["doc_id", n.alias("n")], n >= 1024)


@over("cast_types", "orders")
def cast_types(orders: DataFrame) -> DataFrame:
    small = (F.col("o_orderkey") % 100).cast("string").cast("tinyint")
    when = datetimes.parse(F.lit("2024-04-12 12:12:12"))
    return orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("b"), small.alias("t"), when.alias("d"))


# order

selected("order_asc", "customer", columns=["c_custkey", "c_name"], order_by=[asc("c_name")])
selected("order_desc", "orders", columns=["o_orderkey", "o_orderdate"], order_by=[desc("o_orderkey")])
selected(
    "order_multi_key", "orders", columns=["o_orderstatus", "o_totalprice", "o_orderkey"], order_by=[asc("o_orderstatus"), desc("o_totalprice"), asc("o_orderkey")]
)


@over("compat_string_order", "nation")
def compat_string_order(nation: DataFrame) -> DataFrame:
    return select(nation, ["n_name"], order_by=compat.string_order("n_name"))


# joins


@over("join_inner_equi", "orders", "customer")
def join_inner_equi(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return join(orders, customer, [("o_custkey", "=", "c_custkey")]).select("o_orderkey", "c_name")


@over("join_multi_key", "lineitem", "lineitem")
def join_multi_key(a: DataFrame, b: DataFrame) -> DataFrame:
    on = [("l_orderkey", "=", "l_orderkey"), ("l_linenumber", "=", "l_linenumber"), ("l_quantity", "<", "l_quantity")]
    both = join(a.select("l_orderkey", "l_linenumber", "l_quantity"), b.select("l_orderkey", "l_linenumber", "l_quantity"), on)
    return both.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q1"), F.col("l_quantity_right").alias("q2"))


@over("join_intermediate", "orders", "customer", "nation", "region")
def join_intermediate(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    rich = select(orders, where=Cond("o_totalprice", ">", 100000))
    rows = join(rich, customer, [("o_custkey", "=", "c_custkey")]).select("o_orderkey", "c_name", "c_nationkey")
    rows = join(join(rows, nation, [("c_nationkey", "=", "n_nationkey")]), region, [("n_regionkey", "=", "r_regionkey")])
    return rows.select("o_orderkey", "c_name", "n_name", "r_name")


@over("join_theta", "nation", "nation")
def join_theta(a: DataFrame, b: DataFrame) -> DataFrame:
    both = join(a.select(F.col("n_nationkey").alias("k1")), b.select(F.col("n_nationkey").alias("k2")), [("k1", "<", "k2")])
    return both.select("k1", "k2")


sql("sql_join", "SELECT r_name, COUNT(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "nation", "region")

# groups and aggregates

COUNT = Agg("count", None, "n")
selected("group_single_key", "lineitem", group_by=["l_returnflag"], aggs=[COUNT])
selected("group_multi_key", "lineitem", group_by=["l_returnflag", "l_linestatus"], aggs=[COUNT])
selected("group_keys_only", "orders", group_by=["o_orderstatus"])
selected("agg_count_star", "lineitem", aggs=[COUNT])
selected("agg_max", "lineitem", group_by=["l_linestatus"], aggs=[Agg("max", "l_quantity", "m"), Agg("max", "l_shipdate", "d"), Agg("max", "l_returnflag", "s")])
selected("agg_min", "lineitem", group_by=["l_linestatus"], aggs=[Agg("min", "l_quantity", "m"), Agg("min", "l_shipdate", "d"), Agg("min", "l_returnflag", "s")])
selected("agg_global", "orders", aggs=[COUNT, Agg("min", "o_totalprice", "lo"), Agg("max", "o_totalprice", "hi")])
selected(
    "agg_all_five",
    "customer",
    group_by=["c_mktsegment"],
    aggs=[COUNT, Agg("sum", "c_nationkey", "s", "bigint"), Agg("avg", "c_nationkey", "a"), Agg("min", "c_acctbal", "lo"), Agg("max", "c_acctbal", "hi")],
)
selected("having_filter", "orders", group_by=["o_custkey"], aggs=[COUNT], having=Cond("n", ">", 12))


@over("agg_count_col", "orders")
def agg_count_col(orders: DataFrame) -> DataFrame:
    return select(orders, group_by=["o_orderstatus"], aggs=[Agg("count", F.nullif("o_orderpriority", F.lit("5-LOW")), "n")])


@over("agg_sum", "orders")
def agg_sum(orders: DataFrame) -> DataFrame:
    money = F.col("o_totalprice").cast("decimal(18,2)")
    return select(orders, group_by=["o_orderstatus"], aggs=[Agg("sum", money, "s", "decimal(28,2)"), Agg("sum", "o_custkey", "k", "bigint")])


@over("agg_avg", "lineitem")
def agg_avg(lineitem: DataFrame) -> DataFrame:
    return select(lineitem, group_by=["l_returnflag"], aggs=[Agg("avg", F.col("l_quantity").cast("bigint"), "a")])


@over("flagship", "lineitem")
def flagship(lineitem: DataFrame) -> DataFrame:
    """Filter, group, five aggregates, having, order."""
    aggs = [
        COUNT,
        Agg("sum", F.col("l_quantity").cast("decimal(18,2)"), "sum_qty", "decimal(28,2)"),
        Agg("avg", F.col("l_quantity").cast("bigint"), "avg_qty"),
        Agg("min", "l_extendedprice", "min_price"),
        Agg("max", "l_extendedprice", "max_price"),
    ]
    return select(
        lineitem, where=Cond("l_quantity", ">", 10), group_by=["l_returnflag", "l_linestatus"], aggs=aggs, having=Cond("n", ">", 0), order_by=[desc("l_returnflag"), asc("l_linestatus")]
    )


# changes, as the relation after the statement


@over("dml_insert", "nation")
def dml_insert(nation: DataFrame) -> DataFrame:
    return dml.insert(nation, nation.sparkSession.createDataFrame([(25, "NATION_25", 0)], ["n_nationkey", "n_name", "n_regionkey"]))


@over("dml_unique_check", "orders")
def dml_unique_check(orders: DataFrame) -> DataFrame:
    return duplicate_keys(orders, ["o_custkey"])


over("dml_update", "nation")(lambda nation: dml.update(nation, {"n_name": "UPDATED"}, Cond("n_regionkey", "=", 1)))
over("dml_delete", "customer")(lambda customer: dml.delete(customer, Cond("c_mktsegment", "=", "BUILDING")))
over("dml_truncate", "nation")(dml.truncate)

# SQL text

sql("sql_where", "SELECT * FROM orders WHERE o_orderkey = 25", "orders")
sql("sql_subquery_from", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') s WHERE o_totalprice > 100000;", "orders")
sql("sql_group_having", "SELECT o_orderpriority, COUNT(*) n FROM orders GROUP BY o_orderpriority HAVING COUNT(*) > 10", "orders")
sql("sql_order_by", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC", "orders")



def stored(name: str, *statements: str) -> None:
    """Registers a table of nation in a catalog, after statements; the last one's rows are the result."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database.create(spark, shared_folder(spark), f"d{uuid.uuid4().hex}")
        db.files.fs.deleteOnExit(db.files.path(db.folder))
        nation = load(spark, sf_dir, "nation")
        kinds = {f.name: {"integer": "Int", "bigint": "BigInt"}.get(f.dataType.typeName() if f.dataType.typeName() != "long" else "bigint", "String") for f in nation.schema}
        table = db.create_table("nation", [CatalogColumn(n, k, n != "n_nationkey") for n, k in kinds.items()], clustered=["n_nationkey"])
        table.insert(nation)
        for text in statements:
            out = sqlfront.execute(db, text)
        return out

    QUERIES[name] = plan


stored("sql_insert", "INSERT INTO nation VALUES (25, 'NATION_25', 0), (26, 'NATION_26', 1)", "INSERT INTO nation (n_regionkey, n_nationkey) SELECT n_regionkey, n_nationkey + 100 FROM nation WHERE n_nationkey < 3;")
stored("sql_update", "UPDATE nation SET n_name = concat(n_name, '!'), n_regionkey = n_regionkey + 1 WHERE n_regionkey = 1 OR n_nationkey IN (3, 4)")
stored("sql_delete", "DELETE FROM nation WHERE n_regionkey = 1 AND n_nationkey > 5")
stored("sql_select_stored", "DELETE FROM nation WHERE n_nationkey = 7", "SELECT n_regionkey, COUNT(*) n FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1 ORDER BY n_regionkey")

# scalar functions


def padded() -> F.Column:
    return strings.concat(F.lit("  "), F.col("p_name"), F.lit(" "))


mapped("str_concat", "part", "p_partkey", v=lambda: strings.concat(F.col("p_brand"), F.lit(":"), F.col("p_type")))
mapped("str_ascii", "part", "p_partkey", v=lambda: strings.ascii_(F.col("p_type")))
mapped("str_char", "nation", "n_nationkey", v=lambda: strings.char(F.col("n_nationkey") + 65))
mapped(
    "str_charindex", "part", "p_partkey", v=lambda: strings.charindex("widget", F.col("p_name")), v0=lambda: strings.charindex("widget", F.col("p_name")) - 1
)
mapped("str_datalength", "documents", "doc_id", v=lambda: strings.datalength(F.col("text")))
mapped("str_left", "part", "p_partkey", v=lambda: strings.left(F.col("p_type"), 3))
mapped("str_right", "part", "p_partkey", v=lambda: strings.right(F.col("p_type"), 3))
mapped("str_length", "part", "p_partkey", v=lambda: strings.length(F.col("p_name")))
mapped("str_length_trimmed", "part", "p_partkey", v=lambda: strings.length_trimmed(padded()))
mapped("str_lower", "part", "p_partkey", v=lambda: strings.lower(F.col("p_type")))
mapped("str_upper", "part", "p_partkey", v=lambda: strings.upper(F.col("p_name")))
mapped("str_trim", "part", "p_partkey", v=lambda: strings.trim(padded()))
mapped("str_ltrim", "part", "p_partkey", v=lambda: strings.ltrim(padded()))
mapped("str_rtrim", "part", "p_partkey", v=lambda: strings.rtrim(padded()))
mapped("str_replace", "part", "p_partkey", v=lambda: strings.replace(F.col("p_name"), "widget", "gadget"))
mapped("str_substring", "part", "p_partkey", v=lambda: strings.substring(F.col("p_name"), 2, 4))
mapped("dt_make", "nation", "n_nationkey", v=lambda: datetimes.make(2024, 1, F.col("n_nationkey") + 1, 1, 2, 3))
mapped("dt_from_epoch", "events", "event_id", v=lambda: datetimes.from_epoch(F.col("event_id") + 1700000000))
mapped("dt_date_parts", "orders", "o_orderkey", **{n: (lambda f=f: f(F.col("o_orderdate"))) for n, f in (("y", datetimes.year), ("m", datetimes.month), ("d", datetimes.day))})
mapped("dt_time_parts", "events", "event_id", **{n: (lambda f=f: f(F.col("ts"))) for n, f in (("h", datetimes.hour), ("m", datetimes.minute), ("s", datetimes.second))})
mapped("dt_add", "events", "event_id", d3=lambda: datetimes.add_days(F.col("ts"), 3), s90=lambda: datetimes.add_seconds(F.col("ts"), 90))
mapped("dt_parse", "nation", "n_nationkey", v=lambda: datetimes.parse(F.lit("2024-04-12 12:12:12")))
mapped("dt_epoch", "orders", "o_orderkey", v=lambda: datetimes.epoch(F.col("o_orderdate")))
mapped("dt_format", "events", "event_id", v=lambda: datetimes.format_(F.col("ts")))
mapped("dec_parse", "orders", "o_orderkey", v=lambda: decimals.parse(strings.concat(F.col("o_orderkey").cast("string"), F.lit(".5")), 18, 8))
mapped("dec_add", "orders", "o_orderkey", v=lambda: decimals.add(F.col("o_totalprice").cast("decimal(18,2)"), F.lit("1.77").cast("decimal(18,2)")))


@over("dec_compare", "orders")
def dec_compare(orders: DataFrame) -> DataFrame:
    return select(orders, ["o_orderkey"], F.col("o_totalprice").cast("decimal(18,2)") > F.lit("100000.50").cast("decimal(18,2)"))
