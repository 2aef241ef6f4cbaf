"""Operators and functions on rows with nulls, ties and odd strings; SQL against plans."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from relspark.functions import compat, datetimes, decimals, strings
from relspark.operators import dml
from relspark.operators.aggregates import Agg, constant
from relspark.operators.joins import join
from relspark.operators.predicates import And, Between, Cond, IsNull, Not, Or
from relspark.operators.query import select
from relspark.operators.sorting import asc, desc
from relspark.plans import catalogue, sqlfront
from relspark.sources import files
from relspark.types import coerced, spark_type, try_coerced


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "a", "bc", 5), (2, "ab", "c", None), (3, None, "c", 7), (4, "", None, 7), (5, "a", "bc", -1)]
    return spark.createDataFrame(rows, "id int, x string, y string, n int")


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        (Cond("n", ">", 5), [3, 4]),
        (Cond("n", "!=", 7), [1, 5]),
        (Not(Cond("n", "=", 7)), [1, 5]),
        (IsNull("n"), [2]),
        (And(), [1, 2, 3, 4, 5]),
        (Or(), []),
        (Or(IsNull("x"), And(Cond("x", "=", "a"), Cond("n", "<", 0))), [3, 5]),
        (Between("n", -1, 5), [1, 5]),
        (~Cond("x", "=", "a") & Cond("id", "<=", 4), [2, 4]),
        (Cond("x", "=", "") | Cond("id", ">=", 5), [4, 5]),
    ],
)
def test_predicates(people, where, expected):
    assert ids(select(people, where=where, order_by=["id"])) == expected


def test_unknown_operator_and_name(people):
    with pytest.raises(ValueError, match="unknown operator"):
        select(people, where=Cond("n", "~", 1))
    with pytest.raises(Exception, match="nothing"):
        select(people, ["nothing"]).collect()


def test_groups_keep_keys_apart(people):
    out = select(people, group_by=["x", "y"], aggs=[Agg("count", None, "k")])
    assert {(r["x"], r["y"]): r["k"] for r in out.collect()} == {("a", "bc"): 2, ("ab", "c"): 1, (None, "c"): 1, ("", None): 1}
    assert len(select(people, group_by=["n"]).collect()) == 4


def test_aggregates(people, spark):
    aggs = [Agg("count", None, "all"), Agg("count", "n", "some"), Agg("sum", "n", "s"), Agg("avg", "n", "a"), Agg("min", "n", "lo"), Agg("max", "x", "hi"), constant("sum", 2, "twos")]
    assert tuple(select(people, aggs=aggs).first()) == (5, 4, 18, 4.5, -1, "ab", 10)
    assert tuple(select(people.limit(0), aggs=aggs).first()) == (0, 0, None, None, None, None, None)
    assert select(people, group_by=["n"], aggs=[Agg("count", None, "k")], having=Cond("k", ">", 1)).collect()[0]["n"] == 7
    for wrong in (Agg("sum", None, "s"), Agg("mode", "n", "s")):
        with pytest.raises(ValueError):
            select(people, aggs=[wrong])
    with pytest.raises(ValueError, match="having"):
        select(people, having=Cond("n", ">", 1))


def test_order(people):
    assert ids(select(people, order_by=[desc("n", nulls_last=True), asc("id")])) == [3, 4, 1, 5, 2]
    assert ids(select(people, order_by=[asc("n"), desc("id")])) == [2, 5, 1, 4, 3]
    assert ids(select(people, ["id"], order_by=[asc("x", nulls_last=True), desc("id")], limit=3)) == [4, 5, 1]


def test_joins(people):
    same = join(people, people, [("y", "=", "y"), ("id", "<", "id")])
    assert same.columns == ["id", "x", "y", "n", "id_right", "x_right", "y_right", "n_right"]
    assert sorted((r["id"], r["id_right"]) for r in same.collect()) == [(1, 5), (2, 3)]
    assert sorted(ids(join(people, people, [("n", "=", "n")], how="left_anti"))) == [2]
    with pytest.raises(ValueError):
        join(people, people, [])


def test_changes(people):
    changed = dml.update(people, {"x": "z"}, Cond("n", ">", 5))
    assert [r["x"] for r in changed.orderBy("id").collect()] == ["a", "ab", "z", "z", "a"]
    assert sorted(ids(dml.delete(people, Cond("n", "=", 7)))) == [1, 2, 5]
    assert dml.delete(people).collect() == [] == dml.truncate(people).collect()
    assert dml.insert(people, people.select("n", "y", "x", F.col("id").cast("long").alias("id"))).count() == 10


ODD = ["", "   ", "\t a \n", "ab  ", "é", "vaf", "x" * 5000, "aab", None]


def model_charindex(needle, s, start=0):
    if not needle or not s or start < 0 or start >= len(s) or len(needle) > len(s):
        return 0
    return s.find(needle, start)


def test_strings(spark):
    df = spark.createDataFrame([(s,) for s in ODD], "s string")
    s = F.col("s")
    out = df.select(
        strings.trim(s), strings.ltrim(s), strings.rtrim(s), strings.length_trimmed(s), strings.datalength(s), strings.ascii_(s), strings.left(s, 2), strings.right(s, 2),
        strings.replace(s, "ab", "b"), strings.substring(s, 2, 2), strings.charindex("a", s), strings.upper(s), strings.lower(s), strings.concat(s, s),
    ).collect()
    blanks = strings.BLANKS
    for text, row in zip(ODD, out, strict=True):
        if text is None:
            assert set(row) == {None}
            continue
        assert tuple(row)[:13] == (
            text.strip(blanks), text.lstrip(blanks), text.rstrip(blanks), len(text.strip(blanks)), len(text.encode()), ord(text[0]) if text else 0, text[:2], text[-2:],
            text.replace("ab", "b"), text[1:3], text.find("a") + 1, text.upper(), text.lower(),
        )
    assert df.select(strings.char(F.lit(65))).first()[0] == "A"


def test_compat(spark):
    df = spark.createDataFrame([(s,) for s in ODD[:-1]], "s string")
    s = F.col("s")
    blanks = strings.BLANKS
    for start in (0, 1, 3, -1):
        assert [r[0] for r in df.select(compat.charindex("a", s, start)).collect()] == [model_charindex("a", x, start) for x in ODD[:-1]]
    assert [r[0] for r in df.select(compat.left(s)).collect()] == ODD[:-1]
    assert [r[0] for r in df.select(compat.right(s, 1)).collect()] == [x[-1:] for x in ODD[:-1]]
    assert [r[0] for r in df.select(compat.length(s)).collect()] == [len(x.strip(blanks)) or len(x) for x in ODD[:-1]]
    assert [r[0] for r in df.select(compat.trim(s)).collect()] == [x.strip(blanks) or x for x in ODD[:-1]]
    assert [r[0] for r in df.select(compat.ltrim(s)).collect()] == [x.lstrip(blanks) or x for x in ODD[:-1]]
    for a, b in ((0, 0), (1, 2), (2, 9), (3, 1)):
        assert [r[0] for r in df.select(compat.substring(s, a, b)).collect()] == [x if b < a or b >= len(x) else x[a : b + 1] for x in ODD[:-1]]
    names = spark.createDataFrame([("b",), ("a",), ("aa",), ("",)], "s string")
    assert [r[0] for r in select(names, order_by=compat.string_order("s")).collect()] == ["", "b", "a", "aa"]


def test_datetimes(spark):
    t = datetime.datetime(1962, 4, 12, 12, 12, 12)
    df = spark.createDataFrame([(t,)], "t timestamp_ntz")
    c = F.col("t")
    row = df.select(
        datetimes.year(c), datetimes.month(c), datetimes.day(c), datetimes.hour(c), datetimes.minute(c), datetimes.second(c), datetimes.format_(c),
        datetimes.add_days(c, 365), datetimes.add_seconds(c, -13), datetimes.from_epoch(datetimes.epoch(c)), datetimes.make(1962, 4, 12, 12, 12, 12),
        datetimes.is_valid(F.lit(2024), F.lit(2), F.lit(30)), datetimes.is_valid(F.lit(2024), F.lit(2), F.lit(29)), datetimes.now() > c,
    ).first()
    delta = datetime.timedelta
    assert tuple(row) == (1962, 4, 12, 12, 12, 12, "1962-04-12 12:12:12", t + delta(365), t - delta(seconds=13), t, t, False, True, True)


def test_decimals(spark):
    df = spark.createDataFrame([("-1.5",), ("0",), ("10",), ("1.9",), ("2.0",)], "s string")
    d = decimals.parse(F.col("s"), 18, 2)
    rows = df.select(d, decimals.is_positive(d), decimals.scale_digits(F.col("s")), decimals.to_string(decimals.add(d, d))).collect()
    assert [r[0] for r in rows] == [Decimal(x) for x in ("-1.5", "0", "10", "1.9", "2.0")]
    assert [r[1] for r in rows] == [False, True, True, True, True]
    assert [r[2] for r in rows] == [1, 0, 0, 1, 1]
    assert [r[3] for r in rows] == ["-3.00", "0.00", "20.00", "3.80", "4.00"]
    assert df.where(d > Decimal("1.9")).count() == 2


def test_types(spark):
    df = spark.createDataFrame([("300",), ("12abc",), ("1",), ("yes",), (None,)], "s string")
    assert [r[0] for r in df.select(try_coerced(F.col("s"), "TinyInt")).collect()] == [None, None, 1, None, None]
    assert [r[0] for r in df.select(try_coerced(F.col("s"), "Bool")).collect()] == [None, None, True, None, None]
    for kind in ("TinyInt", "Int", "Bool", "DateTime"):
        with pytest.raises(Exception):  # noqa: B017
            df.select(coerced(F.col("s"), kind)).collect()
    assert spark_type("Decimal(10, 2)").simpleString() == "decimal(10,2)"
    with pytest.raises(ValueError):
        spark_type("Float")


def test_sql_text(spark, people):
    text = "SELECT id FROM people WHERE id >= 2 GROUP BY id HAVING id > 0 ORDER BY id DESC;"
    assert ids(sqlfront.query(spark, text, people=people)) == [5, 4, 3, 2]
    assert sqlfront.tokenize("SELECT * FROM t1 WHERE a>=25 ;")[:4] == [("keyword", "SELECT"), ("wildcard", "*"), ("keyword", "FROM"), ("identifier", "t1")]
    assert sqlfront.tokenize("a != 'x'")[1:] == [("operator", "!="), ("unknown", "'"), ("identifier", "x"), ("unknown", "'")]


def test_files(spark, people, tmp_path):
    for fmt in files.FORMATS:
        files.write(people, f"{tmp_path}/{fmt}", fmt)
        assert files.read(spark, f"{tmp_path}/{fmt}", fmt, schema=people.schema).count() == 5
    assert files.show(select(people, ["id", "n"], order_by=["id"]), 2) == "1 || 5\n2 || NULL\nRows: 5"
    with pytest.raises(ValueError):
        files.read(spark, "x", "xml")


def test_catalogue_is_whole():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
