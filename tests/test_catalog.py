"""Typed tables: creation, inserts, constraints, changes, reopening."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from relspark.operators.constraints import ConstraintError
from relspark.plans import sqlfront
from relspark.operators.predicates import Cond, IsNull
from relspark.sources.catalog import CatalogError, Column, Database

PARCELS = [
    Column("ParcelNo", "Int", False, 4),
    Column("Depot", "Int", False, 4),
    Column("Label", "UnicodeString", True, 100),
    Column("SentAt", "DateTime"),
    Column("Insured", "Bool"),
    Column("Weight", "Decimal(12,3)"),
]


def parcel(i, kind="größe ✓ 7"):
    return [str(i), str(i), kind, "2021-11-03 08:30:05", "1", "17.250"]


@pytest.fixture
def db(spark, tmp_path):
    return Database.create(spark, f"file://{tmp_path}", "post")


@pytest.fixture
def parcels(db):
    t = db.create_table("Parcels", PARCELS, clustered=["ParcelNo", "Insured"], unique=[["Depot", "ParcelNo"]])
    t.insert([parcel(i) for i in range(20)])
    return t


def test_insert_and_reopen(db, parcels):
    again = Database.use(db.spark, db.root, "post").open_table("Parcels")
    assert again.columns() == [(c.name, c.type, c.nullable) for c in PARCELS]
    assert db.tables() == ["Parcels"]
    row = again.rows().where("ParcelNo = 7").first()
    assert tuple(row) == (7, 7, "größe ✓ 7", datetime.datetime(2021, 11, 3, 8, 30, 5), True, Decimal("17.250"))
    assert again.rows().count() == 20


def test_nulls(parcels):
    parcels.insert([["30", "30", None, None, None, None]])
    assert parcels.rows().where("ParcelNo = 30").first()[2:] == (None,) * 4
    with pytest.raises(ConstraintError, match="NOT NULL"):
        parcels.insert([[None, "31", None, None, None, None]])
    assert parcels.rows().count() == 21


@pytest.mark.parametrize("value", [(0, "3000000000"), (0, "12abc"), (4, "yes"), (3, "12 April"), (5, "x")])
def test_wrong_values(parcels, value):
    row = parcel(40)
    row[value[0]] = value[1]
    with pytest.raises(Exception):  # noqa: B017
        parcels.insert([row])
    assert parcels.rows().count() == 20


@pytest.mark.parametrize("rows", [[parcel(3)], [parcel(50), parcel(50)]])
def test_duplicate_keys(parcels, rows):
    with pytest.raises(ConstraintError, match="duplicate key"):
        parcels.insert(rows)
    assert parcels.rows().count() == 20


def test_update(parcels):
    parcels.update({"Label": "Fragile"}, Cond("ParcelNo", ">", 10))
    assert parcels.rows().where("Label = 'Fragile'").count() == 9
    parcels.update({"Depot": F.col("Depot") + 1})
    assert parcels.rows().agg(F.sum("Depot")).first()[0] == sum(range(1, 21))
    with pytest.raises(ConstraintError):
        parcels.update({"Depot": 1, "ParcelNo": 1})
    with pytest.raises(ValueError, match="no such column"):
        parcels.update({"Nothing": 1})


def test_delete_truncate_vacuum(db, parcels):
    parcels.insert([["30", "30", None, None, None, None]])
    parcels.delete(Cond("Label", "=", "größe ✓ 7"))
    assert [r[0] for r in parcels.rows().select("ParcelNo").collect()] == [30]
    parcels.delete(IsNull("Label"))
    assert parcels.rows().count() == 0
    assert db.open_table("Parcels", 2).rows().count() == 20
    parcels.truncate()
    assert parcels.rows().collect() == []
    db.files.make(f"{parcels.folder}/data/other-writer")
    parcels.vacuum()
    assert db.files.names(f"{parcels.folder}/data") == ["other-writer"]
    with pytest.raises(CatalogError, match="no version"):
        db.open_table("Parcels", 2)
    parcels.insert([parcel(1)])
    assert db.open_table("Parcels").rows().count() == 1


def test_other_writer_first(db, parcels):
    late = db.open_table("Parcels")
    parcels.insert([parcel(60)])
    with pytest.raises(CatalogError, match="another writer"):
        late.insert([parcel(61)])
    assert db.open_table("Parcels").rows().count() == 21


def test_names(db, parcels):
    for wrong in ("Parcels", "no name", "1x"):
        with pytest.raises(CatalogError):
            db.create_table(wrong, PARCELS)
    with pytest.raises(CatalogError):
        db.create_table("T", [Column("a", "Int"), Column("a", "Int")])
    with pytest.raises(CatalogError):
        db.create_table("T", [Column("a", "Int")], clustered=["b"])
    with pytest.raises(ValueError, match="unknown column type"):
        db.create_table("T", [Column("a", "Float")])
    with pytest.raises(CatalogError):
        Database.create(db.spark, db.root, "post")
    db.drop_table("Parcels")
    with pytest.raises(CatalogError):
        db.open_table("Parcels")
    db.drop()
    with pytest.raises(CatalogError):
        Database.use(db.spark, db.root, "post")


def test_seek_is_pushed_down(parcels, capsys):
    parcels.rows().where(Cond("ParcelNo", "=", 7).column()).select("Depot").explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(ParcelNo,7)" in plan
    assert "ReadSchema: struct<ParcelNo:int,Depot:int>" in plan


def test_large_values(db):
    t = db.create_table("Texts", [Column("id", "BigInt", False), Column("body", "String")])
    t.insert([["1", "x" * 5000], ["2", ""], ["3", "é"]])
    assert {r["id"]: len(r["body"]) for r in t.rows().collect()} == {1: 5000, 2: 0, 3: 1}


def test_compaction_restores_the_order(db, parcels):
    for i in (40, -5, 12345):
        parcels.insert([parcel(i)])
    assert len(parcels.definition.data) == 4
    before = sorted(map(tuple, parcels.rows().collect()))
    parcels.compact()
    assert len(parcels.definition.data) == 1
    assert sorted(map(tuple, db.open_table("Parcels").rows().collect())) == before
    assert [r[0] for r in parcels.rows().coalesce(1).select("ParcelNo").collect()] == sorted(r[0] for r in before)


@pytest.fixture
def spread(spark, db):
    """1,000 rows in one write of several files, in the order of the key."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    t = db.create_table("Spread", [Column("k", "Int", False), Column("v", "Int")], clustered=["k"], unique=[["v"]])
    t.insert(spark.range(1000).selectExpr("id k", "id + 5000 v"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(t.rows().inputFiles()) == 4
    return t


def test_changes_rewrite_only_files_they_hit(db, spread):
    before, version = set(spread.rows().inputFiles()), spread.definition.version
    spread.update({"v": -1}, Cond("k", "=", 3))
    assert len(before & set(spread.rows().inputFiles())) == 3
    spread.delete(F.col("k").between(990, 994))
    assert len(before & set(spread.rows().inputFiles())) == 2
    want = [(k, -1 if k == 3 else k + 5000) for k in range(1000) if not 990 <= k <= 994]
    assert sorted(map(tuple, db.open_table("Spread").rows().collect())) == want
    spread.update({"v": -2}, Cond("k", "=", 5000))
    spread.delete(Cond("k", "=", 5000))
    assert spread.definition.version == version + 2  # nothing hit, nothing written
    assert sorted(map(tuple, db.open_table("Spread", version).rows().collect())) == [(k, k + 5000) for k in range(1000)]
    spread.update({"v": F.col("v") + 1})
    spread.insert([["990", "7"]])
    assert len(spread.definition.data) == 2
    assert spread.rows().count() == 996


def test_changed_keys_meet_those_of_other_files(db, spread):
    held = db.files.names(f"{spread.folder}/data")
    for values in ({"v": 5900}, {"k": 900}):
        with pytest.raises(ConstraintError, match="duplicate key"):
            spread.update(values, Cond("k", "=", 3))
    with pytest.raises(ConstraintError, match="duplicate key"):
        spread.update({"v": None}, Cond("k", "<", 2))
    spread.update({"v": None}, Cond("k", "=", 3))
    with pytest.raises(ConstraintError, match="duplicate key"):
        spread.update({"v": None}, Cond("k", "=", 990))  # a null is a value like any other in a key
    with pytest.raises(ConstraintError, match="NOT NULL"):
        spread.update({"k": None}, Cond("k", "=", 990))
    assert len(db.files.names(f"{spread.folder}/data")) == len(held) + 1
    assert spread.rows().where("v IS NULL").count() == 1


def test_vacuum_of_partly_held_folders(db, spread):
    first = spread.definition.data[0]
    spread.update({"v": -1}, Cond("k", "=", 3))
    spread.vacuum()
    assert len([n for n in db.files.names(f"{spread.folder}/data/{first}") if n.endswith(".parquet")]) == 3
    assert db.open_table("Spread").rows().count() == 1000
    spread.compact()
    spread.vacuum()
    assert db.files.names(f"{spread.folder}/data") == spread.definition.data
    assert spread.rows().agg(F.sum("v")).first()[0] == sum(range(5000, 6000)) - 5003 - 1


def test_described(parcels):
    assert parcels.described()[:3] == [("ParcelNo", "Int", False, 0, [0]), ("Depot", "Int", False, None, [0]), ("Label", "UnicodeString", True, None, [])]
    assert parcels.described()[4][3] == 1


def test_statements(spark, db, parcels):
    run = lambda text: sqlfront.execute(db, text)
    spark.range(3).createOrReplaceTempView("parcels")
    assert run("SELECT COUNT(*) n FROM Parcels").first()["n"] == 20
    assert spark.table("parcels").count() == 3  # the caller's view is as it was
    assert run("INSERT INTO Parcels (Depot, ParcelNo) VALUES (1, 100), (2, 101);").count() == 22
    with pytest.raises(ConstraintError, match="duplicate key"):
        run("INSERT INTO Parcels (Depot, ParcelNo) VALUES (1, 100)")
    with pytest.raises(ConstraintError, match="NOT NULL"):
        run("INSERT INTO Parcels (Depot) VALUES (1)")
    assert run("UPDATE Parcels SET Label = 'moved', Depot = Depot + 1 WHERE Label IS NULL").where("Label = 'moved'").count() == 2
    assert run("DELETE FROM Parcels WHERE ParcelNo >= 10 AND Insured").count() == 12
    assert run("SELECT MAX(Depot) m FROM Parcels p WHERE p.Label = 'moved'").first()["m"] == 3
    assert run("DELETE FROM Parcels").count() == 0
    assert run("TRUNCATE TABLE Parcels").count() == 0
    for wrong in ("", "UPDATE Nothing SET a = 1", "UPDATE Parcels SET Nothing = 1", "INSERT INTO Parcels VALUES (1)", "INSERT OVERWRITE Parcels SELECT * FROM Parcels", "DROP TABLE"):
        with pytest.raises(Exception):  # noqa: B017
            run(wrong)
