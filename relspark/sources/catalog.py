"""Databases of typed tables as snapshots of Parquet files.

A table is a folder with data files and numbered manifests; the manifest with the highest number is the table. Every change
writes new files and then creates the next manifest, which fails if another writer was first; readers of an older snapshot
are not disturbed. An update or a delete rewrites the files that hold a row it hits, and no others. Files go through Hadoop's file systems. Two writers at once need one whose rename fails where the target exists (local disks, HDFS); on
an object store without such a rename a database takes one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dml
from ..operators.constraints import ConstraintError, check_rows
from ..operators.predicates import Predicate, as_column
from ..types import coerced, spark_type

NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


class CatalogError(ValueError):
    pass


def checked_name(name: str) -> str:
    if not NAME.fullmatch(name):
        raise CatalogError(f"not a name: {name!r}")
    return name


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    size: int | None = None

    def field(self) -> T.StructField:
        return T.StructField(self.name, spark_type(self.type), True, {"literal": self.type, **({"size": self.size} if self.size else {})})


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: list[Column]
    clustered: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    version: int = 1

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    @property
    def keys(self) -> list[list[str]]:
        return ([self.clustered] if self.clustered else []) + self.unique

    @property
    def not_null(self) -> list[str]:
        return [c.name for c in self.columns if not c.nullable]

    @classmethod
    def parsed(cls, text: str) -> TableDef:
        d = json.loads(text)
        return cls(**{**d, "columns": [Column(**c) for c in d["columns"]]})


class Files:
    """The few file operations that the catalog needs, on any file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.io = jvm.org.apache.commons.io.IOUtils

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def make(self, path: str) -> None:
        self.fs.mkdirs(self.path(path))

    def drop(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Written beside and then renamed, so that no reader sees a part of it. Fails if it is there."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(temporary), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(path) or not self.fs.rename(self.path(temporary), self.path(path)):
            self.drop(temporary)
            raise CatalogError(f"another writer was first: {path}")


class Table:
    def __init__(self, database: Database, definition: TableDef):
        self.database, self.definition, self.spark = database, definition, database.spark

    @property
    def name(self) -> str:
        return self.definition.name

    @property
    def folder(self) -> str:
        return f"{self.database.folder}/{self.name}"

    def rows(self) -> DataFrame:
        """The snapshot's rows. Filters and columns reach the Parquet scan."""
        return self._read(self.definition.data)

    def _read(self, data: Sequence[str]) -> DataFrame:
        """The rows of some of the snapshot's folders and files."""
        schema = self.definition.schema
        if not data:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{p}" for p in data])

    def columns(self) -> list[tuple[str, str, bool]]:
        return [(c.name, c.type, c.nullable) for c in self.definition.columns]

    def described(self) -> list[tuple[str, str, bool, int | None, list[int]]]:
        """Per column: name, type, whether it takes NULL, its place in the clustered key, and which of the unique keys it is in."""
        d = self.definition
        place = {c: i for i, c in enumerate(d.clustered)}
        return [(c.name, c.type, c.nullable, place.get(c.name), [i for i, k in enumerate(d.unique) if c.name in k]) for c in d.columns]

    def typed(self, rows: Sequence[Sequence[Any]]) -> DataFrame:
        """Rows of text (or None), every column given, as the table's types."""
        d = self.definition
        for r in rows:
            if len(r) != len(d.columns):
                raise ConstraintError(f"{len(d.columns)} values are needed, not {len(r)}")
        text = T.StructType([T.StructField(c.name, T.StringType()) for c in d.columns])
        raw = self.spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows], text)
        return raw.select(*[coerced(F.col(c.name), c.type).alias(c.name) for c in d.columns])

    def insert(self, rows: DataFrame | Sequence[Sequence[Any]]) -> None:
        """All rows or none; NULLs and duplicate keys are errors."""
        new = self._cast(rows if isinstance(rows, DataFrame) else self.typed(rows))
        self._add(new, self.definition.data, self.definition.not_null, self.definition.keys)

    def update(self, values: dict[str, Any], where: Predicate | SparkColumn | None = None) -> None:
        """Where no row is hit, the snapshot stays. Only constraints on changed columns are checked, for the rewritten rows."""
        d = self.definition
        dml.update(self.rows(), values, where)  # unknown columns fail whether or not a row is hit
        hit, rest = self._parted(where)
        if hit:
            keys = [k for k in d.keys if set(k) & set(values)]
            self._add(dml.update(self._read(hit), values, where), rest, [c for c in d.not_null if c in values], keys)

    def delete(self, where: Predicate | SparkColumn | None = None) -> None:
        if where is None:
            self.truncate()
            return
        hit, rest = self._parted(where)
        if hit:
            self._add(dml.delete(self._read(hit), where), rest, [], [])

    def _parted(self, where: Predicate | SparkColumn | None) -> tuple[list[str], list[str]]:
        """The files with a row that the predicate hits, found by a scan of its columns alone, and all other data of the snapshot.

        The driver gets the names of those files and those beside them in their folders. A folder that isn't hit stays one entry of the manifest.
        """
        data = self.definition.data
        if where is None or not data:
            return data, []
        rows = self.rows().where(as_column(where)).select(F.col("_metadata.file_path").alias("path")).distinct()
        hit = {"/".join(r.path.split("/")[-2:]) for r in rows.collect()}
        folders, rest = {h.split("/")[0] for h in hit}, []
        for entry in data:
            if "/" in entry or entry not in folders:
                rest += [entry] if entry not in hit else []
            else:
                rest += [f for f in self._files_of(entry) if f not in hit]
        return sorted(hit), rest

    def _files_of(self, folder: str) -> list[str]:
        return [f"{folder}/{n}" for n in self.database.files.names(f"{self.folder}/data/{folder}") if not n.startswith(("_", "."))]

    def truncate(self) -> None:
        self._commit([])

    def compact(self) -> None:
        """All rows as one write, so that the clustered order, which every insert keeps for its own rows only, holds for the whole table again."""
        if len(self.definition.data) > 1:
            self._commit([self._write(self.rows())])

    def vacuum(self) -> None:
        """Removes older snapshots and the data files that only they name. Files of no snapshot may be another writer's and stay."""
        files, newest, held = self.database.files, f"{self.definition.version:08d}.json", set(self.definition.data)
        folders = {f.split("/")[0] for f in held if "/" in f}
        for name in files.names(f"{self.folder}/meta"):
            if re.fullmatch(r"\d{8}\.json", name) and name < newest:
                for part in set(TableDef.parsed(files.read(f"{self.folder}/meta/{name}")).data) - held:
                    if part in folders:  # the newest snapshot names some of its files
                        for f in set(self._files_of(part)) - held:
                            files.drop(f"{self.folder}/data/{f}")
                    else:
                        files.drop(f"{self.folder}/data/{part if part.split('/')[0] in folders else part.split('/')[0]}")
                files.drop(f"{self.folder}/meta/{name}")

    def _cast(self, rows: DataFrame) -> DataFrame:
        d = self.definition
        if set(rows.columns) != {c.name for c in d.columns}:
            raise ConstraintError(f"columns {rows.columns} are not those of {self.name}")
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in d.schema])

    def _add(self, rows: DataFrame, data: list[str], not_null: list[str], keys: list[list[str]]) -> None:
        """A snapshot of ``data`` and the rows, if these hold the constraints among themselves and beside ``data``."""
        path = self._write(rows)
        try:
            check_rows(self._read([path]), self._read(data) if data else None, not_null, keys)
            self._commit([*data, path])
        except Exception:
            self.database.files.drop(f"{self.folder}/data/{path}")
            raise

    def _write(self, rows: DataFrame) -> str:
        """Rows near each other in the clustered key share files, so that a seek skips most row groups."""
        path = f"v{self.definition.version + 1:08d}-{uuid.uuid4().hex}"
        if self.definition.clustered:
            rows = rows.repartitionByRange(*self.definition.clustered).sortWithinPartitions(*self.definition.clustered)
        writer = rows.write
        for column in {k[0] for k in self.definition.unique}:  # a lookup by a unique key skips row groups that can't hold it
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.folder}/data/{path}")
        return path

    def _commit(self, data: list[str]) -> None:
        d = TableDef(**{**self.definition.__dict__, "data": data, "version": self.definition.version + 1})
        self.database.files.create(f"{self.folder}/meta/{d.version:08d}.json", json.dumps(asdict(d)))
        self.definition = d


class Database:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.root = spark, checked_name(name), root.rstrip("/")
        self.folder, self.files = f"{self.root}/{name}.db", Files(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str) -> Database:
        db = cls(spark, root, name)
        if db.files.exists(db.folder):
            raise CatalogError(f"database {name} exists")
        db.files.make(db.folder)
        return db

    @classmethod
    def use(cls, spark: SparkSession, root: str, name: str) -> Database:
        db = cls(spark, root, name)
        if not db.files.exists(db.folder):
            raise CatalogError(f"no database {name}")
        return db

    def drop(self) -> None:
        self.files.drop(self.folder)

    def tables(self) -> list[str]:
        return [n for n in self.files.names(self.folder) if self.files.names(f"{self.folder}/{n}/meta")]

    def create_table(self, name: str, columns: Sequence[Column], clustered: Sequence[str] = (), unique: Sequence[Sequence[str]] = ()) -> Table:
        """Every key is unique; the clustered one also orders the files."""
        names = [checked_name(c.name) for c in columns]
        if checked_name(name) in self.tables():
            raise CatalogError(f"table {name} exists")
        if len(set(names)) < len(names) or not names:
            raise CatalogError("a table needs columns with different names")
        for key in [clustered, *unique]:
            if unknown := set(key) - set(names):
                raise CatalogError(f"no such column: {sorted(unknown)}")
        d = TableDef(name, list(columns), list(clustered), [list(k) for k in unique])
        _ = d.schema  # unknown types fail here
        self.files.make(f"{self.folder}/{name}/meta")
        self.files.create(f"{self.folder}/{name}/meta/{d.version:08d}.json", json.dumps(asdict(d)))
        return Table(self, d)

    def open_table(self, name: str, version: int | None = None) -> Table:
        """The newest snapshot, or an older one to read."""
        meta = f"{self.folder}/{checked_name(name)}/meta"
        found = [n for n in self.files.names(meta) if re.fullmatch(r"\d{8}\.json", n)]
        wanted = found[-1] if found and version is None else f"{version or 0:08d}.json"
        if wanted not in found:
            raise CatalogError(f"no table {name}" if version is None else f"no version {version} of {name}")
        return Table(self, TableDef.parsed(self.files.read(f"{meta}/{wanted}")))

    def drop_table(self, name: str) -> None:
        self.open_table(name)
        self.files.drop(f"{self.folder}/{name}")
