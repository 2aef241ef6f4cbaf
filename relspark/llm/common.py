"""What the operators share: the word pattern, the shared folder, written tables."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that end a word, as a regular expression's class.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session of one process may go without; it gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='relspark-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, files: int = 0) -> DataFrame:
    """df as Parquet in the shared folder, read again: its lineage ends there and survives lost executors. The application's end removes it.

    ``files``: no more than so many, which the caller takes from the size of the data (see ``files_for``); else as many as df has partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(files) if files else df).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def files_for(rows: int, row_bytes: int, file_bytes: int = 8 << 20, least: int = 8) -> int:
    """How many files take so many rows: at least ``least``, and more in proportion to the data, whatever cores there are."""
    return max(least, -(-rows * row_bytes // file_bytes))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many more underscores as it takes to differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once for each context, so that they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_relspark_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="relspark-"), "relspark.zip")  # the driver serves it to executors as long as it runs
    with open(path, "wb") as f:
        f.write(held.getvalue())
    context.addPyFile(path)
    context._relspark_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key(*columns: Column) -> Column:
    """32 hexadecimal digits of two hashes, with seeds of their own, of the columns and of which of them are null."""
    nulls = [c.isNull() for c in columns]
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *nulls, *columns)), 16, "0") for seed in (1, 2)])


def words(text: Column) -> Column:
    """The array of a text's words."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def batch_columns(batch, *names):
    """Columns of an Arrow batch by name."""
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
