"""Plain file sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """csv and json want a schema: inferring one reads the files twice."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by=(), **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def show(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, ``a || b``, and how many rows there are."""
    lines = [" || ".join("NULL" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
    return "\n".join([*lines, f"Rows: {df.count()}"])
