"""A corpus pipeline of five stages over the operators of relspark.llm.

Every stage takes (spark, docs, sf_dir); its result is written and read again as the next stage's docs. All but the last return the columns of docs,
whatever they are named. A document that a stage changes keeps its id; n_chars, where there is one, follows its text.

Defined cases: a null text is an empty one, which the quality rules reject; of repeated rows, and of rows with linked texts, one stays; a row without an
id is kept like any other unless one with an id has a linked text; an empty table gives empty tables at every stage. Columns that no stage knows
go along with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import jaccard, mixing, packing, pii, quality
from relspark.llm.common import removed, ship, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ship(spark)
    return quality.kept(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of repeated rows one."""
    ship(spark)
    return jaccard.first_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials become marks."""
    ship(spark)
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    ship(spark)
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            removed(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
