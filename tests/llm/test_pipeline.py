"""The pipeline on the smallest table: every stage's decisions, one by one."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from relspark.llm import jaccard, mixing, pii, quality
    from relspark.llm.common import written

    if not Path(DATA).exists():
        pytest.skip("no test data")
    docs = written(spark.read.parquet(f"{DATA}/documents.parquet"), "docs")
    columns = set(docs.columns)
    inputs, outputs = [], []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, DATA), name)
        inputs.append(docs)
        outputs.append(out)
        docs = out
    assert all(set(o.columns) == columns for o in outputs[:-1])
    kept = {r[0] for r in quality.judge(inputs[0]).where("kept").select("doc_id").collect()}
    assert {r[0] for r in outputs[0].select("doc_id").collect()} == kept
    one = {r[0] for r in jaccard.join(inputs[1]).select("component_id").collect()}
    assert {r[0] for r in outputs[1].select("doc_id").collect()} == one
    assert pii.detect(outputs[2]).agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0
    assert outputs[2].count() == inputs[2].count()
    assert outputs[2].where("n_chars <> length(text)").count() == 0
    copies = {r["doc_id"]: r["n"] for r in outputs[3].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(copies.values()) <= 3
    words = mixing.mix(inputs[3]).agg(F.sum("size")).first()[0]  # the targets of all sources add up to all words
    assert outputs[3].select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == pytest.approx(words, rel=0.1)
    assert {r[0] for r in outputs[4].select("doc_id").distinct().collect()} == set(copies)
    assert corpus_pipeline.run(spark, DATA).count() == outputs[4].count()
