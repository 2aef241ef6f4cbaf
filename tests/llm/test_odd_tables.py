"""Every registered query of this folder over tables with nulls, odd texts, repeated rows and clashing names, and over empty tables."""

import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if n == "pipeline" or (n.startswith("op") and n[2:3].isdigit()))
CLASHING = ("_key", "_base", "_spans", "_copies", "_row", "_of", "_one", "copies", "key", "first_key", "shard", "_b", "grp", "part", "bucket", "rank", "sig", "n")


def tables(spark, folder, empty):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, source string, size int, n_words string, shard string, _1 string, score double, start int, length int")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    docs = docs.withColumns({c: F.lit("theirs") for c in CLASHING})
    vectors = [(i, [float(i % 7), 1.0, -0.5]) for i in range(120)] + [(None, [1.0]), (50, None), (50, [None, 1.0]), (100, [float("nan")]), (100, [float("inf")]), (50, [1.0]), (50, [1.0])]
    made = {
        "documents": docs,
        "labels": spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.ORG/x", None), (2, None, ""), (None, "https://x.fr.com/fr/1?q#z", "p"), (3, "no scheme", "p"), (3, "no scheme", "p"), (4, "://", None), (5, "http://" + "a." * 3000 + "com/de/" + "x" * 9000, "")], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"),
    }
    for name, df in made.items():
        extra = df.withColumns({c: F.lit("theirs") for c in ("host", "rule", "score", "rank", "query_id", "label", "held_out") if c not in df.columns})
        (extra.limit(0) if empty else extra).repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), False)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), True)


@pytest.mark.parametrize("name", NAMES)
def test_odd(spark, odd_dir, name):
    got = entry.queries()[name](spark, odd_dir)
    rows, table = got.collect(), "pages" if name.startswith("op3") else "documents"
    if name not in ("pipeline",) and not name.startswith(("op6", "op10")):
        assert len(rows) == spark.read.parquet(f"{odd_dir}/{table}.parquet").count()
    assert len(set(got.columns)) == len(got.columns)
    assert rows


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty_dir, name):
    assert entry.queries()[name](spark, empty_dir).collect() == []


def test_stages_keep_columns_and_clean_rows(spark, odd_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from relspark.llm.common import written

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, odd_dir), name)
        assert docs.columns == columns
        assert docs.where("_key <> 'theirs' or _base <> 'theirs' or _copies <> 'theirs'").count() == 0
        assert docs.count() > 0
