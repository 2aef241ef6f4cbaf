"""Rows that every operator has to stand: nulls, empty and long texts, repeated rows, columns with clashing names."""

import random

import pytest

from relspark.llm.common import ship

COLUMNS = "doc_id long, text string, source string, size int, n_words string, shard string, _1 string, score double, start int, length int"


def odd_rows():
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("the of and to a in is on that by it with lorem ipsum dolor sit amet".split()) for _ in range(n))
    texts = [None, "", " \n\t", "one", "é中😀 x", prose(60), prose(300) + "\nline\nline\n" + prose(80), prose(30_000), "a@b.c +1 (269) 555-3296 10.0.0.1", "x" * 70_000, "the cat sat " * 40]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[1], (None, "no id the of and", "s1"), (None, None, None), (90, rows[6][1], "s2"), (-1, "below zero", "\U0001f600")]
    return [(*r, 7, "w", "s", "o", 0.5, None, 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    ship(spark)
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], COLUMNS)
