"""Exact top-k search against all pairs, with repeated ids, rows without one, and odd vectors."""

import math

import numpy as np
import pytest

from relspark.llm import topk


def brute(rows, k=5, every=50):
    held = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, x) in enumerate(held):
        if q is not None and q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(x, v, strict=False)), i is None, i or 0) for j, (i, v) in enumerate(held) if j != at)[:k]
            want += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(best)]
    return sorted(want, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    vectors = [[float(x) for x in v] for v in rng.normal(0, 0.13, (400, 12))]
    vectors[20:60] = [vectors[7]] * 40
    odd = [(1000, None), (1050, [0.1, None]), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, vectors[0]), (1200, [0.5]), (1250, []), (1300, [0.0] * 12)]
    repeated = [(50, vectors[50]), (50, vectors[99]), (7, vectors[1]), (7, vectors[1]), (None, vectors[7]), (None, vectors[7]), (-50, vectors[3]), (1350, [300.0] * 12)]
    return list(enumerate(vectors)) + odd + repeated


@pytest.mark.parametrize("how", [{}, {"block_rows": 37, "query_bytes": 300, "few": 1}, {"block_rows": 4, "k": 9}])
def test_like_all_pairs(spark, rows, how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in topk.top_k(df, **how).collect()), key=str) == brute(rows, how.get("k", 5))


def test_every_row_but_the_query_is_a_candidate(spark):
    df = spark.createDataFrame([(50, [1.0]), (7, [0.5]), (7, [0.25]), (7, [0.125])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(50, 1, 7, 256 * 128), (50, 2, 7, 256 * 64), (50, 3, 7, 256 * 32)]
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id = 50")).collect() == []


def test_bounds_drop_nothing():
    """Whatever the sizes of components, no row of the k best is proved out, and blocks out of reach are skipped."""
    rng = np.random.default_rng(4)
    for scale in (3, 300, 10**6, 4 * 10**6):
        held = (rng.normal(0, scale, (300, 24)) * rng.choice([1, 20], (300, 1))).astype(np.int64)
        queries = topk.Queries(np.arange(10, dtype=np.int64) + 10**6, np.arange(10, dtype=np.int64), held[:10], 5)
        for start in range(0, 300, 60):
            row = topk.block_row(start, list(range(start, start + 60)), held[start : start + 60].tolist(), 50).to_pylist()[0]
            assert (topk.Block(row).vectors() == held[start : start + 60]).all()
            topk.Search(topk.Block(row), 24, 8).run(queries)
        got = sorted(zip(*(c.tolist() for c in queries.found[:3]), strict=True))
        scores = held[:10] @ held.T
        assert got == sorted((q, int(scores[q, i]), int(i)) for q in range(10) for i in np.lexsort((np.arange(300), -scores[q]))[:5])
