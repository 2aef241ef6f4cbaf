"""The Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from relspark.llm import jaccard, shingles
from relspark.llm.common import ship


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in x if d is not None), default=None) for r, x in ids.items()}
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, families=8, members=14):
    """Families of near copies at many degrees of likeness, with a passage that all share."""
    rng, rows, n = random.Random(seed), [], 0
    common = [f"c{i}" for i in range(30)]
    for f in range(families):
        stem = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 80]))]
        for _ in range(members):
            text = list(stem)
            for _ in range(rng.randrange(0, 1 + len(stem) // 8)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            rows.append((n, " ".join(text + common * (f % 2))))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one  TWO"), (None, "one two"), (None, "alone here"), (3, rows[5][1]), (0, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "short"), [(1, 8), (2, 2), (3, 3), (4, 2)])
def test_like_all_pairs(spark, seed, short):
    ship(spark)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, key string")
    got = [tuple(r) for r in jaccard.join(docs, short=short).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize(
    ("how", "counted"), [({"bucket_postings": 40}, 4), ({"bucket_postings": 12, "short": 2}, 4096), ({"name_bits": 9, "most_frequent": 0}, 4)], ids=["split lists", "split to pieces", "names that clash"]
)
def test_other_ways_give_the_same(spark, monkeypatch, how, counted):
    """Lists dealt to several tasks, sets whose names clash at first, families instead of counted pairs."""
    ship(spark)
    monkeypatch.setattr(jaccard, "COUNTED_UP_TO", counted)
    rows = corpus(6, families=5, members=18)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.join(docs, **how).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_words_alike_to_sums_are_told_apart(spark):
    """Two words with the same letters in an order that cancels out in polynomials modulo a power of two, of a length on each side of LONG."""
    ship(spark)
    for k in (7, 10):
        word = "a"
        for _ in range(k):
            word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        docs = spark.createDataFrame([(1, word), (2, other), (3, word.upper())], "doc_id long, text string")
        assert sorted(tuple(r)[:3] for r in jaccard.join(docs).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


@pytest.mark.parametrize("cell", [4, 1024])
def test_link_counts_like_all_pairs(spark, cell):
    ship(spark)
    rows = corpus(5)
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda x, y: bool(x & y) and 100 * len(x & y) >= 75 * len(x | y)
    want = [(d, len(s), sum(linked(s, o) for j, o in enumerate(sets) if j != i)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), links=True, cell=cell).select("doc_id", "n_shingles", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    ship(spark)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("piece", [7, 40, 1 << 20])
def test_sets(piece, monkeypatch):
    monkeypatch.setattr(shingles, "PIECE", piece)
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "b", " ", "\n", "é", "cc ", "\x0b", "\x1c"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    got, names = list(shingles.sets(pa.array([*texts, "", "x y"]), 5)), {}
    for g, t in zip(got, [*texts, "", "x y"], strict=True):
        s = shingle_set(t)
        assert len(g) == len(s)
        assert names.setdefault(g.tobytes(), s) == s
    assert len({shingles.signature(g)[1] for g in got}) == len(names)


def test_bound_is_exact():
    law = jaccard.Bound(75, 100)
    for n in range(1, 40):
        for m in range(1, 40):
            for k in range(min(n, m) + 1):
                assert (k >= law.overlap(n, m)) == (100 * k >= 75 * (n + m - k))
    assert law.overlap(np.int64(7), np.array([7, 9])).tolist() == [6, 7]
