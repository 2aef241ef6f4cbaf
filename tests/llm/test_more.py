"""Sharding, mixing, toxicity, top-k and families: laws and brute force on small rows."""

import math
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relspark.llm import jaccard, mixing, sharding, toxicity
from relspark.llm.common import ship


def test_tree_finds_the_tightest_room():
    rng, tree, held = random.Random(1), sharding.Tree(), set()
    for _ in range(2000):
        if held and rng.random() < 0.4:
            key = rng.choice(sorted(held))
            held.remove(key)
            tree.drop(key)
        else:
            key = (rng.randrange(50), len(held) * 1000 + rng.randrange(1000))
            if key not in held:
                held.add(key)
                tree.add(key)
        room = rng.randrange(55)
        assert tree.least_from(room) == min((k for k in held if k[0] >= room), default=None)
    assert sharding.height(tree.root) <= 1.45 * math.log2(len(held) + 2)


def brute_pack(sizes, capacity):
    rooms, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        if fits:
            out[i] = min(fits)[1]
        else:
            out[i] = len(rooms)
            rooms.append(max(capacity, sizes[i]))
        rooms[out[i]] -= sizes[i]
    return out


def test_pack_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(80))]
        assert sharding.pack(sizes, 50) == brute_pack(sizes, 50)
        if sizes:
            loads = [0] * 5
            for s, b in zip(sizes, sharding.level(sizes, 5), strict=True):
                loads[b] += s
            assert max(loads) <= max(max(sizes), math.ceil(sum(sizes) / 5) + max(sizes) // 2 + 1)


@pytest.mark.parametrize("how", [{"shards": 4}, {"shards": None, "capacity": 50_000}])
def test_shard(odd, none, how):
    rows, got = odd.collect(), sharding.shard(odd, **how).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, crc(r["text"])) for r in rows), key=str)
    slots, homes = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard(none, **how).collect() == []


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(12)
    texts = ["x" * int(rng.paretovariate(1.1) * 20) + str(i) for i in range(1500)]
    return spark.createDataFrame([(i, rng.choice(texts)) for i in range(4000)] + [(None, "none") for _ in range(500)], "doc_id long, text string")


@pytest.mark.parametrize("sent_out", [0, 10**6])
@pytest.mark.parametrize("how", [{"shards": 5}, {"shards": 24, "region_bundles": 400, "grain": 64}])
def test_bytes_of_shards_are_near_equal(many, monkeypatch, how, sent_out):
    monkeypatch.setattr(sharding, "SENT_OUT", sent_out)
    got = sharding.shard(many, **how, bucket_rows=50).collect()
    loads, groups = [0] * how["shards"], {}
    for r in got:
        loads[r["shard"]] += r["size"]
        groups[r["text_crc32"]] = groups.get(r["text_crc32"], 0) + r["size"]
    mean, largest = sum(loads) / len(loads), max(groups.values())
    spread = 0.01 if "region_bundles" not in how else 0.4  # regions of so few bundles differ by chance
    assert max(loads) <= max(largest, mean * (1 + spread) + 1)
    assert largest > mean or min(loads) >= mean * (1 - spread) - 1
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("regions", [{}, {"region_bundles": 200, "grain": 32}])
def test_capacity_is_kept_with_few_shards(many, regions):
    capacity = 60_000
    got, loads, groups = sharding.shard(many, capacity=capacity, **regions).collect(), {}, {}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        groups[r["text_crc32"], r["shard"]] = groups.get((r["text_crc32"], r["shard"]), 0) + r["size"]
    assert sorted(loads) == list(range(len(loads)))
    whole = brute_pack(list(groups.values()), capacity)
    over = [s for s in groups.values() if s > capacity]
    assert sum(x > capacity for x in loads.values()) == len(over)
    assert len(loads) <= max(whole) + 1 + (1 if not regions else 12)


def water(sizes, weights, cap):
    """Targets by sharing the excess again until none is left."""
    total, fixed = sum(sizes), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(x for i, x in enumerate(weights) if i not in fixed)
        share = {i: rest * x / w for i, x in enumerate(weights) if i not in fixed}
        over = {i: cap * sizes[i] for i, t in share.items() if t > cap * sizes[i] + 1e-9}
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed.update(over)


def test_targets(spark):
    rng = random.Random(4)
    for _ in range(3):
        sizes = [rng.choice([0, 3, 10, 500, 4000]) for _ in range(9)] + [100]
        names = [*sorted(f"s{i}" for i in range(9)), None]
        got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")).collect()}
        want = water(sizes, [i % 3 + 1 for i in range(10)], 3)
        for n, s, t in zip(names, sizes, want, strict=True):
            assert got[n]["source_size"] == s
            assert got[n]["target"] == pytest.approx(t)


def test_rounding_keeps_words_and_chances():
    ups = np.zeros(6)
    for seed in range(3000):
        out, at, p = mixing.pivot([5, 3, 8, 2, 9, 4], [0.2, 0.7, 0.5, 0.1, 0.9, 0.4], random.Random(seed))
        words = sum(x * s for x, s in zip(out, [5, 3, 8, 2, 9, 4], strict=True)) + (p * [5, 3, 8, 2, 9, 4][at] if at is not None else 0)
        assert words == pytest.approx(1 + 2.1 + 4 + 0.2 + 8.1 + 1.6)
        ups += [x if i != at else p for i, x in enumerate(out)]
    assert np.abs(ups / 3000 - [0.2, 0.7, 0.5, 0.1, 0.9, 0.4]).max() < 0.03
    sizes = sorted((random.Random(1).randrange(1, 900) for _ in range(300)), reverse=True)
    out, at, p = mixing.pivot(sizes, [0.3] * 300, random.Random(2), mixing.WIDE)
    assert abs(sum(x * s for i, (x, s) in enumerate(zip(out, sizes, strict=True)) if i != at) + (p * sizes[at] if at is not None else 0) - 0.3 * sum(sizes)) < 1e-6 * sum(sizes)


@pytest.mark.parametrize(
    ("sizes", "part"), [([10, 5], 0.1), ([900, 3, 2, 2, 0], 0.35), ([20_000, 400, 30, 30], 0.7), ([7], 0.4), ([6, 6, 6, 6], 0.25), ([1000] + [1] * 100, 0.3), ([3000, 2900, 40, 39, 2, 2, 1, 0], 0.6)]
)
def test_few_or_skewed_sizes_keep_words_and_chances(sizes, part):
    ups, rounds = np.zeros(len(sizes)), 6000
    for seed in range(rounds):
        out, at, p = mixing.pivot(sizes, [part] * len(sizes), random.Random(seed), mixing.WIDE)
        parts = [p if i == at else x for i, x in enumerate(out)]
        assert sum(x * s for x, s in zip(parts, sizes, strict=True)) == pytest.approx(part * sum(sizes))
        ups += [int(random.Random(-seed - 1).random() < p) if i == at else x for i, x in enumerate(out)]
    assert np.abs(ups / rounds - part).max() < 0.03
    assert np.dot(ups / rounds, sizes) == pytest.approx(part * sum(sizes), rel=0.04)


def test_repeated_rows_are_dealt_out(spark):
    """Rows that are alike in all that a bucket goes by don't fill one bucket."""
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    more = spark.range(3000).select("id", F.lit("a b c").alias("text"), F.lit("t").alias("source")).toDF(*docs.columns)
    got = mixing.mix(docs.unionAll(more), bucket_rows=128, fan_in=4)
    assert got.count() == 6000
    for r in got.groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 3


def test_mix(spark, odd, none):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "c", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"bucket_rows": 100, "fan_in": 3}
    got = mixing.mix(docs, **how).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7), **how).collect())
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert len(got) == 1500
    for r in got:
        assert abs(taken[r["source_size"]] - r["target"]) <= 10
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.mix(none).collect() == []
    rows = mixing.mixed(docs, **how)
    assert rows.columns == docs.columns
    # its rounding goes by hashes of rows and so differs, but not its laws
    assert rows.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert abs(rows.select(F.sum(F.length("text") / 2)).first()[0] - sum(r["size"] for r in got)) <= 4 * 60
    assert mixing.mixed(odd).columns == odd.columns


def toxic_corpus(n):
    rng = random.Random(8)
    prose = lambda k: [rng.choice("the of and to a in is on that by lorem ipsum dolor sit amet er in eo ti on".split()) + rng.choice(["", "en", "es", "th"]) for _ in range(k)]
    rows = []
    for i in range(n):
        w = prose(80)
        if bad := i % 4 == 0:
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["grumblefoe", "nastikins", "vilewort"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, odd, none):
    rows = toxic_corpus(600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, score int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(got) == 600
    assert {r[0] for r in held} == {d for d, r in got.items() if r["held_out"]}
    assert sum(got[d]["predicted"] == y for d, _, y in held) >= 0.9 * len(held)
    scored = toxicity.score(odd, labels).collect()
    assert len(scored) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert toxicity.score(none, labels).collect() == []
    assert {r["score"] < 1e-9 for r in toxicity.score(docs, labels.limit(0)).collect()} == {True}


def test_stretches_are_what_surely_tells_toxic_texts():
    rng = random.Random(10)
    prose = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet on that by the of".split()) for _ in range(40))
    toxic, other = [f"{prose()} vilewort{rng.randrange(100)} {prose()}".encode() for _ in range(300)], [prose().encode() for _ in range(900)]
    found = toxicity.stretches(toxic, other, 20, 60)
    assert len(found) == 300
    assert all(b"vilewort" in x and len(x) < 30 for x in found)
    assert toxicity.stretches(toxic[:5], toxic[5:], 20, 60) == []
    values, counts = toxicity.texts_with([b"abcabc", b"abx", b"", b"ab"], 3, held=2)
    assert {int(v).to_bytes(3, "big"): int(c) for v, c in zip(values, counts, strict=True)} == {b"abc": 1, b"bca": 1, b"cab": 1, b"abx": 1}
    samples = [x + b" " + x for x in found]
    trained = toxicity.dictionary(samples, 1024)
    assert 0 < len(trained) < 1024
    assert b"vilewort" in trained
    assert toxicity.dictionary([b"few"], 1024) == b"few"


def test_labels_of_held_out_rows(spark):
    """The documents' own labels, on rows that the fit doesn't see."""
    data = "/root/testdata/sf0.1"
    if not Path(data).exists():
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    ship(spark)
    rows = toxicity.score(docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    ones, zeros = sorted(r["score"] for r in rows if r["toxic"]), sorted(r["score"] for r in rows if not r["toxic"])
    area = sum(np.searchsorted(zeros, ones, "left") + np.searchsorted(zeros, ones, "right")) / 2 / len(ones) / len(zeros)
    right = sum(r["predicted"] and r["toxic"] for r in rows)
    print("area", area, "precision", right / sum(r["predicted"] for r in rows), "recall", right / len(ones), len(ones), len(zeros))
    assert area >= 0.86
    assert right / sum(r["predicted"] for r in rows) >= 0.7
    assert right / len(ones) >= 0.6


def test_scores_mean_the_same_when_classes_are_capped(spark):
    # a quarter of each class has no sign of it, so that shares decide its score
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("lorem ipsum dolor sit amet on that by the of".split()) for _ in range(30)) + (" vilewort" if (i % 10 == 0) != (rng.random() < 0.25) else ""), int(i % 10 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    mean = lambda **how: toxicity.score(docs, labels, **how).where("held_out").agg(F.avg("score")).first()[0]
    whole = mean()
    assert whole == pytest.approx(0.1, abs=0.04)
    assert mean(per_class=90) == pytest.approx(whole, abs=0.04)


def test_family_answers_are_those_of_all_pairs():
    """Both steps over a family, with members that bitmaps must not lose."""
    rng, law = np.random.default_rng(3), jaccard.Bound(75, 100)
    stem = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = rng.integers(0, 2**63, 40, dtype=np.uint64)[: rng.integers(0, 40)]
        sets.append(np.unique(np.concatenate([stem[rng.random(200) > rng.random() * 0.3], own])))
    linked = lambda x, y: len(np.intersect1d(x, y)) * 100 >= 75 * len(np.union1d(x, y))
    k = len(sets)
    truth = {(i, j) for i in range(k) for j in range(i) if linked(sets[i], sets[j])}
    assert 50 < len(truth) < k * (k - 1) // 2
    labels = [i // 3 for i in range(k)]
    cells = pa.table({"hub": [0] * k, "c1": [0] * k, "c2": [0] * k, "sig": list(range(k)), "label": labels, "side": pa.array([0] * k, pa.int32()), "n": [len(s) for s in sets], "bits": [jaccard.bitmap(s) for s in sets]})
    kept = set(jaccard.sifter(law)(cells)["sig"].to_pylist())
    assert {x for p in truth for x in p if labels[p[0]] != labels[p[1]]} <= kept
    work = pa.table({"sig": [*range(k), 0], "side": [*[0] * k, -1], "label": [*labels, 0], "shingles": [*[s.tobytes() for s in sets], stem[np.argsort(stem)].tobytes()]})
    found = jaccard.relater(law)(work)
    pairs = set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    assert all((max(p), min(p)) in truth for p in pairs)

    def joined(links):
        root = list(range(k))
        top = lambda x: x if root[x] == x else top(root[x])
        for a, b in links:
            root[top(labels[a])] = top(labels[b])
        return [top(x) for x in labels]

    one, two = joined(pairs), joined(truth)
    assert len(set(one)) == len(set(two)) == len(set(zip(one, two, strict=True)))


def test_screened_pairs_lose_none():
    rng, law = np.random.default_rng(4), jaccard.Bound(75, 100)
    for _ in range(200):
        base = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        x = np.unique(base)
        y = np.unique(np.concatenate([base[rng.random(len(base)) > 0.15 * rng.random()], rng.integers(0, 2**63, len(base) // 10, dtype=np.uint64)]))
        if len(y):
            row = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "na": [len(x)], "nb": [len(y)], "bits_a": [jaccard.bitmap(x)], "bits_b": [jaccard.bitmap(y)]})
            stays = next(jaccard.screener(law)(iter([row]))).num_rows
            shared = len(np.intersect1d(x, y))
            assert stays or shared < law.overlap(len(x), len(y))


def test_first_of_each(odd, none):
    first = jaccard.first_of_each(odd)
    assert first.columns == odd.columns
    texts = [r["text"] for r in first.where(F.length("text") > 20).collect()]
    assert len(texts) == len(set(texts))
    assert jaccard.first_of_each(none).collect() == []
