"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary labelled texts, one on toxic ones. Most of a toxic text is ordinary prose, on which a
dictionary trained on whole toxic texts spends itself; so what it is trained on are the stretches of toxic texts whose runs of
``GRAMS`` bytes are surely more frequent in toxic texts (see ``stretches``). README has held-out figures. Every window of a text is compressed
after the ordinary dictionary alone and after both, the toxic one nearest; the bytes the toxic one saves are the window's
distance. A logistic curve, fitted on the same labelled texts, turns the distances of all windows into a score from 0 to 1.

Bounds of the fit, all parameters of ``fit``: ``per_class`` labelled rows a class, and of these, in order of their ids' hashes, as many whole rows as have
``class_bytes`` bytes together. Where a class has more rows, those taken are weighted by the class's true count, so that the curve
sees the true shares and scores mean the same at every size. Scoring reads whole texts.

Defined cases: a null text is an empty one and has one empty window; repeated rows are scored alike; without labels of both classes every
score is the share of toxic labels (0 without any); a row with a null id is never held out.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_columns, removed, whole_text, written


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    window: int
    step: int
    center: tuple
    scale: tuple
    weights: tuple


def compressor(content: bytes):
    """Bytes -> compressed bytes, with ``content`` as the dictionary; matches of four bytes count."""
    import zstandard as z

    how = z.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=z.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    if not content:
        return z.ZstdCompressor(compression_params=how).compress
    held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return z.ZstdCompressor(dict_data=held, compression_params=how).compress


class Distances:
    def __init__(self, model: Model):
        self.window, self.step = model.window, model.step
        self.with_toxic, self.without = compressor(model.ordinary + model.toxic), compressor(model.ordinary)

    def features(self, text: str) -> list[float]:
        b = text.lower().encode()
        ends = range(0, max(1, len(b) - self.window + self.step), self.step)
        saved = np.array([len(self.without(w)) - len(self.with_toxic(w)) for w in (b[i : i + self.window] for i in ends)], dtype=np.float64)
        gain, strong, n = np.maximum(saved, 0), np.maximum(saved - 3, 0), len(saved)
        top = np.sort(gain)[-3:]
        mean, mean_strong = gain.sum() / n, strong.sum() / n
        return [math.sqrt(mean), mean, math.sqrt(mean_strong), top[-1], top.sum() / 3, math.log1p(gain.sum()), math.log1p(strong.sum()), float((saved >= 4).mean()), math.log1p(n)]


def expanded(x: np.ndarray) -> np.ndarray:
    """A constant, the features, and their products in pairs."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


def chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 3.0, rounds: int = 40) -> np.ndarray:
    """Row i counts ``counts[i]`` times. Newton steps, each halved until the loss falls."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((counts * (np.logaddexp(0, z) - y * z)).sum() + (keep * w * w).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = chances(x, w)
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (counts * (y - p)) - keep * w)
        part = 1.0
        while part > 1e-4 and loss(w + part * step) >= now:
            part /= 2
        if part <= 1e-4:
            break
        w, before, now = w + part * step, now, loss(w + part * step)
        if before - now < 1e-9 * before:
            break
    return w


#: Lengths of the runs of bytes that tell stretches of toxic texts, at most 8.
GRAMS = (5, 8)


def grams(text: bytes, n: int) -> np.ndarray:
    """Each run of n bytes as a number."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - n + 1), dtype=np.uint64)
    for i in range(n if len(out) else 0):
        out = (out << np.uint64(8)) | b[i : i + len(out)]
    return out


def texts_with(texts: list[bytes], n: int, held: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n bytes, in order, and how many texts have it; the counts are added up for ``held`` runs at a time."""
    values, counts, kept, size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), [], 0
    for i, t in enumerate(texts):
        kept.append(np.unique(grams(t, n)))
        size += len(kept[-1])
        if size >= held or i == len(texts) - 1:
            new, times = np.unique(np.concatenate(kept), return_counts=True)
            both, place = np.unique(np.concatenate([values, new]), return_inverse=True)
            values, counts, kept, size = both, np.bincount(place, np.concatenate([counts, times]), len(both)).astype(np.int64), [], 0
    return values, counts


def surely_toxic(toxic: list[bytes], other: list[bytes], n: int, odds: float, sure: float) -> np.ndarray:
    """Runs of n bytes at least ``odds`` times as frequent in toxic texts, with a log-likelihood ratio over ``sure`` against equal shares."""
    (runs, inside), (known, times) = texts_with(toxic, n), texts_with(other, n)
    outside = np.zeros(len(runs), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        outside = np.where(known[at] == runs, times[at], 0)
    every = inside + outside
    expected = every * len(toxic) / (len(toxic) + len(other))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (inside * np.log(inside / expected) + np.where(outside > 0, outside * np.log(outside / (every - expected)), 0.0))
    return runs[((inside + 0.5) / (outside + 0.5) * len(other) / len(toxic) > odds) & (ratio > sure)]


def stretches(toxic: list[bytes], other: list[bytes], odds: float, sure: float) -> list[bytes]:
    """Per toxic text that has any: its stretches of surely toxic runs, the samples that the toxic dictionary is trained on."""
    known = {n: surely_toxic(toxic, other, n, odds, sure) for n in GRAMS}
    out = []
    for t in toxic:
        mask = np.zeros(len(t) + 1, dtype=bool)
        for n, runs in known.items():
            hit = np.flatnonzero(np.isin(grams(t, n), runs))
            for i in range(n):
                mask[hit + i] = True
        edges = np.flatnonzero(np.diff(np.r_[False, mask].astype(np.int8)))
        if len(edges):
            out.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return out


#: Fixed value: the three offsets that a trained dictionary ends its tables with; its content follows.
OFFSETS = struct.pack("<III", 1, 4, 8)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained zstandard dictionary, without its tables; with too few samples to train one, their last bytes."""
    import zstandard as z

    try:
        trained = z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]
    return trained[trained.index(OFFSETS) + len(OFFSETS) :]


def train(
    labelled: list[tuple[str, int]], stands_for: tuple[float, float] = (1.0, 1.0), window: int = 64, step: int = 48, size: int = 32768, toxic_size: int = 1024, odds: float = 20.0, sure: float = 60.0
) -> Model:
    """From (text, label); the rows' order doesn't matter. A row of label y stands for ``stands_for[y]`` labelled rows, and a text for all rows that have it."""
    # in an order that has nothing to do with the texts, as the trainer tries what it has learned on the last ones
    rows, times = sorted({t.lower(): y for t, y in sorted(labelled)}.items(), key=lambda r: (hashlib.blake2b(r[0].encode(), digest_size=8).digest(), r[0])), Counter()
    for t, y in labelled:
        times[t.lower()] += stands_for[y]
    toxic, other = [t.encode() for t, y in rows if y], [t.encode() for t, y in rows if not y]
    flat = Model(b"", b"", window, step, (), (), ())
    if not toxic or not other:
        return flat._replace(weights=(30.0 if toxic else -30.0,))
    ordinary = dictionary([t[i : i + 128] for t in other for i in range(0, len(t), 128)], size)
    model = flat._replace(ordinary=ordinary, toxic=dictionary(stretches(toxic, other, odds, sure), toxic_size))
    measure = Distances(model)
    x, y = np.array([measure.features(t) for t, _ in rows]), np.array([y for _, y in rows], dtype=np.float64)
    counts = np.array([times[t] for t, _ in rows])
    counts *= len(rows) / counts.sum()  # so that the ridge is as strong at every size
    center = np.average(x, axis=0, weights=counts)
    scale = np.sqrt(np.average((x - center) ** 2, axis=0, weights=counts)) + 1e-9
    weights = logistic(expanded((x - center) / scale), y, counts)
    return model._replace(center=tuple(center), scale=tuple(scale), weights=tuple(weights))


def probabilities(model: Model, x: list[list[float]]) -> np.ndarray:
    if not model.center:
        return np.full(len(x), 1 / (1 + math.exp(-model.weights[0])))
    return chances(expanded((np.array(x).reshape(len(x), -1) - model.center) / model.scale), np.array(model.weights))


def scorer(model: Model):
    """For mapInArrow over (doc_id, held_out, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Distances(model)
        for batch in batches:
            if batch.num_rows:
                ids, held, texts = batch_columns(batch, "doc_id", "held_out", "text")
                score = probabilities(model, [measure.features(t.as_py()) for t in texts])
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), held, pa.array(score)], names=["doc_id", "held_out", "score"])

    return of


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000, class_bytes: int = 12 << 20) -> Model:
    """Learns from labelled rows that aren't held out: in order of their ids' hashes, of each class the first ``per_class``, as far as ``class_bytes`` go."""
    known = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label")).dropna()
    hashed = F.xxhash64("doc_id")
    one, zero = (known.where(F.col("label") == y).orderBy(hashed, "doc_id").limit(per_class) for y in (1, 0))
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    # at most 2 * per_class ids are sent out; a repeated id gives one of its rows
    rows = texts.join(F.broadcast(one.unionAll(zero)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = written(rows, "toxicity-sample", files=8)
    chosen, room = [], {0: class_bytes, 1: class_bytes}
    for r in rows.select("doc_id", "label", F.octet_length("text").alias("n")).orderBy(hashed, "doc_id").collect():
        if r["n"] <= room[r["label"]]:
            room[r["label"]] -= r["n"]
            chosen.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]))
    sample = [(r["text"], r["label"]) for r in rows.join(F.broadcast(ids), "doc_id").select("text", "label").collect()]
    counted, taken = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}, Counter(y for _, y in sample)
    removed(rows)
    return train(sample, tuple(max(1.0, counted.get(y, 0) / max(1, taken[y])) for y in (0, 1)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), whole_text(text_col).alias("text"))
    scored = read.mapInArrow(scorer(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
