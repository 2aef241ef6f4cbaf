"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A sequence is filled greedily, longest piece first; then its smallest piece gives way to two unpacked ones if they
fill the widened gap more tightly. What is packed are lengths, not rows: the driver holds how many pieces there are of each length (at
most ``width`` numbers, whatever the data), and a pattern found once is used as often as its lengths last. A piece then finds
its sequence by its length and its rank among the pieces of that length.

Defined cases: a null text is an empty one; every document, the empty too, ends with the end id and so has a piece; repeated rows are
packed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_columns, whole_text, written
from .tokens import VOCABULARY, Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
PIECE_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("place", pa.int64())])


#: Rows of (task, length) that may be sent to every task, 24 bytes each.
SENT_OUT = 1_000_000


def cutter(vocabulary: str, end_id: int, width: int):
    """For mapInArrow over (doc_id, text): a row for each piece; place is its rank among the task's pieces of its length."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = Encoder.of(vocabulary), TaskContext.get().partitionId(), [0] * (width + 1)
        for batch in batches:
            out: list[list] = [[] for _ in PIECE_ARROW]
            for doc, text in zip(*batch_columns(batch, "doc_id", "text"), strict=True):
                ids = array("I", encoder.ids(text.as_py()))
                ids.append(end_id)
                bytes_ = memoryview(ids).cast("B")
                cuts = [0, *range(len(ids) % width or width, len(ids) + 1, width)] if len(ids) > width else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc.as_py(), k, a, b - a, zlib.crc32(bytes_[4 * a : 4 * b]), task, seen[b - a]), strict=True):
                        column.append(value)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE_ARROW, strict=True)], schema=PIECE_ARROW)

    return of


def greedy(count: list[int], room: int, used: dict[int, int]) -> int:
    """Takes the longest lengths that fit until none does; what is left of room."""
    n = room
    while n > 0:
        k = min((count[n] - used.get(n, 0)), room // n)
        if k > 0:
            used[n] = used.get(n, 0) + k
            room -= k * n
        n = min(n - 1, room)
    return room


def best_two(count: list[int], used: dict[int, int], gap: int, above: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is the largest one in above + 1 .. gap."""
    low, high, best = 1, gap - 1, None
    while low <= high:
        if count[high] - used.get(high, 0) <= 0:
            high -= 1
        elif count[low] - used.get(low, 0) <= 0 or (low == high and count[low] - used.get(low, 0) < 2):
            low += 1
        elif low + high > gap:
            high -= 1
        else:
            if low + high > above:
                above, best = low + high, (low, high)
            low += 1
    return best


def patterns(count: list[int], width: int) -> list[tuple[list[int], int]]:
    """From the number of pieces of each length: (lengths of a sequence, how many such sequences)."""
    count, out = list(count), []
    while any(count):
        used: dict[int, int] = {}
        gap = greedy(count, width, used)
        need = dict(used)
        if gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            used = {n: k for n, k in used.items() if k}
            need_small = need[small]
            taken = {**used, small: need_small}
            pair = best_two(count, taken, gap + small, small)
            if pair:
                for n in pair:
                    used[n] = used.get(n, 0) + 1
                    need[n] = max(need.get(n, 0), used[n])
            else:
                used[small] = used.get(small, 0) + 1
        times = min(count[n] // k for n, k in need.items())
        for n, k in used.items():
            count[n] -= k * times
        out.append(([n for n, k in sorted(used.items(), reverse=True) for _ in range(k)], times))
    return out


PLAN = "length long, low long, high long, base long, uses int, offsets array<long>"


def plan(count: list[int], width: int) -> list[tuple]:
    """Rows of PLAN: pieces of ``length`` ranked low up to high go to sequences from base on, ``uses`` of them to each."""
    base, next_rank, rows = 0, [0] * (width + 1), []
    for lengths, times in patterns(count, width):
        at, offset = {}, 0
        for n in lengths:
            at.setdefault(n, []).append(offset)
            offset += n
        for n, offsets in at.items():
            rows.append((n, next_rank[n], next_rank[n] + times * len(offsets), base, len(offsets), offsets))
            next_rank[n] += times * len(offsets)
        base += times
    return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1024, end_id: int = 2, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    pieces = written(read.mapInArrow(cutter(vocabulary, end_id, width), PIECES), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    count, tasks = [0] * (width + 1), 0
    for n, k, t in by_task.groupBy("length").agg(F.sum("n"), F.count(F.lit(1))).collect():
        count[n], tasks = k, tasks + t
    if tasks <= SENT_OUT:  # else the pieces are shuffled to their starts
        starts = F.broadcast(starts)
    table = docs.sparkSession.createDataFrame(plan(count, width), PLAN)
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("first") + F.col("place"))
    inside = F.col("rank") - F.col("low")
    fits = (F.col("p.length") == F.col("t.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return (
        ranked.alias("p")
        .join(F.broadcast(table.alias("t")), fits)
        .select("doc_id", "piece", "start", "p.length", "ids_crc32", F.expr("base + (rank - low) div uses").alias("sequence_id"), F.get("offsets", F.pmod(inside, F.col("uses")).cast("int")).alias("offset"))
    )
