"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Vectors are integers. A posting is a row's component in a dimension; its impact is the component's size, quantised to the number of its bits, and
a segment holds the postings of one impact in one dimension. The index is a table of blocks of rows with their segments, the highest impact
first, made once. Segments of one impact for all dimensions and many queries are processed as one product. After them, what the postings
still to come can add to a row's score is at most the query's length times the length of the row's components that no segment had
yet; rows that this bound proves below the query's k-th best score so far are out. When few are left, or no segment is, those left are
rescored exactly, in whole numbers. A block whose longest row can't reach a query's k-th best score isn't looked at for that query.

Blocks stay where they are; the queries go to them, at most ``query_bytes`` at a time, one pass over the index for each such part. A task returns k
rows a query for all blocks it read; only these are shuffled.

Defined cases: vectors that are null or hold null or non-finite components take no part; every other row is a candidate for all queries but
itself, rows with equal ids and rows without one (last among ties) included, and every row with a fitting id is a query; shorter vectors end in zeros;
ties go to the smaller id; fewer candidates than k are all returned; an empty table gives an empty result. Scores have to fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_columns, removed, written

#: no: the number of the block's first row; places: of its rows with an id divisible as asked. Arrays as bytes; values are of ``kind``.
BLOCK = "no long, n int, width int, ids binary, nulls binary, kind string, impacts binary, counts binary, rows binary, values binary, places binary"
BLOCK_ARROW = pa.schema(
    [("no", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("kind", pa.string())] + [(c, pa.binary()) for c in ("impacts", "counts", "rows", "values", "places")]
)
HITS = "query long, query_id long, vec_id long, score long"
HIT_NAMES = ["query", "query_id", "vec_id", "score"]


def quantised(column: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null if one of them is null or not finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNull() | bad, None).otherwise(F.transform(column, lambda x: F.floor(x.cast("double") * factor)))


def block_row(no: int, ids: list, vectors: list, every: int) -> pa.RecordBatch:
    """One block: the postings of its vectors, by falling impact, then dimension, then row."""
    width = max(map(len, vectors), default=0)
    held = np.zeros((len(ids), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        held[i, : len(v)] = v
    kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or np.abs(held).max(initial=0) <= np.iinfo(k).max)
    bits = np.frexp(np.abs(held).astype(np.float64))[1].T
    dims, rows = np.nonzero(bits)
    order = np.argsort(-bits[dims, rows], kind="stable")
    dims, rows, impact = dims[order], rows[order], bits[dims, rows][order]
    impacts, first = np.unique(-impact, return_index=True)
    counts = np.zeros((len(impacts), width), dtype="<i4")
    np.add.at(counts, (np.searchsorted(impacts, -impact), dims), 1)
    nulls = np.array([i is None for i in ids], dtype=bool)
    ids = np.array([0 if i is None else i for i in ids], dtype="<i8")
    places = np.flatnonzero(~nulls & (ids % every == 0)).astype("<i4")
    columns = [no, len(ids), width, ids.tobytes(), nulls.tobytes(), kind, (-impacts).astype("<i4").tobytes(), counts.tobytes(), rows.astype("<u2").tobytes(), held[rows, dims].astype(kind).tobytes(), places.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)


def indexer(rows: int, every: int):
    """For mapInArrow over (vec_id, q): blocks of at most ``rows`` rows, numbered by task and place in it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, no = [], [], TaskContext.get().partitionId() << 40
        for batch in batches:
            a, b = batch_columns(batch, "vec_id", "q")
            ids += a.to_pylist()
            vectors += b.to_pylist()
            while len(ids) >= rows:
                yield block_row(no, ids[:rows], vectors[:rows], every)
                ids, vectors, no = ids[rows:], vectors[rows:], no + rows
        if ids:
            yield block_row(no, ids, vectors, every)

    return of


class Block:
    """A block of the index."""

    def __init__(self, row: dict):
        get = lambda c, kind: np.frombuffer(row[c], dtype=kind)
        self.no, self.n, self.width = row["no"], row["n"], row["width"]
        self.ids, self.nulls, self.places = get("ids", "<i8"), get("nulls", bool), get("places", "<i4").astype(np.int64)
        self.impacts, self.rows, self.values = get("impacts", "<i4"), get("rows", "<u2"), get("values", row["kind"])
        self.counts = get("counts", "<i4").reshape(len(self.impacts), self.width)

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By falling impact: the dimensions, rows and values of all segments of that impact."""
        start = 0
        for counts in self.counts:
            end = start + int(counts.sum())
            yield np.repeat(np.arange(self.width), counts), self.rows[start:end], self.values[start:end]
            start = end

    def vectors(self) -> np.ndarray:
        out = np.zeros((self.n, self.width), dtype=np.int64)
        for dims, rows, values in self.segments():
            out[rows, dims] = values
        return out


class Queries:
    """Queries and the k best rows found for each so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.ids, self.vectors, self.k = rows, ids, vectors, k
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.least = np.full(len(rows), -np.inf)
        self.found = [np.zeros(0, dtype=np.int64) for _ in range(3)] + [np.zeros(0, dtype=bool)]  # query, score, id, whether there is none

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        query, score, ids, nulls = (np.concatenate(x) for x in zip(self.found, (query, score, ids, nulls), strict=True))
        order = np.lexsort((ids, nulls, ~score, query))  # ~score falls as score rises, and doesn't overflow
        query = query[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        order, query, full = order[place < self.k], query[place < self.k], place == self.k - 1
        self.found = [query, score[order], ids[order], nulls[order]]
        last = np.flatnonzero(full[place < self.k])
        self.least[query[last]] = self.found[1][last]

    def hits(self) -> pa.RecordBatch:
        query, score, ids, nulls = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.rows[query]), pa.array(self.ids[query]), pa.array(ids, mask=nulls), pa.array(score)], names=HIT_NAMES)


class Search:
    """One block against many queries."""

    def __init__(self, block: Block, width: int, few: int):
        self.block, self.few, self.exact = block, few, None
        self.steps, part = [], None
        left = np.zeros(block.n)
        for _, rows, values in block.segments():
            left += np.bincount(rows, values.astype(np.float64) ** 2, block.n)
        whole, self.lengths = left.sum(), np.sqrt(left)
        # what float32 may get wrong, as a part of the lengths' product
        self.error = (max(width, block.width) + 8) * 2.0**-23
        self.width = min(width, block.width)  # beyond it one of the two has zeros only
        for i, (dims, rows, values) in enumerate(block.segments()):
            part = np.zeros((block.width, block.n), dtype=np.float32) if part is None else part
            part[dims, rows] = values
            left = np.maximum(left - np.bincount(rows, values.astype(np.float64) ** 2, block.n), 0)
            last = i == len(block.impacts) - 1
            # impacts that leave most of the lengths open can't prove anything and share a product with the next
            if last or left.sum() <= whole / 8:
                self.steps.append((part[: self.width], np.zeros(block.n) if last else np.sqrt(left) * (1 + 1e-9)))
                part = None

    def possible(self, queries: Queries, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of ``some`` queries, such that no other row of the block can be among a query's k best."""
        q, k = queries.vectors[some, : self.width].astype(np.float32), queries.k
        lengths, least = queries.lengths[some][:, None], queries.least[some].copy()
        scores = np.zeros((len(some), self.block.n), dtype=np.float32)
        open_ = np.ones(scores.shape, dtype=bool)
        for i, (part, left) in enumerate(self.steps):
            scores += q @ part
            slack = lengths * (left + self.error * self.lengths)
            if i == 0 and (new := np.flatnonzero(np.isneginf(least))).size and self.block.n > k:
                # one more than k: the query's own row may be among them
                low = scores[new] - slack[new]
                least[new] = np.partition(low, self.block.n - k - 1, axis=1)[:, self.block.n - k - 1]
            open_ = scores + slack >= least[:, None]
            if open_.sum() <= self.few * len(some):
                break
        return np.nonzero(open_)

    def run(self, queries: Queries, at_once: int = 512) -> None:
        longest = self.lengths.max(initial=0.0) * (1 + 1e-9)
        wanted = np.flatnonzero(queries.lengths * longest * (1 + self.error) >= queries.least)
        for start in range(0, len(wanted), at_once):
            some = wanted[start : start + at_once]
            query, row = self.possible(queries, some)
            query = some[query]
            other = queries.rows[query] != self.block.no + row
            query, row = query[other], row[other]
            if self.exact is None:
                self.exact = self.block.vectors()[:, : self.width]
            score = np.zeros(len(row), dtype=np.int64)
            for a in range(0, len(row), 1 << 16):
                b = slice(a, a + (1 << 16))
                score[b] = np.einsum("ij,ij->i", queries.vectors[query[b], : self.width], self.exact[row[b]])
            queries.add(query, score, self.block.ids[row], self.block.nulls[row])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, as rows are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def searcher(asked, k: int, few: int):
    """For mapInArrow over blocks: the k best of a task's rows for each query of the broadcast ``asked``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors = asked.value
        queries = Queries(rows, ids, vectors, k)
        for row in rows_of(batches):
            Search(Block(row), vectors.shape[1], few).run(queries)
        yield queries.hits()

    return of


def asker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over blocks: their rows that are queries."""
    for block in map(Block, rows_of(batches)):
        if len(block.places):
            at, held = block.places, block.vectors()
            columns = [block.no + at, block.ids[at], [block.width] * len(at), [held[i].tobytes() for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["row", "id", "width", "vector"])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, factor: int = 256, block_rows: int = 4096, few: int = 32, query_bytes: int = 32 << 20) -> DataFrame:
    """Per query (rows with ids divisible by ``every``) and rank: query_id, rank, vec_id, score. A block has at most 65,536 rows."""
    spark = vectors.sparkSession
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), factor).alias("q")).where("q is not null")
    index = written(read.mapInArrow(indexer(min(block_rows, 1 << 16), every), BLOCK), "vector-index")
    queries = written(index.mapInArrow(asker, "row long, id long, width int, vector binary"), "vector-queries")
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max("width"), F.lit(0))).first()
    parts = max(1, -(-n * 8 * max(1, width) // query_bytes))
    passes = []
    for part in range(parts):
        # about query_bytes of queries, whatever the table holds
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).orderBy("row").collect()
        held = np.zeros((len(rows), width), dtype=np.int64)
        for i, r in enumerate(rows):
            held[i, : r["width"]] = np.frombuffer(r["vector"], dtype=np.int64)
        asked = spark.sparkContext.broadcast((np.array([r["row"] for r in rows], dtype=np.int64), np.array([r["id"] for r in rows], dtype=np.int64), held))
        hits = index.mapInArrow(searcher(asked, k, few), HITS)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if parts == 1:
            return best
        passes.append(written(best, "vector-hits"))
        asked.unpersist()
    removed(index, queries)
    out = passes[0]
    for more in passes[1:]:
        out = out.unionAll(more)
    return out
