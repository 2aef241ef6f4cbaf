"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that no shard boundary splits. Groups are sorted by size and each enters the bin with
the tightest remaining capacity that still takes it, found in a balanced tree of remaining capacities.

Groups are packed in two steps. First every task packs its small groups into bundles of at most total / (shards * grain) bytes; larger groups are
bundles of their own. Any two bundles that one task fills exceed the bundle size together, so there are at most 2 * shards * grain of
them and one for each task. The bundles are dealt to regions of about ``region_bundles``, mostly one; a region has its part of the shards and packs its
bundles in one task: ``pack`` with a given capacity, which wastes at most one open bin a region, ``level`` with the smallest capacity that needs
no more than its shards. Regions differ in bytes by chance, by about one part in the root of their bundles. The driver sees one number for each region.

Defined cases: a null text is an empty one; both are one group of size-1 rows. Repeated rows share a group and get slots
of their own, those without an id too. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import files_for, removed, whole_text, written


class Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


def height(n: Node | None) -> int:
    return n.height if n else 0


def settled(n: Node) -> Node:
    n.height = 1 + max(height(n.left), height(n.right))
    return n


def turned(n: Node, side: str) -> Node:
    """n's child on the other side comes up, n goes down to ``side``."""
    other = "right" if side == "left" else "left"
    up = getattr(n, other)
    setattr(n, other, getattr(up, side))
    setattr(up, side, settled(n))
    return settled(up)


def balanced(n: Node) -> Node:
    settled(n)
    lean = height(n.left) - height(n.right)
    if lean > 1:
        if height(n.left.left) < height(n.left.right):
            n.left = turned(n.left, "left")
        return turned(n, "right")
    if lean < -1:
        if height(n.right.right) < height(n.right.left):
            n.right = turned(n.right, "right")
        return turned(n, "left")
    return n


class Tree:
    """A height-balanced search tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root: Node | None = None

    def add(self, key) -> None:
        def into(n):
            if n is None:
                return Node(key)
            if key < n.key:
                n.left = into(n.left)
            else:
                n.right = into(n.right)
            return balanced(n)

        self.root = into(self.root)

    def drop(self, key) -> None:
        def out(n, key):
            if key < n.key:
                n.left = out(n.left, key)
            elif key > n.key:
                n.right = out(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                low = n.right
                while low.left:
                    low = low.left
                n.key = low.key
                n.right = out(n.right, low.key)
            return balanced(n)

        self.root = out(self.root, key)

    def least_from(self, room: int):
        """The smallest key whose capacity is at least ``room``."""
        n, best = self.root, None
        while n:
            if n.key[0] >= room:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def pack(sizes: list[int], capacity: int, most_bins: int | None = None) -> list[int] | None:
    """The bin of each size, best fit decreasing. A size above capacity gets a bin alone. None if more than ``most_bins`` bins are needed."""
    tree, bins, out = Tree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.least_from(sizes[i])
        if found:
            tree.drop(found)
            room, at = found
        else:
            if bins == most_bins:
                return None
            room, at, bins = max(capacity, sizes[i]), bins, bins + 1
        out[i] = at
        tree.add((room - sizes[i], at))
    return out


def level(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size, under the smallest capacity for which best fit decreasing was found to need no more shards."""
    if not sizes:
        return []
    sizes, shards = list(sizes), max(1, shards)
    low, high = max(max(sizes), math.ceil(sum(sizes) / shards)), max(sizes) + math.ceil(sum(sizes) / shards)
    best = pack(sizes, high, shards)
    while low < high:
        mid = (low + high) // 2
        if (found := pack(sizes, mid, shards)) is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


#: Rows of (shard, bucket), 24 bytes each, that may be sent to every task.
SENT_OUT = 1_000_000
BUNDLED = "grp binary, size long, bundle long"
PACKED = "bundle long, region long, bin int"


def bundler(capacity: int):
    """For mapInArrow over (grp, size): packs a task's groups into bundles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        rows = rows.sort_by([("size", "descending"), ("grp", "ascending")])
        at = pack(rows["size"].to_pylist(), capacity)
        rows = rows.append_column("bundle", pa.array([(task << 32) + b for b in at], pa.int64()))
        yield from rows.to_batches(max_chunksize=50_000)

    return of


def packer(shards: int | None, capacity: int | None, regions: int):
    """For applyInArrow over a region's (bundle, size, region): the bin of each bundle, counted from 0 in the region."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("bundle", "ascending")])
        sizes, region = table["size"].to_pylist(), table["region"][0].as_py()
        at = pack(sizes, capacity) if capacity else level(sizes, shards * (region + 1) // regions - shards * region // regions)
        return table.select(["bundle", "region"]).append_column("bin", pa.array(at, pa.int32()))

    return of


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("grp"),
    )


def shard(
    docs: DataFrame,
    shards: int | None = 16,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    grain: int = 256,
    region_bundles: int = 262_144,
    bucket_rows: int = 65_536,
) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With ``capacity``, as few shards as best fit decreasing needs; else ``shards`` of them with sizes as near equal as it finds.
    """
    spark = docs.sparkSession
    rows = written(grouped(docs, id_col, text_col), "shard-rows")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    files = files_for(count, 64)
    per_shard = capacity if capacity else math.ceil(total / shards)
    most = shards if shards and not capacity else 1 + total // per_shard
    regions = max(1, min(most, 2 * most * grain // region_bundles))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("size"))
    bundled = written(groups.mapInArrow(bundler(max(1, per_shard // grain)), BUNDLED), "shard-bundles", files)
    region = F.pmod(F.xxhash64("bundle"), F.lit(regions)).alias("region")
    packed = bundled.groupBy("bundle").agg(F.sum("size").alias("size")).select("bundle", "size", region).groupBy("region").applyInArrow(packer(shards, capacity, regions), PACKED)
    packed = written(packed, "shard-packed")
    if capacity:
        used = {r["region"]: r["n"] for r in packed.groupBy("region").agg((F.max("bin") + 1).alias("n")).collect()}
        first = [sum(used.get(r, 0) for r in range(k)) for k in range(regions)]
    else:
        first = [shards * k // regions for k in range(regions)]
    starts = spark.createDataFrame(list(enumerate(first)), "region long, first int")
    home = packed.join(F.broadcast(starts), "region").select("bundle", (F.col("first") + F.col("bin")).cast("int").alias("shard"))
    buckets = max(16, -(-count // (max(1, most) * bucket_rows)))
    # rows without an id are dealt out by their place, as rows that are alike may change places
    bucket = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()), "grp"), F.lit(buckets)).cast("int")
    seated = written(rows.withColumn("_b", bucket).join(bundled.join(home, "bundle").select("grp", "shard"), "grp"), "shard-seats", files)
    removed(rows, bundled, packed)
    counts = seated.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if most * buckets <= SENT_OUT:
        starts = F.broadcast(starts)
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("doc_id", "grp")) - 1
    return (
        seated.withColumn("_r", inside)
        .join(starts, ["shard", "_b"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("_r")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
