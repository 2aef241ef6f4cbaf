"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give a share of all words. Its documents start with the copy number target / source size; the fractional parts are rounded
in pairs: a random transfer that keeps each partner's expected part, and the pair's words, makes one of the two integral, and the
other goes on to the next. Within a bucket the documents of a source come in falling order of size, so that partners are of like sizes and the
last one left is small. The next documents all still have the same part; one that is over ``WIDE`` times as large as the
next would turn hundreds of them integral before it is, so it is paired with all of them as one partner, whose parts move together.
The one left fractional for each source and bucket, at most, meets others of its source in a reduction tree of fixed fan-in; a source with few
rows has one bucket. A source misses its target by at most the one document that is left at the root, mostly a short one.

Defined cases: a null text has size 0 and takes 0 words; a null source is a source of its own, the last in order; rows with equal ids,
sources and sizes are counted together, dealt to buckets in parts, and rounded one by one; an empty table gives an empty result. The random
numbers depend on the seed, the bucket and the source alone, and buckets on the rows alone, so reruns agree whatever the cluster.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, files_for, free_name, row_key, whole_text, written

#: Below this a fraction is taken for 0 or 1.
TINY = 1e-9


#: A document more than so many times as large as the next meets all following ones as one partner.
WIDE = 8


def ranked(sources: DataFrame) -> DataFrame:
    """Distinct sources with their rank in code-point order (null last), counted in ranges so that no task sees all of them."""
    spark = sources.sparkSession
    parts = written(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    first, before = {}, 0
    for r in parts.groupBy("part").count().orderBy("part").collect():  # one number a partition
        first[r["part"]], before = before, before + r["count"]
    starts = spark.createDataFrame(sorted(first.items()), "part int, first long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("inside", inside).join(F.broadcast(starts), "part").withColumn("rank", F.col("first") + F.col("inside") - 1).drop("part", "inside", "first")


def targets(sizes: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """From (source, size): per source source_size, target, rank and the copy number ``rate``.

    Sources in code-point order (null last) weigh ``weights`` in turn. A target stops at ``cap`` times its source's size and the excess is shared
    again by weight, until none is above: each round sums up who is capped, in whole numbers, so that the order of summing doesn't matter.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))).withColumn("kind", (F.col("rank") % len(weights)).cast("int"))
    per = written(per, "mix-shares")
    weight, most = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind")), F.lit(float(cap)) * F.col("source_size")
    level, full = 0.0, -1
    while True:
        capped = (F.lit(level) * weight >= most) if full >= 0 else F.lit(False)
        sums = per.groupBy("kind").agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("source_size"))).alias("capped"), F.sum((~capped).cast("long")).alias("free"), F.sum(capped.cast("long")).alias("full"))
        rows = sorted(sums.collect())
        if not rows or sum(r["full"] for r in rows) == full:
            break
        full, free = sum(r["full"] for r in rows), sum(weights[r["kind"]] * r["free"] for r in rows)
        if not free:
            level = float("inf")
            break
        level = (sum(r["all"] for r in rows) - cap * sum(r["capped"] or 0 for r in rows)) / free
    target = F.least(most, F.lit(level) * weight)
    return per.select("source", "rank", "rows", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def transfer(a: float, p: float, b: float, q: float, rng: random.Random) -> tuple[float, float]:
    """New parts of two partners of sizes a and b: words go from one to the other until one of them is integral; expected parts and the sum of words stay."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if rng.random() * (up + down) < down:
        return p + up / a, q - up / b
    return p - down / a, q + down / b


def integral(p: float) -> bool:
    return p <= TINY or p >= 1 - TINY


def pivot(sizes: list[int], parts: list[float], rng: random.Random, wide: float = math.inf) -> tuple[list[int], int | None, float]:
    """Rounds parts (each from 0 up to 1) in order; gives the integral ones, and the index and part of the one left fractional.

    With ``wide``, parts are equal and sizes fall: a document over ``wide`` times as large as the next is paired with all that follow.
    """
    out, open_at, p = [0] * len(parts), None, 0.0
    rest, part = sum(sizes), parts[0] if parts else 0.0  # with ``wide``: words, and the common part, of those that follow
    for i, q in enumerate(parts):
        if math.isfinite(wide):
            q = part
        rest -= sizes[i]
        if integral(q):
            out[i] = int(q > 0.5)
            continue
        if sizes[i] == 0:
            out[i] = int(rng.random() < q)
            continue
        if open_at is None:
            open_at, p = i, q
            continue
        a, b = sizes[open_at], sizes[i]
        if a > wide * b:
            p, part = transfer(a, p, rest + b, q, rng)
            q = part
        else:
            p, q = transfer(a, p, b, q, rng)
        if integral(q):
            out[i] = int(q > 0.5)
        if integral(p):
            out[open_at] = int(p > 0.5)
            open_at, p = (None, 0.0) if integral(q) else (i, q)
    return out, open_at, p


#: A row stands for ``times`` equal ones; copies is the whole part so far; part is what is still to be rounded, null once it is decided.
STATE = "id string, rank long, size long, times long, source_size long, target double, bucket long, buckets long, copies long, part double"


def rounder(seed: int, level: int):
    """For applyInPandas: rounds the rows of whole buckets of sources, in falling order of size, then by id."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["times"])].assign(times=1)
        pdf = pdf.sort_values(["rank", "bucket", "size", "id", "copies", "part"], ascending=[True, True, False, True, True, True], kind="stable").reset_index(drop=True)
        copies, parts = pdf["copies"].tolist(), [None] * len(pdf)
        for (rank, bucket), rows in pdf.groupby(["rank", "bucket"], sort=True).groups.items():
            rows = list(rows)
            rng = random.Random(f"{seed}:{level}:{bucket}:{rank}")
            more, at, p = pivot(pdf["size"].loc[rows].tolist(), pdf["part"].loc[rows].tolist(), rng, math.inf if level else WIDE)
            for i, (row, m) in enumerate(zip(rows, more, strict=True)):
                copies[row] += m if i != at else 0
            if at is not None:
                if pdf["buckets"].at[rows[at]] == 1:
                    copies[rows[at]] += int(rng.random() < p)
                else:
                    parts[rows[at]] = p
        return pdf.assign(copies=copies, part=pd.array(parts, dtype="Float64"))

    return of


def rounded(sized: DataFrame, weights, cap: float, seed: int, bucket_rows: int, fan_in: int) -> DataFrame:
    """From written (id, source, size): STATE, one row each. A source has a bucket for each ``bucket_rows`` rows; a task's group holds whole buckets."""
    per = targets(sized, weights, cap).withColumnRenamed("source", "_source").withColumn("buckets", F.ceil(F.col("rows") / bucket_rows))
    rows, most = per.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("buckets"), F.lit(1))).first()
    # equal rows are one with a number, which is dealt out in parts, so that no bucket follows repeated rows
    each = sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    fan = F.lit(max(1, bucket_rows // 16))
    each = each.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / fan)))).withColumn("times", F.least(fan, F.col("n") - F.col("share") * fan).cast("long"))
    joined = each.join(per, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor(F.col("rate") + TINY)
    bucket = F.pmod(F.xxhash64("id", "rank", "size", "share"), F.col("buckets"))
    state = joined.select("id", "rank", "size", "times", "source_size", "target", bucket.alias("bucket"), "buckets", whole.alias("copies"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("part"))
    level, decided = 0, None
    while True:
        groups = F.lit(max(1, math.ceil(rows / bucket_rows)))
        dealt = state.groupBy(F.pmod(F.xxhash64("rank", "bucket"), groups).alias("grp"))
        state = written(dealt.applyInPandas(rounder(seed, level), STATE), f"mix-{level}", files=files_for(rows, 64))
        done = state.where(F.col("part").isNull())
        decided = done if decided is None else decided.unionByName(done)
        if most == 1:
            return decided
        rows, most, level = math.ceil(rows / fan_in), math.ceil(most / fan_in), level + 1
        up = {"bucket": F.floor(F.col("bucket") / fan_in), "buckets": F.ceil(F.col("buckets") / fan_in)}
        state = state.where(F.col("part").isNotNull()).withColumns(up)


def word_count(text_col: str):
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), cap: float = 3.0, seed: int = 7, bucket_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies, taken."""
    sized = written(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "mix-sizes")
    out = rounded(sized, weights, cap, seed, bucket_rows, fan_in)
    return out.select(F.col("id").cast("long").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), cap: float = 3.0, seed: int = 7, bucket_rows: int = 4096, fan_in: int = 64) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. Rows are told apart by 128 bits of hashes of all columns."""
    key, n = free_name(docs, "_key"), free_name(docs, "_copies")
    keyed = docs.withColumn(key, row_key(*[F.col(f"`{c}`") for c in docs.columns]))
    sized = written(keyed.select(F.col(key).alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size")), "mix-sizes")
    copies = rounded(sized, weights, cap, seed, bucket_rows, fan_in).groupBy(F.col("id").alias(key)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    # repeated rows share a key, and their copies have been added up
    taken = keyed.dropDuplicates([key]).join(copies, key)
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
