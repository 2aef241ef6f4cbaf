"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is a native expression over the words and lines of the whole text. A row of ``RULES`` names a ratio and
the closed interval it may lie in; ``compiled`` turns the table into one boolean column.

The rule of stop words knows four languages; clean texts in another one that uses none of these words fail it, so pass other ``rules`` for such a corpus.

Defined cases: a null text counts as an empty one, has no words and is rejected by the base rule; repeated rows are
judged one by one; other columns are left out, so clashing names don't matter.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, whole_text, words

SYMBOLS = "[#*$%&|<>]"
#: Frequent words of four languages.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the they this to was were which with you "
    "el la los las de del que y en un una por con para se no es al lo como "
    "le les des du et une est dans qui pour sur par pas au aux ne ce sont "
    "der die das und ist von zu den mit sich auf für im dem nicht ein eine als auch"
).split()
#: They count in small letters, with a capital first letter, and in capitals.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})


class Rule(NamedTuple):
    name: str
    ratio: str
    least: float
    most: float


#: Ratios over the measured columns. A text outside any interval is rejected.
RULES = (
    Rule("length", "n_words", 50, 10_000_000),
    Rule("mean word length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols to words", "n_symbols / n_words", 0.0, 0.3),
    Rule("stop words to words", "n_stop_words / n_words", 0.02, 1.0),
    Rule("repeated lines to lines", "n_dup_lines / n_lines", 0.0, 0.5),
)


def covered(hashes: Column, width: int) -> Column:
    """How many positions lie in windows whose hash occurs twice or more.

    The plain sort of longs gives the hashes that occur twice. A few of them are looked up in place; with more of them
    the hashes are sorted with their positions, so the work stays n log n in the length of the text.
    """

    def by_lookup(twice: Column) -> Column:
        return F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i)), lambda i: i.isNotNull())

    def by_sort(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def span(p: Column) -> Column:
        step = F.transform(p, lambda x, i: F.when(i == 0, F.lit(width)).otherwise(F.least(F.lit(width), x - F.get(p, i - 1))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(twice: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = F.when(F.size(twice) <= 16, by_lookup(twice)).otherwise(bound(pairs, by_sort))
        return F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(bound(places, span))

    twice = bound(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1))))
    return bound(twice, of)


def bound(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and the measures of its whole text."""
    text = whole_text(text_col)
    base = docs.select(F.col(id_col), text.alias("_text"), words(text).alias("_words"))
    w = F.col("_words")
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.when(n >= 3, F.zip_with(pairs, F.slice(w, 3, n - 2), lambda ab, c: F.xxhash64(ab, c))).otherwise(
        F.array().cast("array<bigint>")
    )
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    shaped = base.select(
        id_col,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        windows.alias("_windows"),
        F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))).cast("long").alias("n_stop_words"),
    )
    return shaped.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_windows"), 3).alias("n_repeat_words"),
        "n_stop_words",
        F.size("_lines").cast("long").alias("n_lines"),
    )


def compiled(rules=RULES) -> Column:
    """The threshold table as one boolean column; false where a ratio has no value."""
    ok = F.lit(True)
    for r in rules:
        value = F.expr("try_divide({}, {})".format(*r.ratio.split(" / ")) if " / " in r.ratio else r.ratio)
        ok = ok & F.coalesce(value.between(r.least, r.most), F.lit(False))
    return ok


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: the measures, base_failed, and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules))


def kept(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs, with all their columns, that the base rule and the threshold table let pass."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_of"))
    # a filter doesn't go below an exploded column; else the measures are computed again for every test in it
    judged = judge(rows, "_row", "_of", rules).select(F.explode(F.array(F.struct("_row", "kept"))).alias("_one"))
    return judged.where("_one.kept").select("_one._row.*")
