"""Personal data by weak supervision, in native expressions only.

Four kinds have base patterns (email, ip, card, phone); what those find stays. Further candidates, runs of letters and digits that
may be credentials, get votes from three labelers: a regular expression of known key formats, a gazetteer of names that
go before a key, and the context. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; with the posteriors it gives, a logistic span classifier is trained over the candidate's features, and decides.
The driver sees counts only: at most 27 vote patterns times 2 ** len(FEATURES) feature patterns.

Positions are code points, ends exclusive. The patterns are written with possessive loops and look-behinds so that a search takes time in
proportion to the text; they match what the plain patterns in ``KINDS`` match.

Defined cases: a null text is an empty one and has no spans; repeated rows are searched one by one; without candidates nothing is added; an
added span that overlaps a base span is left out. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, whole_text
from .quality import bound

MAIL = "A-Za-z0-9._%+-"
#: kind: (what every text with a match contains, pattern). In the order of the results.
KINDS = {
    "email": ("@", rf"(?:(?<![{MAIL}])|\G)[{MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{10,}+"
BEFORE = 32
#: Known key formats, and names that go before a credential.
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr][A-Za-z0-9]{30,}|AIza[A-Za-z0-9]{30,}|[0-9a-f]{16,}|[0-9A-F]{16,})$"
NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)[\"']?\s{0,3}[=:]?\s{0,3}[\"']?$"
SPAN = "array<struct<kind:string,start:int,end:int>>"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether a string's digits pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(m)), ""), lambda c, i: (F.try_to_number(c, F.lit("9")).cast("int") * (i % 2 + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0))) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


STEP = 64


def scanned(values: Column, op, zero: int) -> Column:
    """The running results of an associative ``op``: each is put together from those of whole blocks of STEP ** 3, STEP ** 2 and STEP values and of the
    last values themselves, so it takes at most some hundreds of steps whatever the array's length."""
    fold = lambda x, first, n: F.aggregate(F.slice(x, first + 1, n), F.lit(zero), op)
    blocks = lambda x: F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / STEP).cast("int")), lambda k: fold(x, k * STEP, F.lit(STEP)))

    def of(x: Column) -> Column:
        def of_small(small: Column) -> Column:
            def of_middle(middle: Column) -> Column:
                def of_large(large: Column) -> Column:
                    def upto(i: Column) -> Column:
                        a, b, c = ((i / STEP**k).cast("int") for k in (1, 2, 3))
                        return op(op(fold(large, F.lit(0), c), fold(middle, c * STEP, b - c * STEP)), op(fold(small, b * STEP, a - b * STEP), fold(x, a * STEP, i - a * STEP + 1)))

                    return F.transform(x, lambda _, i: upto(i))

                return bound(blocks(middle), of_large)

            return bound(blocks(small), of_middle)

        return F.when(F.size(x) > 0, bound(blocks(x), of_small)).otherwise(x)

    return bound(values, of)


def found(text: Column, pattern: str, hint: str, before: int = 0) -> Column:
    """array<struct<m, start, end>> of a pattern's matches, found by the lengths of the pieces between them; with ``before`` also so many characters before each.

    A match has at least ten characters and one before it if ``before`` is given.
    """
    typ = f"array<struct<m:string,start:int,end:int{',before:string' if before else ''}>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if hint:
        matches = F.when(F.contains(text, F.lit(hint)), matches).otherwise(F.array().cast("array<string>"))

    def placed(ms: Column) -> Column:
        def by_gaps(gaps: Column) -> Column:
            def by_ends(ends: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    columns = [m.alias("m"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end")]
                    if before:
                        # as many of the last matches and gaps as have that many characters for certain
                        last = F.sequence(F.greatest(F.lit(0), i - before // 11 - 1), i)
                        near = F.transform(last, lambda k: F.concat(F.right(F.get(gaps, k), F.lit(before)), F.when(k < i, F.get(ms, k)).otherwise(F.lit(""))))
                        columns.append(F.right(F.array_join(near, ""), F.lit(before)).alias("before"))
                    return F.struct(*columns)

                return F.transform(ms, one)

            return bound(scanned(F.zip_with(ms, gaps, lambda m, gap: F.length(m) + F.length(gap)), lambda x, y: x + y, 0), by_ends)

        return bound(F.slice(F.split(text, pattern, -1), 1, F.size(ms)), by_gaps)

    return bound(matches, lambda ms: F.when(F.size(ms) > 0, placed(ms)).otherwise(F.array().cast(typ)))


def base_spans(text: Column) -> Column:
    """The spans of the base patterns, by kind as listed, then start."""

    def of(kind: str) -> Column:
        hint, pattern = KINDS[kind]
        good = F.filter(found(text, pattern, hint), lambda x: holds(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*[of(k) for k in KINDS])


FEATURES = ("long", "many_digits", "hexadecimal", "upper", "assigned", "quoted", "in_prose")


def candidates(text: Column) -> Column:
    """array<struct<start, end, v1, v2, v3, features>> of possible credentials."""

    def voted(c: Column) -> Column:
        m, before = c["m"], c["before"]
        n = F.length(m)
        many = F.length(digits(m)) * 4 >= n
        flags = {
            "long": n >= 16,
            "many_digits": many,
            "hexadecimal": m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
            "upper": m.rlike("^[0-9A-Z]+$"),
            "assigned": before.rlike(r"[=:]\s{0,3}[\"']?$"),
            "quoted": before.rlike("[\"']$"),
            "in_prose": before.rlike(r"[\p{L},.]\s$"),
        }
        regex = F.when(m.rlike(FORMATS), 1).when(many & (n >= 12), 0).otherwise(-1)
        gazetteer = F.when(before.rlike(NAMES) | m.rlike("^(?:AKIA|ghp|AIza)"), 1).otherwise(0)
        context = F.when(flags["assigned"], 1).when(flags["in_prose"] & ~many, -1).otherwise(0)
        bits = sum((F.when(flags[f], 1 << i).otherwise(0) for i, f in enumerate(FEATURES)), F.lit(0))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), regex.alias("v1"), gazetteer.alias("v2"), context.alias("v3"), bits.alias("bits"))

    return F.transform(found(text, SECRET, "", BEFORE), voted)


class Reliability(NamedTuple):
    prior: float
    #: Of labeler j, given the truth y: the chance of each vote.
    votes: list[dict[int, dict[int, float]]]


def em(patterns: dict[tuple[int, int, int], int], rounds: int = 60) -> tuple[Reliability, dict[tuple, float]]:
    """From counts of votes (each -1, 0 or 1): the labelers' reliabilities, and the chance of truth for each pattern."""
    post = {v: 0.5 + 0.45 * math.tanh(sum(v)) for v in patterns}
    r = Reliability(0.5, [])
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (1 + sum(n * post[v] for v, n in patterns.items())) / (2 + total)
        votes = []
        for j in range(3):
            by = {}
            for y in (0, 1):
                mass = {x: 0.5 + sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items() if v[j] == x) for x in (-1, 0, 1)}
                by[y] = {x: m / sum(mass.values()) for x, m in mass.items()}
            votes.append(by)
        r = Reliability(prior, votes)
        for v in patterns:
            one, zero = (p * math.prod(votes[j][y][v[j]] for j in range(3)) for y, p in ((1, prior), (0, 1 - prior)))
            post[v] = one / (one + zero)
    return r, post


def classifier(rows: list[tuple[int, float, float]], rounds: int = 500, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic weights (constant first) from (feature bits, chance of truth, count)."""
    weights, total = [0.0] * (len(FEATURES) + 1), sum(n for *_, n in rows) or 1
    inputs = [([1.0] + [float(bits >> i & 1) for i in range(len(FEATURES))], y, n) for bits, y, n in rows]
    for _ in range(rounds):
        slope = [ridge * w for w in weights]
        for x, y, n in inputs:
            gap = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(weights, x, strict=True)))))) - y)
            slope = [s + gap * a for s, a in zip(slope, x, strict=True)]
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


class Model(NamedTuple):
    weights: list[float]
    reliability: Reliability | None


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Votes of all candidates of all texts, the labelers' reliabilities, and the span classifier."""
    each = docs.select(F.explode(candidates(whole_text(text_col))).alias("c")).groupBy("c.v1", "c.v2", "c.v3", "c.bits").count()
    rows = [((r["v1"], r["v2"], r["v3"]), r["bits"], r["count"]) for r in each.orderBy("v1", "v2", "v3", "bits").collect()]
    if not rows:
        return Model([-30.0] + [0.0] * len(FEATURES), None)
    patterns: dict[tuple, int] = {}
    for v, _, n in rows:
        patterns[v] = patterns.get(v, 0) + n
    reliability, post = em(patterns)
    return Model(classifier([(bits, post[v], n) for v, bits, n in rows]), reliability)


def accepted(c: Column, model: Model) -> Column:
    score = F.lit(model.weights[0])
    for i, w in enumerate(model.weights[1:]):
        score = score + F.when(c["bits"].bitwiseAND(1 << i) != 0, F.lit(w)).otherwise(F.lit(0.0))
    return score > 0


def free_of(spans: Column, base: Column) -> Column:
    """Those of spans (in order, not overlapping) that overlap no base span: of all spans in order of their starts, no base one before
    reaches over the start, and none behind starts before the end."""
    typed = lambda kind, of: F.transform(of, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def among(every: Column) -> Column:
        ends = scanned(F.transform(every, lambda s: F.when(s["kind"] == 0, s["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y), -1)
        starts = F.reverse(scanned(F.reverse(F.transform(every, lambda s: F.when(s["kind"] == 0, s["start"]).otherwise(2**31 - 1))), lambda x, y: F.least(x, y), 2**31 - 1))

        def within(ends: Column) -> Column:
            clear = lambda starts: F.filter(every, lambda s, i: (s["kind"] == 1) & (F.get(ends, i) <= s["start"]) & (F.get(starts, i) >= s["end"]))
            return bound(starts, clear)

        return F.transform(bound(ends, within), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), plain).otherwise(bound(F.array_sort(F.concat(typed(0, base), typed(1, spans))), among))


def with_spans(docs: DataFrame, model: Model, base: str, spans: str, text_col: str = "text") -> DataFrame:
    """docs and two arrays of spans: the base ones, and those with the added ones after them."""
    text = whole_text(text_col)
    some = docs.withColumn(base, base_spans(text)).withColumn(spans, F.filter(candidates(text), lambda c: accepted(c, model)))
    added = F.transform(free_of(F.col(spans), F.col(base)), lambda c: F.struct(F.lit("secret").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return some.withColumn(spans, F.concat(F.col(base), added))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, a count for each base kind, base_sha256, spans, n_added."""
    model = model or fit(docs, text_col)
    read = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, "_base", "_spans")
    kinds = F.transform("_base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda s: s == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    digest = F.sha2(F.encode(listed(F.col("_base")), "UTF-8"), 256)
    return read.select("doc_id", *counts, digest.alias("base_sha256"), listed(F.col("_spans")).alias("spans"), (F.size("_spans") - F.size("_base")).cast("long").alias("n_added"))


#: Characters of a text that a substring is taken from at a time, as it has to count them from the first on.
BLOCK = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with [KIND] for every span; spans that overlap give one mark each, and no character of theirs stays."""

    def pieced(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            """Characters a to b."""
            part = lambda k: F.substring(F.get(blocks, k), F.greatest(F.lit(0), a - k * BLOCK) + 1, F.least(F.lit(BLOCK), b - k * BLOCK) - F.greatest(F.lit(0), a - k * BLOCK))
            some = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
            return F.when(b > a, F.array_join(F.transform(some, part), "")).otherwise(F.lit(""))

        def marked(ordered: Column) -> Column:
            def behind(ends: Column) -> Column:
                at = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
                one = lambda s, i: F.concat(piece(at(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.concat(F.array_join(F.transform(ordered, one), ""), piece(F.get(ends, F.size(ends) - 1), F.length(text)))

            return bound(scanned(F.transform(ordered, lambda s: s["end"]), lambda x, y: F.greatest(x, y), 0), behind)

        return bound(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), marked)

    return F.when(F.size(spans) > 0, bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieced)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced; a null text stays null."""
    base, spans = free_name(docs, "_base"), free_name(docs, "_spans")
    out = with_spans(docs, fit(docs, text_col), base, spans, text_col)
    return out.withColumn(text_col, redacted(F.col(text_col), F.col(spans))).drop(base, spans)
