"""Quality rules, URL filters and personal data: native expressions against plain Python."""

import functools
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from relspark.llm import pii, quality, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a ", "b ", "c", "\n", "é ", "# ", "\x0b", "a b c ", "the "]) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_measures(spark, odd):
    rows = list(enumerate([*texts(1), "a b c " * 300, "w" + " w" * 5000])) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=str) == sorted(((d, *measures(t)) for d, t in rows), key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_kept_rows(odd, none):
    kept = quality.kept(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality.judge(odd).where("kept").count() > 0
    assert quality.kept(none).collect() == [] == quality.judge(none).collect()


URLS = [
    None, "", "no scheme example.org/es/", "http://example.org/es/1", "https://EXAMPLE.org/en/12", "http://a.example.org/en/2", "http://org/", "http://org", "http://xorg/", "http://b.com/fr/x", "http://b.com/de/x?q=/",
    "http://b.com/de", "http://b.com:80/de/", "http://://org/", "http://example.org#/es/", "http://example.org?/es/", "ftp://x.y.z.example.org/es/\n", "http://com/fr/", "http://é.com/de/é", "http://./", "http:///de/", "x://example.org/en/1", "http://org./",
]


def judged(url):
    rest = url.partition("://")[2] if url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("prefix_bytes", [1, 4])
def test_urls(spark, prefix_bytes):
    rules = spark.createDataFrame(list(urlfilter.RULES), urlfilter.RULE_TYPE)
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(URLS + URLS[3:6])], "page_id long, url string, host string, rule string, verdict string")
    got = urlfilter.filter_urls(pages, rules, prefix_bytes=prefix_bytes).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [judged(u) for u in URLS + URLS[3:6]]
    assert urlfilter.filter_urls(pages.limit(0), rules).collect() == []
    bare = urlfilter.filter_urls(pages, rules.limit(0), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in bare} == {(None, "block")}


#: The base patterns as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (i % 2 + 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


@functools.cache
def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark, odd):
    rng = random.Random(3)
    parts = ["a", "1", "12", "4", " ", "-", ".", "@", "+", "(", "é", "25", "256", "255", "\n", "_", "0", "4539578763621486", "999", "😀"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(2500)]
    some += ["a@b.c_d@e.f", "1" * 3000, "x" * 100_000 + "@", "1.2.3.4.5.6.7.8", "+1" * 50_000, "5 " * 40_000, "1.1.1.1" + "0" * 60, None, ""]
    rows = list(enumerate(some)) + [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(((d, hashlib.sha256(",".join(base(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in base(t)) for k in PLAIN)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got), key=str) == want


def test_added_spans(spark):
    rows = [(i, f"text {i} and password=7602ad27cf5550de1c{i:02d} more") for i in range(20)] + [(i, f"key AKIASJDZWJNP6ZRYWK{i:02d} of it") for i in range(20, 40)]
    rows += [(i, f"the plain word abcdefghij{i} is no secret") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert all("secret:" in got[i] for i in range(40))
    assert not any("secret:" in got[i] for i in range(40, 80))
    clean = pii.redact(docs).where("doc_id = 3").first()["text"]
    assert clean == "text 3 and password=[SECRET] more"


def test_redact(spark, odd, none):
    docs = spark.createDataFrame([(1, "é a.b@c.de, 10.0.0.1 +1 (269) 555-3296."), (2, None), (3, "")], "doc_id int, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["é [EMAIL], [IP] [PHONE].", None, ""]
    assert pii.redact(odd).columns == odd.columns
    assert pii.redact(none).collect() == [] == pii.detect(none).collect()
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(k).alias("kind")) for a, b, k in ((2, 5, "x"), (0, 3, "y"), (7, 8, "z"))])
    assert docs.where("doc_id = 2").select(pii.redacted(F.lit("0123456789"), spans.cast("array<struct<start:int,end:int,kind:string>>"))).first()[0] == "[Y][X]56[Z]89"


def test_em_finds_how_reliable_labelers_are():
    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        y = 1 if rng.random() < 0.4 else -1
        votes = tuple(y if rng.random() < p else -y for p in (0.95, 0.85, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    reliability, post = pii.em(counts)
    assert abs(reliability.prior - 0.4) < 0.05
    for labeler, p in zip(reliability.votes, (0.95, 0.85, 0.7), strict=True):
        assert abs(labeler[1][1] - p) < 0.03
        assert abs(labeler[0][-1] - p) < 0.03
    assert post[(1, 1, -1)] > 0.9 > post[(-1, 1, 1)]
