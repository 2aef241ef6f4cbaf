"""Token counts under edits, and packing: exact round trips."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from relspark.llm import packing, tokens

ALPHABET = [" ", "\n", "a", "ab", "'s", "é", "1", "! ", "  ", "\t", "中", "ß", "x" * 5, "\u00a0", "<|endoftext|>", "<|endof", "text|>", "<|"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder.of(tokens.VOCABULARY)


@pytest.fixture(scope="module")
def file_ids():
    """The vocabulary file's own ids, by its own library with its defaults."""
    import public_tokenizers
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: held.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "hello <|endoftext|> world", "a  <|endoftext|><|endoftext|>\n b", "<|endoftext", "中<|endoftext|> é", "a" + " " * 30_000 + "x", "\n" * 1_500_000])
def test_ids_of_the_file(encoder, file_ids, text):
    assert encoder.ids(text) == file_ids(text)
    assert "".join(encoder.pieces(text)) == text
    assert sum(map(encoder.count, encoder.pieces(text))) == len(file_ids(text))


def test_encoders_agree(encoder):
    every = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(1, ord(tokens.SIMPLE_BELOW)))
    assert not tokens.FAR.search(every)
    assert encoder.simple(every)
    assert encoder.ids(every) == encoder.slow.encode(every, add_special_tokens=False).ids
    assert "".join(encoder.pieces(every)) == every


@pytest.mark.parametrize("block", [1, 2, 4, 64])
def test_edits_like_counting_anew(encoder, file_ids, block, monkeypatch):
    monkeypatch.setattr(tokens.TokenTree, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        tree = tokens.TokenTree(text, encoder)
        for _ in range(3):
            a = rng.randrange(len(text) + 1)
            b, new = min(len(text), a + rng.randrange(6)), "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(4)))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text == text
            assert tree.n_tokens == len(file_ids(text))


def test_edits_touch_little(encoder):
    tree = tokens.TokenTree("some words and then more of them. " * 2000, encoder)
    before = tree.encoded
    tree.edit(30_000, 30_005, "new")
    assert tree.encoded - before < 2000


def test_count_odd_rows(odd, none, file_ids):
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("stop"), F.lit("Z").alias("replacement")), F.struct(F.lit(5).alias("start"), F.lit(9_999_999).alias("stop"), F.lit(None).cast("string").alias("replacement")))
    edits = F.array_append(edits, F.struct(F.lit(None).cast("int").alias("start"), F.lit(3).alias("stop"), F.lit("no edit").alias("replacement")))
    edits = F.array_append(edits, F.lit(None).cast("struct<start:int,stop:int,replacement:string>"))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_tokens_edited"]) for r in tokens.count_tokens(odd, edits).collect()), key=str)
    count = lambda t: len(file_ids(t))
    want = sorted(((r["doc_id"], count(r["text"] or ""), count("Z" + (r["text"] or "")[2:5])) for r in odd.collect()), key=str)
    assert got == want
    assert tokens.count_tokens(none).collect() == []
    assert tokens.count_tokens(odd).agg(F.sum("n_edits")).first()[0] == 0


@pytest.mark.parametrize("width", [8, 30, 1024])
def test_patterns(width):
    rng = random.Random(width)
    for _ in range(40):
        count = [0] * (width + 1)
        for _ in range(rng.randrange(300)):
            count[min(width, max(1, int(rng.expovariate(3 / width))))] += 1
        left, bins = list(count), 0
        for lengths, times in packing.patterns(count, width):
            assert times > 0
            assert sum(lengths) <= width
            bins += times
            for n in lengths:
                left[n] -= times
        assert not any(left)
        total = sum(n * k for n, k in enumerate(count))
        assert bins <= 1.25 * total / width + 1


def test_two_smaller_pieces_fill_better():
    count = [0] * 11
    count[6], count[3], count[2] = 1, 1, 2
    assert packing.patterns(count, 10)[0] == ([6, 2, 2], 1)


def check_pack(rows, packed, file_ids, width):
    want = []
    for d, t in rows:
        ids = np.array([*file_ids(t), 2], dtype="<u4")
        first = len(ids) % width or width if len(ids) > width else len(ids)
        cuts = [0, *range(first, len(ids) + 1, width)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed]
    assert sorted(got, key=str) == sorted(want, key=str)
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= width
    return ends


@pytest.mark.parametrize("sent_out", [0, 10**6])
def test_pack(odd, none, file_ids, sent_out, monkeypatch):
    monkeypatch.setattr(packing, "SENT_OUT", sent_out)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    ends = check_pack(rows, packing.pack(odd, width=64).collect(), file_ids, 64)
    assert len(ends) <= sum(ends.values()) / 64 + 4
    assert packing.pack(none).collect() == []
