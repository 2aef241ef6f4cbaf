"""Encoders over public vocabulary files, and token counts that follow edits.

``TokenTree`` keeps a document as blocks of pre-tokens under a segment tree of (characters, tokens). An edit re-splits and
re-encodes only the blocks it touches, one block of context before them and as many after them as it takes until an old
boundary between pre-tokens is met again; then the sums on the paths above are updated.

Ids are those of the vocabulary file as it is: the content of an added token in a text becomes that token's id.

Defined cases: a null text is an empty one and counts 0 tokens; an edit with a null place is no edit, a null replacement an empty one; an edit beyond
the text's end is moved to the end; edits of one document are in the coordinates of the text as given and are applied from the last to the first
(overlapping ones see what later ones left); repeated rows are counted one by one, a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_columns, whole_text

VOCABULARY = "byte_bpe_50k"
#: Below this all libraries agree on which characters are letters, numbers and blanks; texts with others take the slower library.
SIMPLE_BELOW = "ɐ"
#: So do texts with longer runs of blanks, on which the faster one's splitter overflows its stack.
MOST_BLANKS = 10_000
FAR = re.compile(f"[^\x00-{chr(ord(SIMPLE_BELOW) - 1)}]|\\s{{{MOST_BLANKS}}}")
#: Counts that a process keeps, and characters of a piece that is kept.
MOST_COUNTS, MOST_CHARS = 500_000, 64


class Encoder:
    """The ids of ``name``.json; through the same vocabulary's ranks where both libraries split alike."""

    _loaded: dict = {}

    def __init__(self, name: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.slow = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.added = sorted((t.content for t in self.slow.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.around_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        #: Characters before and behind a place that its pre-tokens may depend on.
        self.reach = 2 + max(map(len, self.added), default=0)
        self.counts: dict[str, int] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        """One encoder for each process."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def simple(self, text: str) -> bool:
        return not FAR.search(text) and not any(t in text for t in self.added)

    def ids(self, text: str) -> list[int]:
        if self.simple(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens, which together are the text; an added token is one of them."""
        out: list[str] = []
        for i, part in enumerate(self.around_added.split(text) if self.around_added else [text]):
            if i % 2:
                out.append(part)
            elif not FAR.search(part):
                out += self.split(part)
            else:
                out += [part[a:b] for _, (a, b) in self.slow.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def count(self, piece: str) -> int:
        """Tokens of one pre-token; of short ones the counts are kept."""
        n = self.counts.get(piece)
        if n is None:
            n = len(self.fast._encode_single_piece(piece.encode())) if self.simple(piece) else len(self.slow.encode(piece, add_special_tokens=False).ids)
            if len(piece) <= MOST_CHARS:
                if len(self.counts) >= MOST_COUNTS:
                    self.counts.clear()
                self.counts[piece] = n
        return n


class TokenTree:
    """One document's pre-tokens, BLOCK in a leaf, under sums of characters and tokens."""

    BLOCK = 64

    def __init__(self, text: str, encoder: Encoder):
        self.encoder, self.encoded = encoder, len(text)
        self._build(encoder.pieces(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + self.BLOCK] for i in range(0, len(pieces), self.BLOCK)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        count = self.encoder.count
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(map(len, leaf)), sum(map(count, leaf))
        for n in range(self.width - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one, at the end), and where it starts."""
        n, start = 1, 0
        while n < self.width:
            n *= 2
            if at >= start + self.chars[n] and self.chars[n + 1]:
                start += self.chars[n]
                n += 1
        return min(n - self.width, len(self.leaves) - 1), start

    def _put(self, k: int, pieces: list[str]) -> None:
        self.leaves[k] = pieces
        n = self.width + k
        self.chars[n], self.tokens[n] = sum(map(len, pieces)), sum(map(self.encoder.count, pieces))
        while n > 1:
            n //= 2
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Characters start to stop become ``new``."""
        size = self.chars[1]
        start = min(max(0, start), size)
        stop = min(max(start, stop), size)
        reach = self.encoder.reach
        first, base = self._find(max(0, start - reach))
        last, _ = self._find(stop)
        old = "".join(p for k in range(first, last + 1) for p in self.leaves[k])
        region = old[: start - base] + new + old[stop - base :]
        while True:
            ahead, k = "", last + 1
            while k < len(self.leaves) and len(ahead) < reach:
                ahead += "".join(self.leaves[k])
                k += 1
            pieces, at, upto = self.encoder.pieces(region + ahead), 0, 0
            self.encoded += len(region) + len(ahead)
            while at < len(region):
                at += len(pieces[upto])
                upto += 1
            if at == len(region):
                break
            region, last = region + ahead, k - 1
        for k in range(first + 1, last + 1):
            self._put(k, [])
        self._put(first, pieces[:upto])
        if upto > 8 * self.BLOCK:
            self._build([p for leaf in self.leaves for p in leaf])


COUNTED = "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long"


def counter(name: str):
    """For mapInArrow over (doc_id, text, edits)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(name)
        for batch in batches:
            ids, texts, edits = batch_columns(batch, "doc_id", "text", "edits")
            out = []
            for text, changes in zip(texts, edits, strict=True):
                tree = TokenTree(text.as_py(), encoder)
                before, read = tree.n_tokens, tree.encoded
                changes = [e for e in changes.as_py() or [] if e and e["start"] is not None and e["stop"] is not None]
                changes.sort(key=lambda e: (e["start"], e["stop"]), reverse=True)
                for e in changes:
                    tree.edit(e["start"], e["stop"], e["replacement"] or "")
                out.append((before, len(changes), tree.n_tokens, tree.encoded - read))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *[pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 4)]], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"])

    return of


def count_tokens(docs: DataFrame, edits=None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of docs: its tokens, and its tokens after ``edits``: a column, array<struct<start:int,stop:int,replacement:string>> in code points."""
    none = F.array().cast("array<struct<start:int,stop:int,replacement:string>>")
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), (none if edits is None else F.coalesce(edits, none)).alias("edits"))
    return read.mapInArrow(counter(vocabulary), COUNTED)
