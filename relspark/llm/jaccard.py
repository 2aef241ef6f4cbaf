"""An exact Jaccard join of word-shingle sets that uses the relations between sets to skip work.

Equal sets are one set. Shingles are ordered from rare to frequent, and each set enters the index under its first few, of which any partner must
share one. A shingle's list in the index is in blocks of one set size, and in a block by position, so that of every block only
the start is read: beyond the position where too little could still be shared, the rest of the block is skipped.

Work on a list is linear first: its members meet one hub, the one that most lists of the bucket share. The hubs' answers are
computed and give components. Only lists that still hold different components go on. A list with few pairs that sizes and
positions leave possible across components has these compared. Other lists whose hubs are in one component form a family with one hub, and what two of its members x and y share is derived from what they share with the hub h: with the shingles of h that x lacks, and
those it has beyond h, both few if x is much like h, it is |h| less what either lacks, plus what both lack, plus what both have beyond h.
Before whole sets are sent anywhere, their bitmaps are: a bit that x has and y lacks stands for at least one shingle that y lacks, which
bounds from above what they share, and pairs whose bound is too low are done with.
Members of the family's largest component need no comparison with each other; the others meet all members in cells of bounded size.
The list of a shingle that very many sets have is dealt to several tasks by its members, with one hub for all of them; its parts are one list again
where components are told apart.

The order of shingles affects speed alone: frequent ones are those that tasks saw often; no more than ``most_frequent`` of them are sent out.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text with fewer words than a shingle
has all of them as one; repeated rows are linked like any equal texts; a null id counts as no id: it can be linked, but isn't
the smallest of a component unless there is no other. Sets are told apart by 192-bit digests: their 64-bit names are made anew with another salt
if two digests should share one. Rows are told apart by 128 bits of hashes of id and text; shingles by 64 bits (see ``shingles``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import batch_columns, files_for, free_name, removed, row_key, whole_text, written
from .components import components

U = np.uint64
POSTING = np.dtype([("t", "<u8"), ("s", "<i8"), ("n", "<u4"), ("p", "<u4")])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Bound:
    """What two sets of sizes n and m have to share for a similarity of at least part / whole."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def overlap(self, n, m):
        return -(-self.part * (n + m) // (self.part + self.whole))

    def prefix(self, n: int) -> int:
        """How many of its rarest shingles a set of n enters the index under."""
        return n - -(-self.part * n // self.whole) + 1

    def fits(self, n, m, i, j):
        """Whether sets of n and m that first meet at their places i and j can still be similar."""
        need = self.overlap(n, m)
        return (np.minimum(n, m) * self.whole >= np.maximum(n, m) * self.part) & (1 + np.minimum(n - i - 1, m - j - 1) >= need)


# first pass: sizes, signatures, frequent shingles

SIGNED = pa.schema([("key", pa.string()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("digest", pa.binary()), ("shingle", pa.int64()), ("bits", pa.binary())])


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle's low bits, among at least twice as many; half as many bits come from laying one half over the other."""
    held = np.zeros(max(64, 1 << (2 * len(s) - 1).bit_length()), dtype=bool)
    held[(s & U(len(held) - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (or rows of them) of bytes, laid over itself to ``size`` bytes."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Names:
    """How sets get their names; the same in all passes of a run."""

    def __init__(self, width: int, salt: int, bits: int):
        self.width, self.salt, self.bits = width, salt, bits

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, int, bytes]]:
        """Per text: its set, the set's name and digest."""
        for s in shingles.sets(texts, self.width):
            yield s, *shingles.signature(s, self.salt, self.bits)


def signer(names: Names, seen_often: int = 4, held: int = 2_000_000):
    """For mapInArrow over (key, doc_id, text). A row for each text; and, with a null key, a row for each shingle often seen: n times, and a set (sig) of doc_id shingles that has it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, size = set(), [], 0

        def often() -> pa.RecordBatch:
            values, first, counts = np.unique(np.concatenate([s for s, _ in kept]), return_index=True, return_counts=True)
            sizes = np.array([len(s) for s, _ in kept])
            at, some = np.searchsorted(np.cumsum(sizes), first, "right"), counts >= seen_often
            sigs = np.array([sig for _, sig in kept], dtype=np.int64)[at[some]]
            k = int(some.sum())
            return batch(SIGNED, pa.nulls(k, pa.string()), sizes[at[some]], counts[some].astype(np.int64), sigs, pa.nulls(k, pa.binary()), values[some].view(np.int64), pa.nulls(k, pa.binary()))

        for b in batches:
            keys, ids, texts = batch_columns(b, "key", "doc_id", "text")
            ns, sigs, digests, bits = [], [], [], []
            for s, sig, digest in names.of(texts):
                new = len(s) > 0 and digest not in known
                ns.append(len(s))
                sigs.append(sig if len(s) else None)
                digests.append(digest if len(s) else None)
                bits.append(bitmap(s) if new else None)
                if new:
                    known.add(digest)
                    kept.append((s, sig))
                    size += len(s)
                    if size >= held:
                        yield often()
                        kept, size = [], 0
            if b.num_rows:
                yield batch(SIGNED, keys, ids, ns, sigs, digests, pa.nulls(b.num_rows, pa.int64()), bits)
        if kept:
            yield often()

    return of


# second pass: the index

POSTED = pa.schema([("bucket", pa.int32()), ("postings", pa.binary())])


class Heavy:
    """Shingles whose lists are dealt to several tasks: into how many parts, and each one's hub and the hub's size."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)
        self.t, self.parts, self.hub, self.size = (np.array(c, dtype=d) for c, d in zip(zip(*rows) if rows else ((),) * 4, (np.uint64, np.uint64, np.int64, np.int64), strict=True))

    def places(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``t`` are heavy, and where they are in the table."""
        at = np.minimum(np.searchsorted(self.t, t), max(0, len(self.t) - 1))
        return (self.t[at] == t if len(self.t) else np.zeros(len(t), dtype=bool)), at

    def homes(self, t: np.ndarray, s: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each posting."""
        heavy, at = self.places(t)
        key = t.copy()
        if heavy.any():
            key[heavy] = shingles.mix(t[heavy] ^ shingles.mix(shingles.mix(s[heavy].view(np.uint64)) % self.parts[at[heavy]] + U(1)))
        return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def poster(names: Names, law: Bound, frequent: np.ndarray, ranks: np.ndarray, heavy: Heavy, buckets: int, held: int = 400_000):
    """For mapInArrow over (text): the postings of a task's different sets, packed by bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept, size = set(), [], 0

        def packed() -> pa.RecordBatch:
            rows = np.concatenate(kept)
            home = heavy.homes(rows["t"], rows["s"], buckets)
            order = np.argsort(home, kind="stable")
            rows, home = rows[order], home[order]
            first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
            last = np.r_[first[1:], len(home)]
            return batch(POSTED, home[first].astype(np.int32), [rows[a:b].tobytes() for a, b in zip(first, last, strict=True)])

        for b in batches:
            for s, sig, digest in names.of(batch_columns(b, "text")[0]):
                if not len(s) or digest in known:
                    continue
                known.add(digest)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    common = frequent[at] == s
                    if common.any():
                        late = s[common][np.argsort(ranks[at[common]], kind="stable")]
                        s = np.concatenate([s[~common], late])
                k = law.prefix(len(s))
                rows = np.empty(k, dtype=POSTING)
                rows["t"], rows["s"], rows["n"], rows["p"] = s[:k], sig, len(s), np.arange(k)
                kept.append(rows)
                size += k
                if size >= held:
                    yield packed()
                    kept, size = [], 0
        if kept:
            yield packed()

    return of


PAIR = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("members", pa.binary())])
PAIRS_SQL = "kind int, a long, b long, na long, nb long, members binary"


def pair_rows(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
    """Different pairs once, the smaller signature first."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, dtype=bool)
    a, b, na, nb = a[new], b[new], na[new], nb[new]
    return batch(PAIR, np.zeros(len(a), dtype=np.int32), a, b, na.astype(np.int64), nb.astype(np.int64), pa.nulls(len(a), pa.binary()))


def in_reach(law: Bound, n: np.ndarray, p: np.ndarray, hub: int) -> np.ndarray:
    """Of a list in order of size, then position: the places of those that can be similar to the one at ``hub``.

    Blocks of sizes too far from the hub's are skipped, and of the others all beyond the last position that leaves enough to share.
    """
    out = []
    sizes, first = np.unique(n, return_index=True)
    last = np.r_[first[1:], len(n)]
    low, high = np.searchsorted(sizes, -(-n[hub] * law.part // law.whole)), np.searchsorted(sizes, n[hub] * law.whole // law.part, "right")
    for k in range(low, high):
        need = law.overlap(n[hub], sizes[k])
        if n[hub] - p[hub] >= need:
            out.append(np.arange(first[k], first[k] + np.searchsorted(p[first[k] : last[k]], sizes[k] - need, "right")))
    at = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return at[at != hub]


def lister(law: Bound, short: int, heavy: Heavy):
    """For applyInArrow over a bucket's packed postings: pairs of short lists and of hubs, and the long lists themselves (a: the shingle, of a part of a list)."""

    def of(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(x, dtype=POSTING) for x in table["postings"].to_pylist()])
        rows = rows[np.lexsort((rows["s"], rows["p"], rows["n"], rows["t"]))]  # lists of blocks of one size, by position
        t, s, n, p = rows["t"], rows["s"], rows["n"].astype(np.int64), rows["p"].astype(np.int64)
        same = np.r_[False, (t[1:] == t[:-1]) & (s[1:] == s[:-1])]
        t, s, n, p = t[~same], s[~same], n[~same], p[~same]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[first, len(t)])
        each = np.repeat(size, size)
        part, place = heavy.places(t)
        keep = (each > 1) | part
        t, s, n, p, each, part, place = t[keep], s[keep], n[keep], p[keep], each[keep], part[keep], place[keep]
        pairs: list[tuple] = []
        few = np.flatnonzero((each <= short) & ~part)
        for gap in range(1, short):
            i = few[few + gap < len(t)]
            j = i + gap
            ok = t[i] == t[j]
            i, j = i[ok], j[ok]
            ok = law.fits(n[i], n[j], p[i], p[j])
            i, j = i[ok], j[ok]
            pairs.append((s[i], s[j], n[i], n[j]))
        long_lists: dict = {}
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=np.int64)
        names, name_of, weight = np.unique(s, return_inverse=True, return_counts=True)
        for a in starts[(each[starts] > short) | part[starts]]:
            at = np.arange(a, a + each[a])
            order = np.argsort(s[at])
            kept = np.empty(len(at), dtype=POSTING)
            kept["t"], kept["s"], kept["n"], kept["p"] = 0, s[at][order], n[at][order], p[at][order]
            if part[a]:
                hub, hub_size = heavy.hub[place[a]], heavy.size[place[a]]
                near = at[(s[at] != hub) & law.fits(n[at], hub_size, p[at], np.zeros(len(at), dtype=np.int64))]  # the hub's place isn't known
                pairs.append((np.full(len(near), hub), s[near], np.full(len(near), hub_size), n[near]))
                long_lists[int(t[a])] = kept
                continue
            hub = int(np.lexsort((s[at], weight[name_of[at]]))[-1])
            near = at[in_reach(law, n[at], p[at], hub)]
            pairs.append((np.full(len(near), s[a + hub]), s[near], np.full(len(near), n[a + hub]), n[near]))
            name = kept["s"].tobytes()
            if name in long_lists:  # the same members under another shingle: their earliest places allow all that either does
                np.minimum(long_lists[name]["p"], kept["p"], out=long_lists[name]["p"])
            else:
                long_lists[name] = kept
        out = [pair_rows(*(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (zip(*pairs) if pairs else ((),) * 4)))]
        if long_lists:
            k, none = len(long_lists), pa.nulls(len(long_lists), pa.int64())
            of_part = pa.array([int(np.uint64(x).view(np.int64)) if isinstance(x, int) else None for x in long_lists], pa.int64())
            out.append(batch(PAIR, np.ones(k, dtype=np.int32), of_part, none, none, none, [x.tobytes() for x in long_lists.values()]))
        return pa.Table.from_batches(out, schema=PAIR)

    return of


# verification

SET = pa.schema([("sig", pa.int64()), ("shingles", pa.binary())])
CHECKED = "a long, b long, shared long, linked boolean"
CHECKED_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("linked", pa.bool_())])


def setter(names: Names):
    """For mapInArrow over (text): each text's set, by its name."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs, blobs = [], []
            for s, sig, _ in names.of(batch_columns(b, "text")[0]):
                sigs.append(sig)
                blobs.append(s.tobytes())
            if sigs:
                yield batch(SET, sigs, blobs)

    return of


def checker(law: Bound):
    """For applyInArrow over rows (owner, other, shingles); owners come with a null other."""

    def of(table: pa.Table) -> pa.Table:
        owners, others, blobs = (table[c].to_pylist() for c in ("owner", "other", "shingles"))
        held = {o: np.frombuffer(x, dtype=np.uint64) for o, y, x in zip(owners, others, blobs, strict=True) if y is None}
        out = []
        for o, y, x in zip(owners, others, blobs, strict=True):
            if y is not None:
                a, b = held[o], np.frombuffer(x, dtype=np.uint64)
                small, big = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                shared = int((big[at] == small).sum())
                out.append((o, y, shared, shared >= law.overlap(len(a), len(b))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ((),) * 4, CHECKED_ARROW, strict=True)], schema=CHECKED_ARROW)

    return of


def screener(law: Bound):
    """For mapInArrow over pairs with both bitmaps: those that may still be similar."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb, xs, ys = batch_columns(b, "na", "nb", "bits_a", "bits_b")
            stay = []
            for n, m, x, y in zip(na.to_pylist(), nb.to_pylist(), xs.to_pylist(), ys.to_pylist(), strict=True):
                size = min(len(x), len(y))
                x, y = folded(np.frombuffer(x, dtype=np.uint8), size), folded(np.frombuffer(y, dtype=np.uint8), size)
                both = int(np.bitwise_count(x & y).sum())
                most = min(n - int(np.bitwise_count(x).sum()) + both, m - int(np.bitwise_count(y).sum()) + both)
                stay.append(most >= law.overlap(n, m))
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(stay, pa.bool_()))

    return of


CELL = pa.schema([("hub", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.int64()), ("label", pa.int64()), ("side", pa.int32())])
CELL_SQL = "hub long, c1 long, c2 long, sig long, label long, side int"


def meets(law: Bound, x: tuple, y: tuple) -> np.ndarray:
    """Of (bitmaps, sizes) against (bitmaps, sizes), all bitmaps of equal length: which may be similar."""
    (a, n), (b, m) = x, y
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    for i in range(0, a.shape[1], 512):
        both += np.unpackbits(a[:, i : i + 512], axis=1).astype(np.float32) @ np.unpackbits(b[:, i : i + 512], axis=1).astype(np.float32).T
    only_a, only_b = n - np.bitwise_count(a).sum(axis=1, dtype=np.int64), m - np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    both = np.rint(both).astype(np.int64)
    most = np.minimum(only_a[:, None] + both, only_b[None, :] + both)
    return most >= law.overlap(n[:, None], m[None, :])


def sifter(law: Bound):
    """For applyInArrow over two cells of a family with their bitmaps: the members that may be similar to one of another component."""

    def of(table: pa.Table) -> pa.Table:
        n, label, side = (table[c].to_numpy() for c in ("n", "label", "side"))
        bits = table["bits"].to_pylist()
        classes: dict[tuple[int, int], list[int]] = {}
        for i, x in enumerate(bits):
            classes.setdefault((int(side[i]), len(x)), []).append(i)
        stacked = {k: np.frombuffer(b"".join(bits[i] for i in rows), dtype=np.uint8).reshape(len(rows), -1) for k, rows in classes.items()}
        other, stay = int(side.max()), np.zeros(len(n), dtype=bool)
        for (s1, z1), one in classes.items():
            for (s2, z2), two in classes.items():
                # sizes that may be similar have bitmaps of equal length, or one twice the other's
                if s1 == 0 and s2 == other and max(z1, z2) <= 2 * min(z1, z2):
                    size = min(z1, z2)
                    ok = meets(law, (folded(stacked[s1, z1], size), n[one]), (folded(stacked[s2, z2], size), n[two]))
                    ok &= label[one][:, None] != label[two][None, :]
                    stay[np.array(one)[ok.any(axis=1)]] = True
                    stay[np.array(two)[ok.any(axis=0)]] = True
        return table.select(CELL.names).filter(pa.array(stay)).cast(CELL)

    return of


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def incidence(rows: list[np.ndarray], least: int) -> np.ndarray:
    """Rows by values: 1 where a row has the value; values that fewer than ``least`` rows have are left out."""
    every = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    values, place, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.cumsum(count >= least) - 1
    keep = count[place] >= least
    out = np.zeros((len(rows), int((count >= least).sum())), dtype=np.float32)
    out[np.repeat(np.arange(len(rows)), [len(r) for r in rows])[keep], column[place][keep]] = 1
    return out


def product(a: np.ndarray, b: np.ndarray, width: int = 2048) -> np.ndarray:
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    for i in range(0, a.shape[1], width):
        out += a[:, i : i + width] @ b[:, i : i + width].T
    return out


def relater(law: Bound):
    """For applyInArrow over two cells of a family (sig, side, label, shingles; the hub with side -1): links between components, enough to join those that links join.

    Side 0 meets side 1, or itself where there is no side 1.
    """

    def of(table: pa.Table) -> pa.Table:
        sigs, sides, labels, blobs = (table[c].to_pylist() for c in ("sig", "side", "label", "shingles"))
        hub = next(np.frombuffer(x, dtype=np.uint64) for x, side in zip(blobs, sides, strict=True) if side < 0)
        rows = [i for i, side in enumerate(sides) if side >= 0]
        sets = [np.frombuffer(blobs[i], dtype=np.uint64) for i in rows]
        one, two = ([k for k, i in enumerate(rows) if sides[i] == side] for side in (0, 1))
        two = two or one
        lacks, more = incidence([np.setdiff1d(hub, x, True) for x in sets], 1), incidence([np.setdiff1d(x, hub, True) for x in sets], 2)
        gone, n = lacks.sum(axis=1), np.array([len(x) for x in sets], dtype=np.int64)
        shared = len(hub) - gone[one][:, None] - gone[two][None, :] + product(lacks[one], lacks[two]) + product(more[one], more[two])
        linked = np.rint(shared).astype(np.int64) >= law.overlap(n[one][:, None], n[two][None, :])
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        names = np.array([labels[i] for i in rows], dtype=np.int64)
        found = []
        for i, j in zip(*np.nonzero(linked & (names[one][:, None] != names[two][None, :])), strict=True):
            x, y = one[i], two[j]
            a, b = top(labels[rows[x]]), top(labels[rows[y]])
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((sigs[rows[x]], sigs[rows[y]]))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], schema=LINK)

    return of


def shared_counts(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each of ``one`` shares with each of ``two``, by matrix products of ``width`` values at a time."""
    rows = [*one, *two]
    values, place, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    every = count == len(rows)  # what all have needs no product
    some = (count > 1) & ~every
    column, row = np.cumsum(some) - 1, np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    row, column = row[some[place]], column[place[some[place]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.full((len(one), len(two)), float(every.sum()))
    for i in range(0, int(some.sum()), width):
        a, b = np.searchsorted(column, (i, i + width))
        held = np.zeros((len(rows), width), dtype=np.float32)
        held[row[a:b], column[a:b] - i] = 1
        out += held[: len(one)] @ held[len(one) :].T
    return np.rint(out).astype(np.int64)


COUNTED = pa.schema([("sig", pa.int64()), ("links", pa.int64())])


def counter(law: Bound):
    """For applyInArrow over whole meetings (label, c1, c2) of two cells of a component, or of one with itself: per set the linked rows that the others stand for."""

    def of(table: pa.Table) -> pa.Table:
        label, c1, c2, side, sig, times = (table[c].to_numpy() for c in ("label", "c1", "c2", "side", "sig", "times"))
        blobs, sigs, links = table["shingles"].to_pylist(), [], []
        meetings: dict[tuple, tuple[list[int], list[int]]] = {}
        for i, k in enumerate(zip(label, c1, c2, strict=True)):
            meetings.setdefault(k, ([], []))[side[i]].append(i)
        for (_, x, y), (one, two) in meetings.items():
            alone = x == y
            two = one if alone else two
            if not one or not two:
                continue
            left, right = ([np.frombuffer(blobs[i], dtype=np.uint64) for i in rows] for rows in (one, two))
            n, m = (np.array([len(s) for s in sets], dtype=np.int64) for sets in (left, right))
            linked = shared_counts(left, right) >= law.overlap(n[:, None], m[None, :])
            if alone:
                np.fill_diagonal(linked, False)
            sigs.append(sig[one])
            links.append(linked @ times[two])
            if not alone:
                sigs.append(sig[two])
                links.append(times[one] @ linked)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (sigs, links)], schema=COUNTED)

    return of


def member_bits(keys: DataFrame, key: str, bits: int = 1 << 23) -> list[tuple[int, int]]:
    """(word, 64 bits) of a bitmap of hashed keys: at most bits / 64 rows, however many keys there are."""
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select(h.alias("h")).select(F.floor(F.col("h") / 64).alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("m"))
    return [tuple(r) for r in words.groupBy("w").agg(F.bit_or("m")).collect()]


def may_be_in(rows: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """rows without most of those whose key isn't among keys; the bitmap that is sent out has ``bits`` bits."""
    spark = rows.sparkSession
    held = spark.createDataFrame(member_bits(keys, key, bits), "_w long, _m long")
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = rows.withColumn("_h", h).withColumn("_w", F.floor(F.col("_h") / 64)).join(F.broadcast(held), "_w")
    return marked.where(F.expr("(_m & shiftleft(1L, cast(_h % 64 as int))) <> 0")).drop("_h", "_w", "_m")


class Join:
    """One run over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, part: int, whole: int, most_frequent: int, short: int, bucket_postings: int, name_bits: int = 64):
        self.law, self.width, self.short = Bound(part, whole), width, short
        self.most_frequent, self.bucket_postings, self.name_bits = most_frequent, bucket_postings, name_bits
        doc_id, text = F.col(id_col).cast("long"), whole_text(text_col)
        self.docs = docs.select(row_key(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))
        self.spark, self.scratch = docs.sparkSession, []

    def kept(self, df: DataFrame, name: str, files: int = 0) -> DataFrame:
        """Written down until the run ends."""
        self.scratch.append(written(df, name, files))
        return self.scratch[-1]

    def sizes(self) -> None:
        """Rows with sizes and names; sets, one row a name; and the frequent shingles."""
        for salt in range(1000):
            self.names = Names(self.width, salt, self.name_bits)
            self.signed = written(self.docs.mapInArrow(signer(self.names), SQL(SIGNED)), "signed")
            self.rows = self.signed.where("shingle is null")
            filled = self.rows.where("sig is not null")
            sets = filled.groupBy("sig").agg(
                F.min(first_row()).alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"), (F.min("digest") != F.max("digest")).alias("shared")
            )
            sets = written(sets, "sets")
            count, all_shingles, shared = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bool_or("shared"), F.lit(False))).first()
            if not shared:
                break
            removed(self.signed, sets)  # two sets have one name: all get others
        else:
            raise ValueError(f"{self.name_bits} bits can't name so many sets")
        self.scratch.append(sets)
        self.sets, self.bits = sets.drop("bits", "shared"), sets.select("sig", "n", "bits")
        #: Files for tables of a few numbers a set, and for tables of whole sets.
        self.narrow, self.wide = files_for(count, 256), files_for(all_shingles, 8)
        often = self.signed.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"), F.max(F.struct("sig", "doc_id")).alias("hub")).where("n >= 8")
        top = often.orderBy(F.desc("n"), "shingle").limit(self.most_frequent).collect()
        values = np.array([r["shingle"] for r in top], dtype=np.int64).view(np.uint64)
        order = np.argsort(values)
        self.frequent, self.ranks = values[order], (len(values) - np.arange(len(values)))[order]
        most = max(1, self.bucket_postings // 4)
        self.heavy = Heavy([(r["shingle"] % 2**64, -(-r["n"] // most), r["hub"]["sig"], r["hub"]["doc_id"]) for r in top if r["n"] > most])

    def index(self) -> None:
        """Pairs that may be similar, and the long lists."""
        postings = self.sets.agg(F.sum(F.col("n") - F.ceil(F.lit(self.law.part) * F.col("n") / self.law.whole) + 1)).first()[0] or 0
        buckets = max(32, math.ceil(postings / self.bucket_postings))
        posted = self.docs.select("text").mapInArrow(poster(self.names, self.law, self.frequent, self.ranks, self.heavy, buckets), SQL(POSTED))
        # a task's postings have the same bytes at every size of the input
        posted = posted.repartition(files_for(postings, POSTING.itemsize, 16 << 20, 12), "bucket")
        found = self.kept(posted.groupBy("bucket").applyInArrow(lister(self.law, self.short, self.heavy), PAIRS_SQL), "index")
        self.pairs = self.kept(found.where("kind = 0").select("a", "b", "na", "nb").distinct(), "pairs", self.narrow)
        self.lists = found.where("kind = 1").select("a", "members")

    def held(self, sigs: DataFrame, name: str) -> DataFrame:
        """(sig, shingles) of the signatures, one row each, made again from one text of each."""
        wanted = sigs.join(self.sets.select("sig", "key"), "sig").select("key")
        texts = may_be_in(self.docs.select("key", "text"), "key", wanted).join(wanted, "key", "left_semi").dropDuplicates(["key"])
        return self.kept(texts.select("text").mapInArrow(setter(self.names), SQL(SET)), name, self.wide)

    def verified(self, pairs: DataFrame, per_task: int = 256) -> DataFrame:
        """From pairs (a, b, na, nb) of signatures and sizes: those that bitmaps leave possible, with what they share and whether they are linked.

        The set with more partners owns a pair; an owner's partners are dealt to several groups if there are many.
        """
        bits_a, bits_b = self.bits.select(F.col("sig").alias("a"), F.col("bits").alias("bits_a")), self.bits.select(F.col("sig").alias("b"), F.col("bits").alias("bits_b"))
        pairs = pairs.join(bits_a, "a").join(bits_b, "b").mapInArrow(screener(self.law), "a long, b long, na long, nb long")
        pairs = self.kept(pairs, "screened", self.narrow)
        ends = pairs.select(F.col("a").alias("sig")).unionAll(pairs.select(F.col("b").alias("sig")))
        degree = self.kept(ends.groupBy("sig").agg(F.count(F.lit(1)).alias("d")), "degrees", self.narrow)
        held = self.held(degree.select("sig"), "pair-sets")
        da, db = degree.select(F.col("sig").alias("a"), F.col("d").alias("da")), degree.select(F.col("sig").alias("b"), F.col("d").alias("db"))
        led = pairs.join(da, "a").join(db, "b")
        a_owns = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        owned = led.select(
            F.when(a_owns, F.col("a")).otherwise(F.col("b")).alias("owner"), F.when(a_owns, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("da", "db").alias("d")
        )
        part = F.pmod(F.xxhash64("other"), F.ceil(F.col("d") / per_task))
        groups = F.lit(max(1, math.ceil(pairs.count() / per_task)))
        owned = self.kept(owned.withColumn("grp", F.pmod(F.xxhash64("owner", part), groups)).select("grp", "owner", "other"), "owned", self.narrow)
        others = owned.join(held.withColumnRenamed("sig", "other"), "other").select("grp", "owner", "other", "shingles")
        owners = owned.select("grp", "owner").distinct().join(held.withColumnRenamed("sig", "owner"), "owner")
        work = others.unionByName(owners.select("grp", "owner", F.lit(None).cast("long").alias("other"), "shingles"))
        return self.kept(work.groupBy("grp").applyInArrow(checker(self.law), CHECKED), "hub-answers", self.narrow)

    def across(self, checked: DataFrame, labels: DataFrame) -> DataFrame:
        """Links (a, b) that join components within the long lists that hold more than one."""
        # a part goes by the shingle of its list, a whole list by a number; ``part`` keeps the two apart
        of_part = F.col("a").isNotNull()
        lists = self.lists.select(
            F.coalesce("a", F.monotonically_increasing_id()).alias("list"), of_part.alias("part"), F.when(of_part, F.lit(1 << 40)).otherwise(F.length("members") / POSTING.itemsize).cast("long").alias("m"), "members"
        )
        members = self.kept(lists.mapInArrow(unpacker, UNPACKED), "members", self.narrow)
        weight = members.groupBy("sig").agg(F.count(F.lit(1)).alias("w"))
        members = members.join(weight, "sig").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        members = self.kept(members, "labelled-members", self.narrow)
        mixed = members.groupBy("list", "part").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max(F.struct("w", "sig", "label")).alias("hub")).where("x <> y")
        mixed = mixed.select("list", "part", F.col("hub.sig").alias("hub"), F.col("hub.label").alias("family"))
        members = members.join(mixed, ["list", "part"])
        groups = max(1, members.count() // 20_000)
        counted = members.where(F.col("m") <= COUNTED_UP_TO).groupBy(F.pmod("list", F.lit(groups)).alias("grp")).applyInArrow(crosser(self.law), PAIRS_SQL)
        counted = self.kept(counted, "crossed", self.narrow)
        known = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self.kept(counted.where("kind = 0").select("a", "b", "na", "nb").distinct().join(known, ["a", "b"], "left_anti"), "crossing-pairs", self.narrow)
        links = self.verified(pairs).where("linked").select("a", "b")
        family = counted.where("kind = 1").select(F.col("a").alias("sig"), F.col("na").alias("label"), F.col("nb").alias("family"), F.col("b").alias("hub"))
        family = family.unionByName(members.where(F.col("m") > COUNTED_UP_TO).select("sig", "label", "family", "hub"))
        # lists with hubs in one component are one family, under one of the hubs
        family = family.groupBy("family", "sig", "label").agg(F.min("hub").alias("hub"))
        one = family.groupBy("family").agg(F.min("hub").alias("hub"))
        return links.unionAll(self.families(self.kept(family.drop("hub").join(one, "family").select("hub", "sig", "label"), "families", self.narrow)))

    def families(self, family: DataFrame, cell: int = 1024) -> DataFrame:
        """From (hub, sig, label): links that join the components of each hub's family."""
        by_label = family.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("k"))
        mixed = by_label.groupBy("hub").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
        mixed = mixed.select("hub", F.col("top.label").alias("main"), F.ceil((F.col("m") - F.col("top.k")) / cell).alias("others"), F.ceil(F.col("top.k") / cell).alias("mains"))
        rows = family.join(mixed, "hub").withColumn("is_main", F.col("label") == F.col("main"))
        own = F.pmod(F.xxhash64("sig"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
        # a cell is 0.. for others, -1.. for the main component; two cells meet under (c1, c2), c1 being one of others
        rows = rows.withColumn("own", F.when(F.col("is_main"), -1 - own).otherwise(own))
        every_other, every_main = F.sequence(F.lit(0).cast("long"), F.col("others") - 1), F.sequence(F.lit(-1).cast("long"), -F.col("mains"), F.lit(-1).cast("long"))
        meets = F.when(F.col("is_main"), every_other).otherwise(F.concat(every_other, every_main))
        rows = rows.withColumn("with", F.explode(meets))
        swap = F.col("is_main") | ((F.col("with") >= 0) & (F.col("with") < F.col("own")))
        rows = rows.select("hub", "sig", "label", F.when(swap, F.col("with")).otherwise(F.col("own")).alias("c1"), F.when(swap, F.col("own")).otherwise(F.col("with")).alias("c2"), "own")
        rows = rows.withColumn("side", F.when(F.col("own") == F.col("c1"), 0).otherwise(1)).drop("own")
        sifted = rows.join(self.bits, "sig").groupBy("hub", "c1", "c2").applyInArrow(sifter(self.law), CELL_SQL)
        rows = self.kept(sifted, "sifted", self.narrow)
        centers = rows.select("hub", "c1", "c2").distinct().select("hub", F.col("hub").alias("sig"), F.lit(0).cast("long").alias("label"), "c1", "c2", F.lit(-1).alias("side"))
        rows = rows.unionByName(centers)
        held = self.held(rows.select("sig").distinct(), "family-sets")
        return self.kept(rows.join(held, "sig").groupBy("hub", "c1", "c2").applyInArrow(relater(self.law), "a long, b long").distinct(), "family-links", self.narrow)

    def link_counts(self, named: DataFrame, cell: int, per_task: int = 1024) -> DataFrame:
        """From (sig, label): per set (sig, times, links), how many rows have it and how many rows with other sets are linked to these.

        Links are within components, and two sets of one meet in just one pair of its cells, so every link is found and counts once.
        """
        times = self.kept(self.rows.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("times")), "times", self.narrow)
        several = named.groupBy("label").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("label", F.ceil(F.col("k") / cell).alias("cells"))
        rows = named.select("sig", "label").join(several, "label").join(times, "sig").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("cells")))
        rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
        rows = rows.select("label", "sig", "times", F.least("own", "with").alias("c1"), F.greatest("own", "with").alias("c2"), (F.col("own") > F.col("with")).cast("int").alias("side"))
        rows = self.kept(rows, "meetings", self.narrow)
        groups = max(1, math.ceil(rows.count() / per_task))
        held = self.held(rows.select("sig").distinct(), "component-sets")
        rows = rows.join(held, "sig").withColumn("grp", F.pmod(F.xxhash64("label", "c1", "c2"), F.lit(groups)))
        found = self.kept(rows.groupBy("grp").applyInArrow(counter(self.law), SQL(COUNTED)), "link-counts", self.narrow)
        return times.join(found.groupBy("sig").agg(F.sum("links").alias("links")), "sig", "left")

    def labelled(self, links: DataFrame) -> DataFrame:
        self.scratch.append(components(links, "a", "b", self.narrow))
        return self.scratch[-1]

    def run(self, links_too: bool = False, cell: int = 1024) -> DataFrame:
        self.sizes()
        self.index()
        checked = self.verified(self.pairs)
        links = checked.where("linked").select("a", "b")
        labels = self.labelled(links)
        more = self.across(checked, labels)
        if not more.isEmpty():
            labels = self.labelled(links.unionAll(more))
        named = self.sets.select("sig", "least").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        named = self.kept(named, "named", self.narrow)
        ids = named.groupBy("label").agg(F.min("least").alias("first"))
        per_set = named.join(ids, "label").select("sig", "first")
        first = F.coalesce("first", first_row())
        columns = ["doc_id", F.col("n").alias("n_shingles"), first["doc_id"].alias("component_id"), "key", first["key"].alias("first_key")]
        if links_too:
            per_set = per_set.join(self.link_counts(named.select("sig", "label"), cell), "sig", "left")
        rows = self.rows.join(written(per_set, "set-components", self.narrow), "sig", "left")
        removed(*self.scratch)
        if links_too:
            columns.append((F.coalesce("links", F.lit(0)) + F.coalesce(F.col("times") - 1, F.lit(0))).cast("long").alias("n_links"))
        return rows.select(*columns)


def first_row():
    """For the order of rows: by id, those without one last, then by key."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))


UNPACKED = "list long, part boolean, m long, sig long, n long, p long"
#: Lists with more members than this go to families without their possible pairs being counted.
COUNTED_UP_TO = 4096


def unpacker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, part, m, blob in zip(*batch_columns(b, "list", "part", "m", "members"), strict=True):
            x = np.frombuffer(blob.as_py(), dtype=POSTING)
            columns = [np.full(len(x), name.as_py()), np.full(len(x), part.as_py()), np.full(len(x), m.as_py()), x["s"], x["n"].astype(np.int64), x["p"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "part", "m", "sig", "n", "p"])


def crosser(law: Bound, few: float = 0.5):
    """For applyInArrow over whole lists: the pairs across components that sizes and positions leave possible, as kind 0; or, where there are more than
    ``few`` for each member that has one, as kind 1 these members, the list's hub, the members' labels, and the hub's."""

    def of(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("list", "n", "p", "sig", "label", "hub", "family")]
        order = np.lexsort(columns[3::-1])
        lists, size, place, sig, label, hub, family = (c[order] for c in columns)
        first = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        a, b, members = [], [], []
        for start, end in zip(first, np.r_[first[1:], len(lists)], strict=True):
            n, p, names, left, right = size[start:end], place[start:end], label[start:end], [], []
            for i in range(end - start):
                j = in_reach(law, n, p, i)
                j = j[(j > i) & (names[j] != names[i])]
                left.append(np.full(len(j), start + i))
                right.append(start + j)
            left, right = np.concatenate(left), np.concatenate(right)
            active = np.union1d(left, right)
            if len(left) > few * len(active):
                members.append(active)
            else:
                a.append(left)
                b.append(right)
        i, j = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
        out = [pair_rows(sig[i], sig[j], size[i], size[j])]
        if members:
            at = np.concatenate(members)
            out.append(batch(PAIR, np.ones(len(at), dtype=np.int32), sig[at], hub[at], label[at], family[at], pa.nulls(len(at), pa.binary())))
        return pa.Table.from_batches(out, schema=PAIR)

    return of


def SQL(schema: pa.Schema) -> str:  # noqa: N802
    """An Arrow schema as Spark writes it."""
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, part: int = 75, whole: int = 100, most_frequent: int = 65_536, short: int = 3, bucket_postings: int = 62_500, links: bool = False, cell: int = 1024, name_bits: int = 64
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest id that links lead to), key and first_key (hashes of the row's and of the component's first id and text).

    With ``links`` also n_links: how many other rows are linked to the row, rows with equal sets among them. All sets of a component are compared, in cells of about ``cell``.
    """
    return Join(docs, id_col, text_col, width, part, whole, most_frequent, short, bucket_postings, name_bits).run(links, cell)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component; of rows with equal ids and texts one."""
    key = free_name(docs, "_key")
    found = join(docs, id_col, text_col, **how)
    stays = found.where("key = first_key").select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col(id_col).cast("long"), whole_text(text_col)))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)
