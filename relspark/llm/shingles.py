"""Sets of hashed word shingles, vectorised over whole Arrow buffers.

A word is a maximal run of bytes other than blanks; A-Z count as a-z. A word's hash mixes it eight bytes at a time, each step a one-to-one
function of 64 bits; a word of over ``LONG`` bytes is hashed by BLAKE2b. A shingle's hash mixes those of its words. Two different shingles share a
hash with a chance of about 2**-64; it counts only where both are in the two sets of a pair, so a pair of a thousand shingles each
is off by one with a chance of about 2**-44, and then only its being at the very threshold matters.
A set is known by a 192-bit digest of all its hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at a time; a longer word makes a longer piece.
PIECE = 1 << 20
LONG = 256
_rng = np.random.Generator(np.random.PCG64(20240229))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEYS = _rng.integers(1, 2**63, 4, dtype=np.uint64) * U(2) + U(1)
_PLACES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and the hash of every word; no word goes on across a break."""
    solid = ~_BLANK[data]
    fresh = np.ones(len(data), dtype=bool)
    fresh[1:] = ~solid[:-1]
    fresh[breaks[breaks < len(data)]] = True
    starts = np.flatnonzero(solid & fresh)
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = ~solid[1:] | fresh[1:]
    sizes = np.flatnonzero(solid & stop) + 1 - starts
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    out = mix(mix(eight[starts] & _FIRST[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _KEYS[0])
    at = 8
    more = np.flatnonzero((sizes > at) & (sizes <= LONG))
    while len(more):
        part = eight[starts[more] + at] & _FIRST[np.minimum(sizes[more] - at, 8)]
        out[more] = mix(out[more] * _KEYS[1] + mix(part ^ _KEYS[2]))
        at += 8
        more = more[sizes[more] > at]
    for i in np.flatnonzero(sizes > LONG):
        word = padded[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return starts, out


def pieces(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows i to j whose texts are hashed together."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def hashes_of_long(data: np.ndarray) -> np.ndarray:
    """The word hashes of one long text, piece by piece."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            blank = np.flatnonzero(_BLANK[data[at:end]])
            end = at + int(blank[-1]) + 1 if len(blank) else end + next((k for k in range(len(data) - end) if _BLANK[data[end + k]]), len(data) - end)
        out.append(word_hashes(data[at:end], np.zeros(0, dtype=np.int64))[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def shingled(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, or of all of them if there are fewer."""
    k = min(width, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, U(k), dtype=np.uint64)
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * _PLACES[j]
    return mix(out)


def sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes. The column is of large or plain strings without nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    for i, j in pieces(offsets, data):
        first, last = offsets[i], offsets[j]
        if last - first > PIECE:
            yield np.unique(shingled(hashes_of_long(data[first:last]), width))
            continue
        starts, words = word_hashes(data[first:last], offsets[i:j] - first)
        at = np.searchsorted(starts, offsets[i : j + 1] - first)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(shingled(words[a:b], width))


def signature(s: np.ndarray, salt: int = 0, bits: int = 64) -> tuple[int, bytes]:
    """A set's name, a signed number of ``bits`` bits, and its digest, of which the name is a part."""
    digest = hashlib.blake2b(s.tobytes(), digest_size=24, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True) >> (64 - bits), digest
