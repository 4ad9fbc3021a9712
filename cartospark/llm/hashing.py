"""Vectorised hashes of words and five-word shingles over Arrow text columns.

All texts of a batch are hashed at once on their UTF-8 bytes: one pass finds
word borders, prefix sums of a polynomial give every word's 64-bit hash, and a
shingle's hash mixes those of its words. Nothing runs per word in Python.
Texts are taken in slices of about ``SLICE`` bytes, which bounds the memory of
the working arrays; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 21
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters, digits and non-ASCII characters alone.
_PUNCT = np.ones(256, dtype=bool)
_PUNCT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE_LOWER = _CODE.copy()
_CODE_LOWER[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    kind = "inverse" if inverse else "forward"
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE), _INV if inverse else _P, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * SLICE:
            _powers[kind] = have
    return have[:n]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, its bytes, start of each text and the end) for slices of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, letters: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, number of the words before each text and in all, start, end of each word); letters: punctuation parts words too."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), none, none
    inside = ~(_PUNCT if letters else _SEP)[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * powers(n), out=total[1:])
    h = (total[end] - total[start]) * powers(n, inverse=True)[start]
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, offsets), start, end


def prefixes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length n: (which words are longer than n bytes, hash of their first n bytes, lower-cased)."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE_LOWER[data] * powers(len(data)), out=total[1:])
    inverse, out = powers(len(data), inverse=True), []
    for n in lengths:
        which = np.flatnonzero(end - start > n)
        at = start[which]
        out.append((which, mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n * 0x2545F491))))
    return out


def sequence_key(w: np.ndarray) -> int:
    """One 64-bit hash of a sequence of word hashes."""
    return int(mix((w * powers(len(w))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0])


def shingles(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of a text, repeats included; fewer words than k make one shingle, none make none."""
    if len(w) == 0:
        return w
    if len(w) < k:
        return np.array([sequence_key(w)], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)
    out = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _P + w[i : len(w) - k + 1 + i]
    return mix(out)
