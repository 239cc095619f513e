"""Distinct word shingles of whole texts as 64-bit hashes, by array operations over UTF-8 bytes.

Lower-cases A-Z; words are runs without \\x20 and \\x09-\\x0D; a shingle is ``width`` words.
A text of fewer words is one shingle of all its words; a text without words has none.
Work is done in segments of a few MB cut between words, so memory follows the number of words
of the longest text, not the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 21

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x5851F42D4C957F2D
_PLACE = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)

_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of a running hash, and their inverses, ``n`` at least."""
    global _power, _inverse
    if len(_power) < n:
        size = 1 << (n - 1).bit_length()
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _power, _inverse = np.cumprod(up), np.cumprod(down)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of adjoining segments of a buffer, and the words of each segment."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    space = _SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    some = ends > starts
    before[starts[some]] = True
    after[ends[some] - 1] = True
    first, last = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[:n], out=total[1:])
    h = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return h, np.searchsorted(first, ends) - np.searchsorted(first, starts)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for each row; null is the empty text."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT, "right")) - 1)
        if offsets[to] - offsets[at] <= 2 * SEGMENT:
            lo = offsets[at]
            h, count = _words(data[lo : offsets[to]], offsets[at:to] - lo, offsets[at + 1 : to + 1] - lo)
            end = np.cumsum(count)
            for k in range(at, to):
                yield k, h[:0] if null[k] else h[end[k - at] - count[k - at] : end[k - at]]
        else:
            parts, lo, hi = [], int(offsets[at]), int(offsets[to])
            while lo < hi:
                cut = min(lo + SEGMENT, hi)
                while cut < hi and not _SPACE[data[cut]]:
                    cut += 1
                parts.append(_words(data[lo:cut], np.array([0]), np.array([cut - lo]))[0])
                lo = cut
            yield at, np.concatenate(parts)
        at = to


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, w in word_hashes(texts):
        n = len(w)
        if n >= width:
            s = w[: n - width + 1] * _PLACE[0]
            for k in range(1, width):
                s = s + w[k : n - width + 1 + k] * _PLACE[k]
            yield np.unique(mix(s))
        elif n:
            yield mix((w * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[32 + n])
        else:
            yield w
