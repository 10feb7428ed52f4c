"""Words of many texts at once, as 64-bit keys, by array operations over their bytes.

A word's key is a polynomial hash of its bytes: prefix sums of byte value x base^position give every word by one
subtraction, and the inverse power of its start makes it independent of the place.  A finishing mix spreads the bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _BASE, dtype=np.uint64), np.full(n + 1, pow(_BASE, -1, 2**64), dtype=np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return up, down, values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """True for bytes within the inclusive spans."""
    out = np.zeros(256, dtype=bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


WHITE = byte_class((0x20, 0x20), (0x09, 0x0D))
NEWLINE = byte_class((0x0A, 0x0A))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    return body, offsets - offsets[0]


def words(body: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and keys of all words, and how many each text has."""
    if lower:
        body = _LOWER[body]
    n = len(body)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    inside = ~separators[body]
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, stops, span_keys(body, starts, stops), np.diff(np.searchsorted(starts, offsets))


def span_keys(body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Keys of spans of bytes; starts and stops must both rise."""
    keys = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + SEGMENT, side="right")))
        lo, hi = starts[a], stops[b - 1]
        up, down, values = _powers(SEGMENT if hi - lo <= SEGMENT else int(hi - lo))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[body[lo:hi]] * up[: hi - lo], dtype=np.uint64)])
            keys[a:b] = mix((sums[stops[a:b] - lo] - sums[starts[a:b] - lo]) * down[starts[a:b] - lo])
        a = b
    return keys


def shingle_sets(texts: pa.Array, k: int, separators: np.ndarray = WHITE):
    """For each text the sorted distinct keys of its ``k``-word shingles; a text of fewer words has all of them as one."""
    _, _, keys, counts = words(*raw(texts), separators)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, k + 1, dtype=np.uint64))
        grams = np.zeros(max(0, len(keys) - k + 1), dtype=np.uint64)
        for j in range(k):
            grams += keys[j : len(keys) - k + 1 + j] * (factors[j] | np.uint64(1)) if len(grams) else grams
        grams = mix(grams)
        for end, n in zip(ends, counts, strict=True):
            if n >= k:
                yield np.unique(grams[end - n : end - k + 1])
            elif n:
                short = np.sum(keys[end - n : end] * (factors[:n] | np.uint64(1)), dtype=np.uint64)
                yield mix(np.array([short + np.uint64(n)], dtype=np.uint64))
            else:
                yield grams[:0]
