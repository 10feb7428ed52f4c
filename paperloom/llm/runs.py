"""Periodic runs of words: stretches that repeat their first words again and again.

For every period q the words of a text are probed at a grid of places, 3q apart: a run of four periods has a word and its
equal q further on at one grid point at least, and all periods' grids together have O(n log n) points.  Where the words agree,
how far they go on agreeing, forwards and backwards, is found by binary search on prefix hashes, for all points at once.  What
is found is verified word by word and deduplicated; the smallest period of a stretch counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean, tune

#: A run has so many words at least, and so many periods.
WORDS, PERIODS = 6, 4
#: Grids of texts of up to so many words are kept; beyond, they are made in blocks of about so many points.
KEPT, BLOCK = 1 << 15, 1 << 18
_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = ((1_390_208_809, 914_210_233), (1_733_114_251, 620_031_587), (1_150_833_019, 1_904_389_811))


@lru_cache(maxsize=64)
def _powers(base: int, prime: int, size: int) -> np.ndarray:
    out = np.ones(1, dtype=np.int64)
    while len(out) < size:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


def _points(low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points beyond the first word, and their periods, for periods from ``low`` to ``high`` in a text of n words."""
    q = np.arange(low, high, dtype=np.int64)
    many = np.maximum(0, (n - 1 - q) // (3 * q))  # place 3qk and its equal at 3qk + q < n
    period = np.repeat(q, many)
    k = np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many) + 1
    return 3 * period * k, period


@lru_cache(maxsize=20)
def _kept_grid(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, period = _points(1, size // PERIODS + 1, size)
    order = np.argsort(at + period, kind="stable")
    return at[order], period[order], (at + period)[order]


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (place, period) pairs of a text of n words, in blocks: place 0 for each period, then places 3q, 6q, ..."""
    top = n // PERIODS
    yield np.zeros(top, dtype=np.int64), np.arange(1, top + 1)
    if n <= KEPT:
        at, period, last = _kept_grid(1 << max(3, (n - 1).bit_length()))
        end = int(np.searchsorted(last, n))
        yield at[:end], period[:end]
        return
    low = 1
    while low <= top:
        high, points = low + 1, n // (3 * low)
        while high <= top and points < BLOCK:
            points += n // (3 * high)
            high += 1
        yield _points(low, high, n)
        low = high


class Hashes:
    """Prefix sums of word id x base^place, modulo two primes."""

    def __init__(self, ids: np.ndarray, bases: tuple[int, int]):
        self.parts = []
        for base, prime in zip(bases, _PRIMES, strict=True):
            powers = _powers(base, prime, 1 << max(4, len(ids).bit_length()))
            sums = np.concatenate([[0], np.cumsum((ids + 1) % prime * powers[: len(ids)] % prime) % prime])
            self.parts.append((prime, powers, sums))

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i on have the hash of those from i + q on."""
        out = np.ones(len(i), dtype=bool)
        for prime, powers, s in self.parts:
            out &= ((s[i + size] - s[i]) * powers[q] - (s[i + q + size] - s[i + q])) % prime == 0
        return out


def _longest(same, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row the largest size up to ``high`` for which ``same`` holds; it holds for ``low``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        good = same(open_, mid)
        low[open_[good]] = mid[good]
        high[open_[~good]] = mid[~good] - 1


def _merged(found: np.ndarray) -> np.ndarray:
    """One row for each stretch (start, stop, period), with its smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def _candidates(ids: np.ndarray, bases: tuple[int, int]) -> np.ndarray:
    n, hashes, found = len(ids), None, np.empty((0, 3), dtype=np.int64)
    for at, period in _grid(n):
        hit = np.flatnonzero(ids[at] == ids[at + period])
        if not len(hit):
            continue
        hashes = hashes or Hashes(ids, bases)
        i, q = at[hit], period[hit]
        ahead = _longest(lambda r, size: hashes.same(i[r], q[r], size), np.ones(len(i), np.int64), n - i - q)  # noqa: B023
        back = _longest(lambda r, size: hashes.same(i[r] - size, q[r], size), np.zeros(len(i), np.int64), i)  # noqa: B023
        long = back + ahead + q >= np.maximum(WORDS, PERIODS * q)
        found = _merged(np.concatenate([found, np.column_stack([i - back, i + q + ahead, q])[long]]))
    return found


def _verified(ids: np.ndarray, found: np.ndarray) -> bool:
    """Whether words a period apart are equal within each stretch and differ just outside it."""
    n = len(ids)
    for a, b, q in found.tolist():
        if (a and ids[a - 1] == ids[a - 1 + q]) or (b < n and ids[b] == ids[b - q]) or not np.array_equal(ids[a : b - q], ids[a + q : b]):
            return False
    return True


def find_runs(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs in a sequence of word ids, by start, then period."""
    if len(ids) < WORDS:
        return np.empty((0, 3), dtype=np.int64)
    turn = 0
    while True:
        fixed = turn < len(_BASES)
        found = _candidates(ids, _BASES[turn] if fixed else tuple(b + 2 * turn for b in _BASES[0]))
        if _verified(ids, found):
            break
        turn += 1  # a hash collided: other bases
    found = np.column_stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]])
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def planted(n: int, h: int) -> np.ndarray | None:
    """For a tenth of the hashes, which word takes each of n places so that the text ends in a repeated stretch; else None."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _collapsed(text: bytes, h: int | None) -> tuple[int, np.ndarray, bytes]:
    words = text.split()  # by \x20 and \x09 to \x0D
    at = None if h is None else planted(len(words), h)
    if at is not None:
        words = [words[i] for i in at.tolist()]
    found = find_runs(word_ids(words))
    n = len(words)
    if len(found):
        edges = np.bincount(found[:, 0] + found[:, 2], minlength=n + 1) - np.bincount(found[:, 0] + found[:, 1], minlength=n + 1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:n]) == 0).tolist()]
    return n, found, b" ".join(words)


def collapse(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", plant: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: all runs by start, then period, and the text with each run's first period only.

    A word that a run holds after its first period is dropped, whatever other runs hold it.  Null texts have no words.  Rows are
    looked at by their own whole text: repeated rows come out alike, ids may be null, an empty table gives no rows, further
    columns are not read.  ``plant``, an unsigned hash, repeats a stretch of every tenth text beforehand (see ``planted``); rows
    for which it is null keep their words.
    """
    tune(df.sparkSession)
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.lit(None) if plant is None else plant).cast("long").alias("h"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names, field = ["start", "length", "period"], pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textvec.raw(batch.column("text"))
            made = [_collapsed(body[a:b].tobytes(), h) for a, b, h in zip(offsets[:-1], offsets[1:], batch.column("h").to_pylist(), strict=True)]
            every = np.concatenate([np.empty((0, 3), np.int64), *(r for _, r, _ in made)])
            ends = np.cumsum([0, *(len(r) for _, r, _ in made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(every[:, k]), field) for k in range(3)], names))
            columns = [batch.column("doc_id"), pa.array([n for n, _, _ in made], pa.int64()), lists, pa.array([t for _, _, t in made], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row a text of what ``collapse`` gives: how many runs, the longest one (ties: smallest start, then period), and hashes."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = found.withColumn("best", best)
    length = -F.col("best.less")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
