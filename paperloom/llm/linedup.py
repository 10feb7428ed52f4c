"""Repeated line runs across documents, by prefix doubling over line ids.

A document is a sequence of line ids (64-bit keys of trimmed lines).  Prefix doubling names the suffixes at depths 1, 2, 4, ...:
two have the same name at depth 2^(j+1) if their names at depth 2^j agree here and 2^j lines further on.  Suffixes that are alone
with their name drop out, so rounds shrink fast.  A run of any length has its name from two overlapping depths, as in a sparse
table; the places of one name are a longest-common-prefix interval of the suffix array over line ids.

A run is a repeat when it has at least ``min_words`` words and begins at an earlier place too.  Every maximal repeated run is the
union of its shortest repeats that begin, or end, at each of its lines; these are what is looked up.  Later copies are deleted.

Counts and first places come from partial aggregates and are joined back; those of hot names, which hold more than a fixed share
of all rows, are broadcast to where the rows lie, so a line that a third of all documents share never meets in one task.  Places are ordered by document id (null first), text key and line number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import discard, joined_by, lean, only, stored, swept, tune

MIN_WORDS = 50


def _line_rows(min_words: int):
    """(doc, h, text) -> (doc, h, at, name, ahead, back): key of each line, and the lengths of the shortest runs of
    ``min_words`` words that begin, or end, there (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textvec.raw(batch.column("text"))
            starts, _, keys, counts = textvec.words(body, offsets, lower=False)
            owner = np.repeat(np.arange(len(counts)), counts)
            breaks = np.flatnonzero(body == 10)
            before = np.searchsorted(breaks, offsets)
            n_lines = np.diff(before) + 1
            base = np.concatenate([[0], np.cumsum(n_lines)])
            line = base[owner] + np.searchsorted(breaks, starts) - before[owner]
            n = np.bincount(line, minlength=base[-1])
            first = np.concatenate([[0], np.cumsum(n)])
            with np.errstate(over="ignore"):
                place = (np.arange(len(line)) - first[line] + 1).astype(np.uint64)
                mixed = textvec.mix(keys + place * np.uint64(0x9E3779B97F4A7C15))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
                name = textvec.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
            doc = np.repeat(np.arange(len(counts)), n_lines)
            row = np.arange(base[-1])
            ahead = np.searchsorted(first, first[:-1] + max(1, min_words), side="left") - row
            ahead[row + ahead > base[doc + 1]] = 0
            back = row + 1 - (np.searchsorted(first, first[1:] - max(1, min_words), side="right") - 1)
            back[(row + 1 - back < base[doc]) | (first[1:] < min_words)] = 0
            take = pa.array(doc)
            for a in range(0, len(doc), 100_000):
                cut = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(take[cut]), batch.column("h").take(take[cut]), *(pa.array(x[cut].astype(np.int64)) for x in (row - base[doc], name, ahead, back))],
                    ["doc", "h", "at", "name", "ahead", "back"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, runs) -> the text without the lines of ``runs``."""
    for batch in batches:
        texts, lines, removed = [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            parts = (text or "").split("\n")
            if runs:
                gone = np.zeros(len(parts) + 1, dtype=np.int64)
                for r in runs:
                    gone[r["at"]] += 1
                    gone[r["at"] + r["n"]] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                text = "\n".join(p for p, g in zip(parts, gone, strict=True) if not g)
                removed.append(int(gone.sum()))
            else:
                removed.append(0)
            texts.append(text)
            lines.append(0 if text is None else len(parts))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], ["row", "text", "n_lines", "n_removed"])


def _shared(t: DataFrame, *names: str) -> DataFrame:
    """The rows whose names occur more than once, with the first place of the name; stored."""
    t = stored(t)
    g = stored(t.groupBy(*names).agg(F.count("*").alias("c"), F.min(F.struct("doc", "h", "at")).alias("first")).where("c > 1"))
    out = stored(joined_by(t, g, list(names), "c").drop("c"))
    discard(t, g)
    swept(t.sparkSession)
    return out


def _meets(p: DataFrame, q: DataFrame, by) -> DataFrame:
    """Rows of ``p`` with the name that ``q`` has ``by`` lines further on, as ``then``."""
    q = q.select(F.col("doc").alias("qd"), F.col("h").alias("qh"), F.col("at").alias("qa"), F.col("name").alias("then"))
    return p.join(q, p["doc"].eqNullSafe(q["qd"]) & (p["h"] == q["qh"]) & (p["at"] + by == q["qa"])).drop("qd", "qh", "qa")


def repeated_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, h, runs array<struct<at, n>>): runs of lines that begin at an earlier place too.  ``docs``: doc, h, text."""
    kind = docs.schema["doc"].dataType.simpleString()
    lines = docs.mapInArrow(lean(_line_rows(min_words)), f"doc {kind}, h long, at long, name long, ahead long, back long")
    lines = lines.dropDuplicates(["doc", "h", "at"])  # a repeated row is the same document
    now = _shared(lines, "name").drop("first")
    windows = now.where("ahead > 0").select("doc", "h", "at", F.col("ahead").alias("n")).union(now.where("back > 0").select("doc", "h", (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("n"))).distinct()
    windows = stored(windows)
    most = windows.agg(F.max("n")).first()[0] or 0
    found, depth = None, 1
    now = now.select("doc", "h", "at", "name")
    while depth <= most:
        own = windows.where(F.col("n").between(depth, 2 * depth - 1))
        own = _meets(_meets(own, now, F.lit(0)).withColumnRenamed("then", "name"), now, F.col("n") - depth)
        again = _shared(own, "n", "name", "then").where(F.struct("doc", "h", "at") > F.col("first")).select("doc", "h", "at", "n")
        found = again if found is None else found.union(again)
        depth *= 2
        if depth > most:
            break
        longer = _meets(now, now, F.lit(depth // 2)).select("doc", "h", "at", F.xxhash64("name", "then").alias("name"))
        now = _shared(longer, "name").drop("first")
        if now.isEmpty():
            break
    if found is None:
        found = windows.where("false")
    return found.groupBy("doc", "h").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``df`` with ``text`` cleaned, and ``n_lines``, ``n_removed`` (replaced if they were there).

    A run of lines of at least ``min_words`` words is deleted where it also begins at an earlier place; its first copy stays.
    Lines compare by their words in order, so white space around and between words does not count, but case does.  Text whose lines all
    go is empty.  Null stays null, with no lines.  Repeated rows (same id and text) are one document and are treated alike;
    other texts under the same id are documents of their own.  A null id comes before all others.  An empty table gives no rows.
    """
    tune(df.sparkSession)
    docs = only(df, **{doc_id: "doc", text: "text"}).select("doc", F.xxhash64("text").alias("h"), "text")
    runs = stored(repeated_runs(docs.where("text is not null"), min_words)).select(F.col("doc").alias("rd"), F.col("h").alias("rh"), "runs")
    runs = runs.hint("shuffle_hash")  # at every size: neither a broadcast that grows with the data nor a sort of the texts
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text))
    keyed = df.select(row.alias("row"), F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{text}`").cast("string").alias("text"))
    joined = keyed.join(runs, keyed["doc"].eqNullSafe(runs["rd"]) & (keyed["h"] == runs["rh"]), "left").select("row", "text", "runs")
    out = joined.mapInArrow(lean(_cut), f"row {keyed.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long")
    return out.select(*(F.col("text").alias(text) if c == text else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)), "n_lines", "n_removed")
