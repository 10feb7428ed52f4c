"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, which are put in another order.

Cuts are numbers of code points, texts are bytes.  While the code points of a text are counted, the count is recorded at every
STEP-th byte; a cut is found by binary search in these checkpoints and a rescan of less than STEP bytes, so nothing of the
size of a text is kept besides the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean, only, tune

#: Bytes between two checkpoints.
STEP = 256
#: Marks of prefix, suffix and middle; percent of texts that are left plain, and of the others those with the suffix first.
MARKS = ("<P>", "<S>", "<M>")
PLAIN, SUFFIX_FIRST = 10, 20


class Checkpoints:
    """Code points of a UTF-8 text, counted, with a checkpoint at every ``step`` bytes."""

    def __init__(self, body: np.ndarray, step: int = STEP):
        self.lead = body.view(np.int8) > -65  # every byte but those that continue a code point
        self.step = step
        each = np.add.reduceat(self.lead, np.arange(0, len(body), step), dtype=np.int64) if len(body) else np.empty(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(each)])  # code points before byte 0, step, 2 * step ...; all of them at last
        self.n = int(self.before[-1])

    def byte_of(self, point: int) -> int:
        """Byte at which code point number ``point`` begins; the length of the text for its number of code points."""
        if point >= self.n:
            return len(self.lead)
        k = int(np.searchsorted(self.before, point, side="right")) - 1
        at = k * self.step
        return at + int(np.flatnonzero(self.lead[at : at + self.step])[point - self.before[k]])


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must not overlap one another or themselves: then no mark can arise where a text and a mark meet."""
    for a in marks:
        for b in marks:
            if not a or (a is not b and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")


def arranged(body: np.ndarray, digest: str | None, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, those of prefix and middle, and the arranged text; ``digest`` are hex digits that decide."""
    index, text = Checkpoints(body), body.tobytes()
    p, s, m = (x.encode() for x in marks)
    if not text or digest is None or p in text or s in text or m in text:
        return index.n, "plain", None, None, text
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if h3 % 100 >= 100 - PLAIN:
        return index.n, "plain", None, None, text
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.byte_of(low), index.byte_of(high)
    if h4 % 100 < SUFFIX_FIRST:
        return index.n, "spm", low, high - low, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    return index.n, "psm", low, high - low, b"".join((p, text[:a], s, text[b:], m, text[a:b]))


def transform(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = "1", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row; the id's hash decides form and cuts.

    Null texts count as empty; empty texts, texts that hold a mark, and rows without an id stay plain.  Repeated rows come out
    alike; an empty table gives no rows; further columns are not read.  A row is arranged by its own text alone, of any length.
    """
    _checked(marks)
    tune(df.sparkSession)
    rows = only(df, **{doc_id: "doc_id", text: "text"}).select("doc_id", "text", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256).alias("digest"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textvec.raw(batch.column("text"))
            made = [arranged(body[a:b], d, marks) for a, b, d in zip(offsets[:-1], offsets[1:], batch.column("digest").to_pylist(), strict=True)]
            n, form, before, middle, out = zip(*made, strict=True) if made else ((),) * 5
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(lean(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``transform`` made ``output`` of: its parts between the marks, in their old order."""
    _checked(marks)
    part = F.split(F.col(output), "|".join(re.escape(x) for x in marks), -1)
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
        .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
    )
