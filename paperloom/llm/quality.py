"""Document quality by a generalised additive model with pairwise interactions.

Features are counted for many texts at once.  Training goes round the features, each round adding a shallow tree on one
feature's bins to that feature's lookup table, then the same for the pairs of features whose bins explain most of what is
left.  Scoring is nothing but additions: one table entry for each feature's bin and one for each pair's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import lean, only, tune

#: Labelled rows that the model is fitted on.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 24, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 40, 0.15

FEATURES = (
    "log_words", "word_length", "long_words", "distinct_share", "top_word_share", "repeated_next", "symbol_share", "upper_share", "upper_words", "digit_share",
    "pipe_share", "shout_share", "stop_share", "log_lines", "line_words", "ends_with_stop", "words_with_symbols", "one_letter_words",
)


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null and empty texts have zeros."""
    body, offsets = textvec.raw(texts)
    starts, stops, keys, counts = textvec.words(body, offsets)
    n, chars = np.maximum(counts, 1), np.maximum(np.diff(offsets), 1)
    ends = np.cumsum(counts)
    edges = np.concatenate([[0], ends])
    by_words = lambda x: _sums(x, edges)
    lens = stops - starts
    upper, lower = (body >= 65) & (body <= 90), (body >= 97) & (body <= 122)
    symbol = np.isin(body, np.frombuffer(b"#$%&*+=@^_|~<>{}[]\\/", dtype=np.uint8))
    stop = np.isin(body, np.frombuffer(b".!?", dtype=np.uint8))
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    up, low, sym = count(upper), count(lower), count(symbol)
    w_up, w_low, w_sym = up[stops] - up[starts], low[stops] - low[starts], sym[stops] - sym[starts]
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = keys[1:] == keys[:-1]
    same[edges[:-1][counts > 0]] = False
    last = np.zeros(len(keys), dtype=bool)
    if len(keys):
        last[:] = stop[stops - 1]
    distinct, top = np.zeros(len(counts)), np.zeros(len(counts))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b > a:
            _, c = np.unique(keys[a:b], return_counts=True)
            distinct[i], top[i] = len(c), c.max()
    lines = _sums(body == 10, offsets) + (np.diff(offsets) > 0)
    x = np.column_stack([
        np.log1p(counts), by_words(lens) / n, by_words(lens > 12) / n, distinct / n, top / n, by_words(same) / n, _sums(symbol, offsets) / chars, _sums(upper, offsets) / chars, by_words((w_up > 1) & (w_low == 0)) / n, _sums((body >= 48) & (body <= 57), offsets) / chars,
        _sums(body == 124, offsets) / n, _sums(body == 33, offsets) / n, by_words(lens <= 3) / n, np.log1p(lines), np.log1p(counts / np.maximum(lines, 1)), by_words(last) / n, by_words(w_sym > 0) / n, by_words(lens == 1) / n,
    ])
    return np.where((counts > 0)[:, None], x, 0.0)


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, k], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[coarse[i], coarse[j]]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(features(texts)), -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 is no cut."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    if len(g) < 2:
        return 0.0, 0
    lg, lh = cg[:-1], ch[:-1]
    rg, rh = cg[-1] - lg, ch[-1] - lh
    gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
    gain[(lh < 1) | (rh < 1)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree on one feature's bins, as a step function over them."""
    _, at = _split(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts one feature of a pair and then, on either side, the other; with its gain."""
    best, most = np.zeros(g.shape), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for at in range(1, len(a)):
            out, total = np.empty(a.shape), 0.0
            for side in (slice(0, at), slice(at, len(a))):
                sg, sh = a[side].sum(axis=0), b[side].sum(axis=0)
                gain, _ = _split(sg, sh)
                total += gain + sg.sum() ** 2 / (sh.sum() + 1)
                out[side] = _tree(sg, sh, 1)
            if total > most:
                best, most = (out.T if turned else out), total
    return best, most


def fit_features(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on feature rows and labels 0/1; a single label, or none, gives a constant."""
    y = np.asarray(y, dtype=float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    cut = lambda col, n: np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1])) if len(col) else np.empty(0)
    edges = [cut(x[:, k], BINS) for k in range(x.shape[1])]
    coarse = [cut(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    model = Model(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    margin = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[k])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[k] += step
            margin += step[b]
    small = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    flat = lambda i, j: small[i] * (len(coarse[j]) + 1) + small[j]
    shape = lambda i, j: (len(coarse[i]) + 1, len(coarse[j]) + 1)
    grid = lambda v, i, j: np.bincount(flat(i, j), v, int(np.prod(shape(i, j)))).reshape(shape(i, j))
    g, h = slopes()
    ranked = sorted(((_pair_tree(grid(g, i, j), grid(h, i, j))[1], (i, j)) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])), reverse=True)
    model.pairs = [ij for _, ij in ranked[:PAIRS]]
    model.pair_tables = [np.zeros(shape(*ij)) for ij in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            step = RATE * _pair_tree(grid(g, i, j), grid(h, i, j))[0]
            t += step
            margin += step[small[i], small[j]]
    return model


def fit(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model:
    """Fit on the feature rows of at most ``rows`` labelled ids, those of the lowest key hash.

    Null ids and labels teach nothing; null texts count as empty.  An id labelled twice has the larger label; of texts that share
    an id the one of the lowest hash counts, and repeated rows count once.  Without labels, or of one label only, the score is the
    same for all texts.  Only features and labels reach the driver; further columns are not read.
    """
    tune(df.sparkSession)
    known = only(labels, **{doc_id: "doc", label: "y"}).where("doc is not null and y is not null").groupBy("doc").agg(F.max("y").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc"), "doc").limit(rows)
    docs = only(df, **{doc_id: "doc", text: "text"}).join(F.broadcast(known), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("y"), b.column("h"), pa.array(list(x), pa.list_(pa.float64()))], ["doc", "y", "h", "x"])

    kind = docs.schema["doc"].dataType.simpleString()
    every = docs.select("doc", "y", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(run), f"doc {kind}, y int, h long, x array<double>")
    # One row for each id, picked where the rows lie, so that no more than ``rows`` of them reach the driver.
    got = every.groupBy("doc", "y").agg(F.min(F.struct("h", "x")).alias("t")).select("doc", "y", "t.x").toPandas().sort_values("doc")
    x = np.vstack([np.asarray(v) for v in got["x"]]) if len(got) else np.zeros((0, len(FEATURES)))
    return fit_features(x, got["y"].to_numpy() > 0)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``, 0 to 1, by additions of bins.  Null and empty texts are scored as texts without words.

    Every row is scored by its whole text alone: repeated rows alike, an empty table gives no rows.  A column that is already
    called ``out`` is replaced; others may have any name.
    """
    tune(df.sparkSession)

    @F.pandas_udf("double")
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(lambda own: (pd.Series(model.score(pa.array(c, pa.string(), from_pandas=True))) for c in own))(columns)

    return df.withColumn(out, scored(F.col(f"`{text}`")))
