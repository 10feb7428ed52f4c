"""Exact vector search by an inverted file: vectors in lists around trained centres, lists in rings by distance from the centre.

Two bounds hold for a query q and a vector v of a ring around centre c: q.v = q.c + q.(v - c) <= q.c + |q| |v - c|; and, as
|q - v| is at least the difference of |q - c| and |v - c|, 2 q.v = |q|^2 + |v|^2 - |q - v|^2 is bounded by the triangle's sides.  The
ring's radii and the largest length of its vectors give both without a look at the vectors.  The rings nearest to a query are compared first; rings whose bound lies below the k-th best similarity found there
hold nothing better and are skipped whole.  Results are those of comparing all: how much is skipped depends on how far the vectors
gather around centres, what is returned does not.  What is compared is compared as in ``retrieval``: ring by ring in matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import retrieval as R
from paperloom.sources import files

#: Vectors that centres are trained on, by the hash of their ids; rounds; most centres; rings of the sample's usual width.
SAMPLE, ROUNDS, CENTRES, RINGS = 20_000, 8, 1024, 4
#: (query, ring) pairs in one broadcast, and what sums in another order may differ by.
PAIRS, SLACK = 1_000_000, 1e-6


@dataclass
class Lists:
    """rows(id, v, list, ring) and, for each of the rings, its list, number, radii, longest vector and number of vectors."""

    rows: DataFrame
    centres: np.ndarray
    list_of: np.ndarray
    ring: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    longest: np.ndarray
    count: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that each row of q can have with a vector of each ring."""
        length = np.linalg.norm(q, axis=1)[:, None]
        ahead = q @ self.centres.T
        apart = np.sqrt(np.maximum(length**2 + (self.centres**2).sum(axis=1) - 2 * ahead, 0))[:, self.list_of]
        gap = np.maximum(0, np.maximum(apart - self.outer, self.inner - apart) - SLACK)
        return np.minimum(ahead[:, self.list_of] + length * self.outer, (length**2 + self.longest**2 - gap**2) / 2)


def trained(sample: np.ndarray, centres: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds, started from rows that are drawn by their distance from those drawn before; always the same ones."""
    rng = np.random.default_rng(1)
    at = sample[:1].copy()
    apart = ((sample - at[0]) ** 2).sum(axis=1)
    while len(at) < min(centres, len(sample)) and apart.max() > 0:
        at = np.vstack([at, sample[np.searchsorted(np.cumsum(apart), rng.random() * apart.sum())]])
        apart = np.minimum(apart, ((sample - at[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = nearest(sample, at)[0]
        many = np.bincount(near, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, near, sample)
        at[many > 0] = total[many > 0] / many[many > 0, None]
    return at


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and the distance to it."""
    near = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1) if len(x) else np.empty(0, np.int64)
    return near, np.linalg.norm(x - centres[near], axis=1)


def build(store: DataFrame, path: str | None = None) -> Lists:
    """Lists of store(id, v), written below ``path`` (else to a scratch folder).

    Vectors that are null, empty, or hold null or non-finite components take no part; those left must have one dimension.  Centres are
    about as many as the square root of the sample's vectors.  Rows with one id are all kept.
    """
    spark = store.sparkSession
    rows = R.spread(store.select("id", "v").where(R.usable("v")))
    # About twice as many as are wanted pass a test of their hash where they lie, and only these are put in order.
    thin = max(1, rows.count() // (2 * SAMPLE))
    first = rows.where(F.pmod(F.xxhash64("id"), F.lit(thin)) == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    if not first.num_rows:  # few ids stand for very many rows
        first = rows.limit(SAMPLE).select("v").toArrow()
    dim = len(first["v"][0]) if first.num_rows else 1
    sample = R.matrix(first["v"].combine_chunks(), dim) if first.num_rows else np.zeros((1, dim))
    centres = trained(sample, min(CENTRES, max(1, int(np.sqrt(len(sample))))))
    width = max(float(np.median(nearest(sample, centres)[1])) / RINGS, 1e-9)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = R.matrix(b.column("v"), dim)
            near, far = nearest(x, centres)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near, pa.int32()), pa.array((far / width).astype(np.int32)), pa.array(far), pa.array(np.linalg.norm(x, axis=1))], ["id", "v", "list", "ring", "far", "length"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, v {rows.schema['v'].dataType.simpleString()}, list int, ring int, far double, length double"
    where = path or files.scratch(spark)
    checked = files.checked_vectors(rows, dim, "v")
    checked.mapInArrow(placed, kinds).sortWithinPartitions("list", "ring").write.mode("overwrite").parquet(where)
    kept = spark.read.schema(kinds).parquet(where)
    # One row for each ring: at most CENTRES lists of rings up to the farthest vector, whatever the number of vectors.
    heads = kept.groupBy("list", "ring").agg(F.min("far").alias("inner"), F.max("far").alias("outer"), F.max("length").alias("longest"), F.count("*").alias("n")).orderBy("list", "ring").toPandas()
    part = lambda name, kind: heads[name].to_numpy(dtype=kind)
    return Lists(kept.drop("far", "length"), centres, part("list", np.int64), part("ring", np.int64), part("inner", float), part("outer", float), part("longest", float), part("n", np.int64))


def _compared(lists: Lists, mine: R.Asked, k: int, least: float | None, floor: np.ndarray | None, kinds: str) -> DataFrame:
    """(query_id, id, similarity) of what may be among the ``k`` best; without ``floor`` only in the rings that are compared first.

    The stored vectors stay where they lie; the queries, ``floor`` and the rings' heads are broadcast to them.
    """
    heads = Lists(None, *(getattr(lists, n) for n in ("centres", "list_of", "ring", "inner", "outer", "longest", "count")))
    shared = lists.rows.sparkSession.sparkContext.broadcast((heads, mine, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, low = shared.value
        best = R.Best(asked.q, k, low, least)
        opened = _opened(own, asked.q, k, low)
        number = {at: n for n, at in enumerate(zip(own.list_of.tolist(), own.ring.tolist(), strict=True))}
        for batch in batches:
            b = R.by_id(batch)
            x = R.matrix(b.column("v"), asked.q.shape[1])
            for at, rows in R.rows_by(list(zip(b.column("list").to_pylist(), b.column("ring").to_pylist(), strict=True))).items():
                which = np.flatnonzero(opened[:, number[at]])
                for i, j, value in best.meet(x[rows], which) if len(which) else ():
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(i)), b.column("id").take(pa.array(rows[j])), pa.array(value)], ["query_id", "id", "similarity"])

    return lists.rows.mapInArrow(run, kinds)


def _opened(lists: Lists, q: np.ndarray, k: int, floor: np.ndarray | None) -> np.ndarray:
    """For each query and ring whether it is compared: all that may reach ``floor``; without it, those that come first and hold ``k``."""
    bounds = lists.bounds(q)
    if floor is not None:
        return bounds >= floor[:, None] - SLACK
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(lists.count[order], axis=1)
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, np.hstack([np.zeros((len(q), 1), held.dtype), held[:, :-1]]) < k if bounds.shape[1] else out, axis=1)
    return out


def _floor(lists: Lists, mine: R.Asked, k: int, least: float | None) -> np.ndarray:
    """What the k-th best of the rings compared first has, for each query of the slice; ``least`` where there are fewer."""
    numbered = R.Asked(pa.array(range(len(mine.q)), pa.int64()), mine.q)
    kinds = f"query_id long, id {lists.rows.schema['id'].dataType.simpleString()}, similarity double"
    first = R.ranked(_compared(lists, numbered, k, least, None, kinds), k)
    best = first.where(F.col("rank") == k).select("query_id", "similarity").toArrow()
    out = np.full(len(mine.q), -np.inf if least is None else least)
    out[best["query_id"].to_numpy()] = best["similarity"].to_numpy()
    return out


def _slices(queries: DataFrame, lists: Lists) -> Iterator[R.Asked]:
    for mine in R.asked(queries, most=max(1, PAIRS // max(1, len(lists.count)))):
        if len(mine.q) and len(lists.count) and mine.q.shape[1] != lists.centres.shape[1]:
            raise ValueError(f"a query does not have {lists.centres.shape[1]} dimensions")
        yield mine


def top_k(queries: DataFrame, lists: Lists, k: int, *, least: float | None = None) -> DataFrame:
    """queries(query_id, q) -> (query_id, id, similarity, rank), exactly as ``retrieval.top_k`` of the whole store.

    Queries are a stated set: they meet the store in slices of about PAIRS (query, ring) pairs.  Ties fall to the smaller id; query
    vectors that could not be stored find nothing; an empty store or no queries give no rows.
    """
    kinds, out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {lists.rows.schema['id'].dataType.simpleString()}, similarity double", None
    for mine in _slices(queries, lists):
        if len(mine.q) and len(lists.count):
            best = R.ranked(_compared(lists, mine, k, least, _floor(lists, mine, k, least), kinds), k)
            out = best if out is None else out.unionByName(best)
    return R.ranked(queries.sparkSession.createDataFrame([], kinds), k) if out is None else out


def compared(queries: DataFrame, lists: Lists, k: int, *, least: float | None = None) -> DataFrame:
    """(query_id, compared, stored): how many vectors a search compares with each query, of how many."""
    kinds, total = f"query_id {queries.schema['query_id'].dataType.simpleString()}, compared long, stored long", int(lists.count.sum())
    rows = []
    for mine in _slices(queries, lists):
        opened = _opened(lists, mine.q, k, _floor(lists, mine, k, least)) if len(mine.q) and total else np.zeros((len(mine.q), 0), bool)
        rows += [(query, int(n), total) for query, n in zip(mine.ids.to_pylist(), opened @ lists.count, strict=True)]
    return queries.sparkSession.createDataFrame(rows, kinds)
