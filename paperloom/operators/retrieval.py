"""Exact vector retrieval: batches of queries against a store, with filters, thresholds and context.

The stated queries meet all rows of the store in blocks: a slice of at most BROADCAST_QUERIES queries at a time is broadcast to
where the store lies, so the store is never shuffled and what is broadcast has a fixed bound; each slice keeps its best k.  A task
multiplies its Arrow batches with the queries as matrices, which add up in any order; only what comes within that error of a
query's k best is computed again, component by component, and these values are told.  So no row is made of a pair that cannot count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import DEFAULT
from paperloom.functions import vectors as V
from paperloom.sources import files

#: Queries in one broadcast, products in one matrix, and what a product may be off by, as a share of the vectors' lengths.
BROADCAST_QUERIES, PRODUCTS, ERROR = 20_000, 2_000_000, 1e-12


@dataclass
class Asked:
    """A slice of queries: their ids, a matrix of their vectors, and the values that must agree, if any."""

    ids: pa.Array
    q: np.ndarray
    same: list | None = None


def usable(v: str) -> Column:
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim) if len(column) else np.empty((0, dim))


def asked(queries: DataFrame, same: str | None = None, most: int = BROADCAST_QUERIES) -> Iterator[Asked]:
    """queries(query_id, q [, same]) in slices of about ``most``; vectors that could not be stored ask for nothing."""
    q = queries.select("query_id", "q", *([F.col(same).alias("same")] if same else [])).where(usable("q"))
    n = max(1, -(-q.count() // most))
    for i in range(n):
        rows = (q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow().combine_chunks()
        col = lambda c: rows[c].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(c).type)  # noqa: B023, E731
        lengths = set(pc.list_value_length(col("q")).to_pylist())
        if len(lengths) > 1:
            raise ValueError("the vectors of the queries have several dimensions")
        yield Asked(col("query_id"), matrix(col("q"), lengths.pop() if lengths else 1), col("same").to_pylist() if same else None)


def spread(store: DataFrame) -> DataFrame:
    """``store`` over all cores: vectors take few bytes for the work they make, so that files are cut too coarsely for them."""
    cores = store.sparkSession.sparkContext.defaultParallelism
    return store if store.rdd.getNumPartitions() >= cores else store.repartition(cores)


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, added up component by component, as ``vectors.dot`` does."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        x, y = a[i[at : at + (1 << 16)]], b[j[at : at + (1 << 16)]]
        for d in range(a.shape[1]):
            out[at : at + (1 << 16)] += x[:, d] * y[:, d]
    return out


def first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the rows that at most ``k - 1`` rows before them equal."""
    if len(x) <= k:
        return np.arange(len(x))
    kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(kind[order]) > 0])
    turn = np.arange(len(x)) - np.repeat(begins, np.diff(np.r_[begins, len(x)]))
    return np.sort(order[turn < k])


class Best:
    """The ``k`` best of what a task has seen, for each query of a slice; ``floor`` is what a vector must reach to be among them."""

    def __init__(self, q: np.ndarray, k: int, floor: np.ndarray | None = None, least: float | None = None) -> None:
        self.q, self.k, self.least = q, k, -np.inf if least is None else least
        self.length = np.linalg.norm(q, axis=1)
        self.floor = np.full(len(q), self.least) if floor is None else np.maximum(floor, self.least)
        self.top = np.full((len(q), k), -np.inf)

    def meet(self, x: np.ndarray, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the query, row of x, inner product) of all that may be among the best; rows of x are in the order of their ids."""
        own = first_copies(x, self.k)
        x = x[own]
        which = np.arange(len(self.q)) if which is None else which
        size = max(1, PRODUCTS // max(1, len(x)))
        longest = np.linalg.norm(x, axis=1).max(initial=0)
        for at in range(0, len(which) if len(x) else 0, size):
            some = which[at : at + size]
            near = self.q[some] @ x.T
            slack = ERROR * self.length[some] * longest
            low = self.floor[some] - slack
            crowd = np.flatnonzero((near >= low[:, None]).sum(axis=1) > self.k)
            low[crowd] = np.maximum(low[crowd], np.partition(near[crowd], len(x) - self.k, axis=1)[:, len(x) - self.k] - 2 * slack[crowd]) if len(crowd) else low[crowd]
            i, j = np.nonzero(near >= low[:, None])
            value = exact(self.q, x, some[i], j)
            ok = value >= self.floor[some[i]]
            order = np.lexsort((j[ok], -value[ok], i[ok]))
            i, j, value = i[ok][order], j[ok][order], value[ok][order]
            begins = np.flatnonzero(np.r_[True, np.diff(i) > 0]) if len(i) else np.empty(0, np.int64)
            turn = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
            i, j, value, turn = (a[turn < self.k] for a in (i, j, value, turn))
            if len(i):
                new = np.full((len(some), self.k), -np.inf)
                new[i, turn] = value
                rows = some[i[turn == 0]]
                self.top[rows] = np.sort(np.hstack([self.top[rows], new[i[turn == 0]]]), axis=1)[:, -self.k :]
                self.floor[rows] = np.maximum(self.floor[rows], self.top[rows, 0])
                yield some[i], own[j], value


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return pairs.withColumn("rank", turn).where(F.col("rank") <= k)


def by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.column("id"), null_placement="at_start"))


def rows_by(values: list) -> dict:
    """Row numbers by value; null agrees with nothing."""
    out: dict = {}
    for n, value in enumerate(values):
        if value is not None:
            out.setdefault(value, []).append(n)
    return {value: np.array(rows) for value, rows in out.items()}


def _searched(store: DataFrame, mine: Asked, k: int, least: float | None, kinds: str) -> DataFrame:
    shared = store.sparkSession.sparkContext.broadcast(mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_ = shared.value
        best = Best(asked_.q, k, least=least)
        groups = rows_by(asked_.same) if asked_.same is not None else None
        for batch in batches:
            b = by_id(batch)
            x = matrix(b.column("v"), asked_.q.shape[1])
            parts = [(np.arange(len(x)), None)] if groups is None else [(rows, groups[value]) for value, rows in rows_by(b.column("same").to_pylist()).items() if value in groups]
            for rows, which in parts:
                for i, j, value in best.meet(x[rows], which):
                    yield pa.RecordBatch.from_arrays([asked_.ids.take(pa.array(i)), b.column("id").take(pa.array(rows[j])), pa.array(value)], ["query_id", "id", "similarity"])

    return files.checked_vectors(store, mine.q.shape[1], "v").mapInArrow(run, kinds) if len(mine.q) else store.limit(0).mapInArrow(run, kinds)


def top_k(queries: DataFrame, store: DataFrame, k: int = DEFAULT.top_k, *, least: float | None = None, same: str | None = None, other: Column | None = None) -> DataFrame:
    """queries(query_id, q [, same]) x store(id, v [, same]) -> (query_id, id, similarity, rank).

    The threshold stands before the ranking: with ranks by similarity both orders give the same rows, and fewer are sorted.
    ``same`` names a column that must agree (a filter inside the search); ``other`` is a further condition on pairs, which are then
    made one by one.  Ties fall to the smaller id.  Empty inputs give no rows; vectors that are null, empty, or hold null or
    non-finite components take no part; those left must have one dimension.
    """
    if other is not None:
        q = (queries.withColumnRenamed(same, "_same") if same else queries).where(usable("q"))
        rows = store.where(usable("v"))
        pairs = (rows.join(q, store[same] == F.col("_same")) if same else rows.crossJoin(q)).where(other)
        scored = pairs.select("query_id", "id", V.dot(F.col("q"), F.col("v")).alias("similarity"))
        return ranked(scored if least is None else scored.where(F.col("similarity") >= F.lit(least)), k)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {store.schema['id'].dataType.simpleString()}, similarity double"
    rows, out = spread(store.select("id", "v", *([F.col(same).alias("same")] if same else [])).where(usable("v"))), None
    for mine in asked(queries, same):
        best = ranked(_searched(rows, mine, k, least, kinds), k)
        out = best if out is None else out.unionByName(best)
    return out


def matches(hits: DataFrame, store_text: DataFrame, snippet: int = DEFAULT.snippet) -> DataFrame:
    """hits joined with store_text(id, text): snippet and reason of every match."""
    reason = F.concat(F.lit("Semantic similarity: "), F.format_string("%.2f", "similarity"))
    shown = store_text.select("id", F.substring("text", 1, snippet).alias("text_snippet"))
    return hits.join(shown, "id").select("query_id", "rank", "id", "similarity", "text_snippet", reason.alias("reason"))


def best_per_group(queries: DataFrame, store: DataFrame, group: str) -> DataFrame:
    """The similarity of the best member of each group, for each query; partial maxima meet before any row is shuffled."""
    rows, out = spread(store.select("v", F.col(group).alias("g")).where(usable("v"))), None
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{group}` {store.schema[group].dataType.simpleString()}, similarity double"
    for mine in asked(queries):
        found = _group_maxima(rows, mine, group, kinds).groupBy("query_id", group).agg(F.max("similarity").alias("similarity"))
        out = found if out is None else out.unionByName(found)
    return out


def _group_maxima(store: DataFrame, mine: Asked, group: str, kinds: str) -> DataFrame:
    shared = store.sparkSession.sparkContext.broadcast(mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value.ids, shared.value.q
        length = np.linalg.norm(q, axis=1)
        for b in batches:
            x = matrix(b.column("v"), q.shape[1])
            known = b.column("g").dictionary_encode(null_encoding="encode")
            code = known.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            own = order[first_copies(np.column_stack([x, code])[order], 1)]
            x, code = x[own], code[own]
            begins = np.flatnonzero(np.r_[True, np.diff(code) > 0]) if len(code) else np.empty(0, np.int64)
            size = max(1, PRODUCTS // max(1, len(x)))
            for at in range(0, len(q) if len(x) else 0, size):
                near = q[at : at + size] @ x.T
                slack = 2 * ERROR * length[at : at + size] * np.linalg.norm(x, axis=1).max()
                most = np.maximum.reduceat(near, begins, axis=1)
                i, j = np.nonzero(near >= np.repeat(most, np.diff(np.r_[begins, len(x)]), axis=1) - slack[:, None])
                value = np.full((len(near), len(begins)), -np.inf)
                np.maximum.at(value, (i, np.searchsorted(begins, j, side="right") - 1), exact(q[at : at + size], x, i, j))
                i = np.repeat(np.arange(at, at + len(near)), len(begins))
                of = known.dictionary.take(pa.array(np.tile(code[begins], len(near))))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), of, pa.array(value.ravel())], ["query_id", group, "similarity"])

    return files.checked_vectors(store, mine.q.shape[1], "v").mapInArrow(run, kinds) if len(mine.q) else store.limit(0).mapInArrow(run, kinds)


def context(hits: DataFrame, store_text: DataFrame, size: int = 800) -> DataFrame:
    """One text per query: its hits in rank order, ``[heading]`` and text, blank lines in between."""
    piece = F.concat(F.lit("["), F.col("heading"), F.lit("]\n"), F.substring("text", 1, size))
    told = hits.join(store_text.select("id", piece.alias("piece")), "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("p"))
    return told.select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n\n").alias("context"))
