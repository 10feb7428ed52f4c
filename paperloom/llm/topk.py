"""Exact top-k by inner product, term at a time.

Every dimension is a term.  Vectors are dealt by a hash of their id to blocks of bounded size, queries to chunks of bounded
size; each (block, chunk) cell is one task's work and holds no more than that.  In a cell the block is turned into postings
(for each term the rows with a non-zero weight), each query scatters weight x posting weight into a dense score array, a
partial selection keeps the cell's best k, and the cells' winners are merged per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only

BLOCK_ROWS = 4096
CHUNK_ROWS = 2048
BIG = 2.0**62


def quantised(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """(vid, w): floor(scale * x) of every component; rows that take no part are left out."""
    v = only(df, **{id_col: "vid", vector: "v"})
    w = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < BIG))
    return v.where(F.col("vid").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))).select("vid", w.cast("array<bigint>").alias("w"))


def _cell(k: int):
    def best(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        if rows.empty or queries.empty:
            return empty
        if rows["vid"].duplicated().any():  # of vectors under one id the smallest counts
            rows = rows.assign(t=rows["w"].map(tuple)).sort_values(["vid", "t"], kind="stable")
        rows = rows.sort_values("vid", kind="stable").drop_duplicates("vid").reset_index(drop=True)
        ids, n = rows["vid"].to_numpy(), len(rows)
        lens = rows["w"].map(len).to_numpy()
        terms = np.concatenate([np.arange(x) for x in lens]) if n else np.empty(0, int)
        weights = np.concatenate(list(rows["w"])).astype(np.int64) if lens.sum() else np.empty(0, np.int64)
        owner = np.repeat(np.arange(n), lens)
        live = weights != 0
        terms, weights, owner = terms[live], weights[live], owner[live]
        order = np.argsort(terms, kind="stable")
        terms, weights, owner = terms[order], weights[order], owner[order]
        cut = np.searchsorted(terms, np.arange((int(lens.max()) if n else 0) + 1))
        out = []
        for qid, qw in zip(queries["vid"], queries["w"], strict=True):
            scores = np.zeros(n, dtype=np.int64)
            for t in np.flatnonzero(np.asarray(qw)):
                if t + 1 < len(cut):
                    at = slice(cut[t], cut[t + 1])
                    scores[owner[at]] += qw[t] * weights[at]  # a row occurs once in a term's postings
            own = np.flatnonzero(ids != qid)
            s = scores[own]
            if len(s) > k:
                edge = np.partition(s, len(s) - k)[len(s) - k]
                own = np.concatenate([own[s > edge], own[s == edge][:k]])  # rows stand by id, so ties fall to smaller ids
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[own], "score": scores[own]}))
        return pd.concat(out) if out else empty

    return best


def top_k(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", *, k: int = 5, scale: int = 256, every: int = 50) -> DataFrame:
    """For each row whose id is divisible by ``every``: the ``k`` other rows of highest integer inner product.

    Ties fall to the smaller id; fewer candidates give fewer rows.  Rows with a null id, a null vector or a component that
    is null, not finite or beyond 64-bit integers after scaling take no part.  Rows that repeat an id are one vector,
    the first in the order of their components if they differ.  Missing dimensions weigh 0.  Sums wrap at 64 bits.  An empty table, or one
    without queries, gives no rows.
    """
    v = quantised(df, id_col, vector, scale)
    n = v.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    is_query = F.col("vid") % every == 0
    chunks = max(1, math.ceil(v.where(is_query).count() / CHUNK_ROWS))
    block = F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(7), "vid"), F.lit(chunks)).cast("int")
    rows = v.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("c"), "vid", "w")
    queries = v.where(is_query).groupBy("vid").agg(F.min("w").alias("w")).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), chunk.alias("c"), "vid", "w")
    cells = rows.groupBy("b", "c").cogroup(queries.groupBy("b", "c")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
