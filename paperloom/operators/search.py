"""Ranked search in texts: an inverted index in blocks of documents, BM25, and block maxima that rule whole blocks out.

A block is BLOCK neighbouring document numbers.  The index has one row for each word and block that holds it: the block's documents
with their counts, and the largest weight the word has in any of them.  For a query the weights of its words add up to a bound on
every document of a block.  The blocks of the highest bounds are scored first; what the k-th best document there has is less than
or equal to what the k-th best of all has, so blocks whose bound is below it are not read.  Results are those of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources import files

#: Words of queries in one broadcast.
BROADCAST_TERMS = 200_000
#: Documents whose lists one task holds.
PART = 4096
#: Documents in a block; saturation and length weight of BM25; digits of a score, beyond which documents tie.
BLOCK, K1, B, DIGITS = 32, 1.2, 0.75, 6


def words(text: Column) -> Column:
    """Words of a text (letters and digits, lower case), in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


@dataclass
class Index:
    """postings(term, block, docs: array<struct<doc, tf, length>>, top, n: size of docs), documents, and their mean number of words."""

    postings: DataFrame
    documents: int
    mean: float


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    """What a word adds to a document's score, without the word's rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _lists(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(term, block, docs) of rows(doc, block, w) in the order of block and doc."""
    w = rows.column("w")
    length = pc.list_value_length(w).to_numpy(zero_copy_only=False)
    known = w.flatten().dictionary_encode()
    doc, block = rows.column("doc").to_numpy(), rows.column("block").to_numpy()
    number = np.repeat(np.arange(len(doc)), length)
    # One entry for each word of each row, then one for each word of each document: counts add up, the longest row tells the length.
    entry, tf = np.unique(number * max(1, len(known.dictionary)) + known.indices.to_numpy(), return_counts=True)
    number, term = np.divmod(entry, max(1, len(known.dictionary)))
    order = np.lexsort((doc[number], term, block[number]))
    number, term, tf = number[order], term[order], tf[order]
    own, at = doc[number], block[number]
    new = lambda *columns: np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in columns], axis=0)]) if len(own) else np.empty(0, np.int64)
    each = new(own, term)
    tf, longest = (np.add.reduceat(tf, each), np.maximum.reduceat(length[number], each)) if len(each) else (tf, length[number])
    own, term, at = own[each], term[each], at[each]
    begins = new(at, term)
    docs = pa.StructArray.from_arrays([pa.array(own, pa.int64()), pa.array(tf, pa.int64()), pa.array(longest, pa.int32())], ["doc", "tf", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(own)], pa.int32()), docs)
    return pa.RecordBatch.from_arrays([known.dictionary.take(pa.array(term[begins])), pa.array(at[begins], pa.int64()), lists], ["term", "block", "docs"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of whole blocks: the rows of a batch's last block wait for the next batch."""
    left = None
    for batch in batches:
        rows = batch if left is None else pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        block = rows.column("block").to_numpy()
        done = int(np.searchsorted(block, block[-1])) if len(block) else 0
        if done:
            yield _lists(rows.slice(0, done))
        left = rows.slice(done)
    if left is not None and len(left):
        yield _lists(left)


def write_index(corpus: DataFrame, path: str, *, doc: str = "doc_id", text: str = "text") -> Index:
    """Index corpus(doc: whole number, text) below ``path`` and open it.

    Rows without a number are left out, null texts have no words.  Counts of rows that share a number add up; the longest of them
    gives the length.  Texts are shuffled once, by block; a block's words are counted where its texts lie, and only its lists are written.
    """
    no = F.col(f"`{doc}`").cast("long")
    rows = corpus.where(F.col(f"`{doc}`").isNotNull()).select(no.alias("doc"), F.floor(no / BLOCK).alias("block"), F.col(f"`{text}`").alias("text"))
    total = rows.agg(F.count("*").alias("n"), F.avg(F.size(words(F.col("text")))).alias("mean")).first()
    mean = float(total["mean"] or 0) or 1.0
    dealt = rows.repartition("block").sortWithinPartitions("block", "doc").select("doc", "block", words(F.col("text")).alias("w"))
    packed = dealt.mapInArrow(_packed, "term string, block long, docs array<struct<doc:long,tf:long,length:int>>")
    top = F.array_max(F.transform("docs", lambda d: _weight(d["tf"], d["length"], F.lit(mean))))
    packed.withColumns({"top": top, "n": F.size("docs")}).write.mode("overwrite").parquet(f"{path}/postings")
    rows.sparkSession.createDataFrame([(total["n"], mean)], "documents long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    return open_index(rows.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    total = spark.read.parquet(f"{path}/totals").first()
    return Index(spark.read.parquet(f"{path}/postings"), total["documents"], total["mean"])


def _among(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` of terms(term), distinct ones, which are broadcast to where the lists lie, at most BROADCAST_TERMS at a time."""
    n, out = max(1, -(-terms.count() // BROADCAST_TERMS)), None
    for i in range(n):
        part = rows.join(F.broadcast(terms if n == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i)), "term", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def rarities(terms: DataFrame, index: Index) -> DataFrame:
    """(term, df, rarity) of those of terms(term), distinct ones, that the index knows."""
    many = _among(index.postings.select("term", "n"), terms).groupBy("term").agg(F.sum("n").alias("df"))
    return many.withColumn("rarity", F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode_outer(F.array_distinct("terms")).alias("term")).where("term is not null")


def _own(queries: DataFrame, index: Index) -> Index:
    """``index`` with the lists of the queries' words only, stored, so that no later step meets the others."""
    return replace(index, postings=files.stored(_among(index.postings, files.stored(_asked(queries).select("term").distinct()))))


def _numbered(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id: a number, terms) and (query_id, number): what is shuffled for each block and document has the number."""
    known = files.stored(queries.select("query_id").distinct().withColumn("number", F.monotonically_increasing_id()))
    rows = queries.join(known, "query_id").select(F.col("number").alias("query_id"), "terms")
    return files.stored(rows), known


def _named(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("query_id", "number").join(_few(known), "number").drop("number").select("query_id", *(c for c in rows.columns if c != "query_id"))


def _few(rows: DataFrame) -> DataFrame:
    """Rows of queries, broadcast if they are no more than BROADCAST_TERMS."""
    kept = files.stored(rows)
    return F.broadcast(kept) if kept.count() <= BROADCAST_TERMS else kept


def _dealt(index: Index, *columns: str) -> DataFrame:
    """Lists by block, so that all of a block's meet in one task; their number of parts grows with the documents, and the work in
    one part, a row for each query and document there, does not."""
    return index.postings.select(*columns).repartition(max(1, -(-index.documents // PART)), "block")


def _bounds(weighed: DataFrame, index: Index) -> DataFrame:
    """(query_id, block, bound, n: documents it has at least); no block's documents are looked at."""
    heads = _dealt(index, "term", "block", "top", "n").join(weighed, "term")
    return heads.groupBy("query_id", "block").agg(F.sum(F.col("rarity") * F.col("top")).alias("bound"), F.max("n").alias("n"))


def _scored(read: DataFrame, index: Index) -> DataFrame:
    """(query_id, doc, score) of the documents in the lists of read(query_id, block, rarity, docs)."""
    each = read.select("query_id", "block", "rarity", F.explode_outer("docs").alias("d"))
    weight = F.col("rarity") * _weight(F.col("d.tf"), F.col("d.length"), F.lit(index.mean))
    return each.groupBy("query_id", "block", F.col("d.doc").alias("doc")).agg(F.round(F.sum(weight), DIGITS).alias("score")).drop("block")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", turn).where(F.col("rank") <= k)


def _read(queries: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, rarity); (query_id, block, rarity, n, docs), the lists that are read: those of the blocks scored first and of
    those that their scores leave open."""
    asked = _asked(queries)
    weighed = _few(asked.join(rarities(asked.select("term").distinct(), index), "term").select("query_id", "term", "rarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bound", DIGITS)), "block")
    best = _bounds(weighed, index).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("query_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = _few(best.withColumn("before", before).where(F.col("before") < k).select("query_id", "block"))
    lists = index.postings.select("block", "term", "docs").join(_few(first.join(weighed, "query_id")), ["block", "term"])
    least = _few(_ranked(_scored(lists, index), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least")))
    # The bound again, beside each of a query's lists of the block, where they lie.
    each = _dealt(index, "term", "block", "top", "n", "docs").join(weighed, "term")
    each = each.withColumn("bound", F.sum(F.col("rarity") * F.col("top")).over(Window.partitionBy("query_id", "block")))
    # A bound is a sum in another order than a score: half a digit of the last place lies between them at most.
    open_ = F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS)
    read = each.join(least, "query_id", "left").join(first.withColumn("first", F.lit(True)), ["query_id", "block"], "left").where(open_ | F.col("first"))
    return weighed, read.select("query_id", "block", "rarity", "n", "docs")


def search(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """queries(query_id, terms: array<string>) -> (query_id, doc, score, rank): the ``k`` best documents, ties to the smaller number.

    A word counts once in a query.  Words that no document holds, null and empty arrays find nothing; documents without a word of
    the query are no hits.  The lists are dealt by block; bounds and scores arise there, and of them the best ``k`` a query and part
    are shuffled.
    """
    queries, known = _numbered(queries)
    index = _own(queries, index)
    _, read = _read(queries, index, k)
    return _named(_ranked(_scored(read, index), k), known)


def cost(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """(query_id, postings, read): how many postings the lists of a query's words hold, and how many of them a search reads."""
    queries, known = _numbered(queries)
    index = _own(queries, index)
    weighed, read = _read(queries, index, k)
    full = weighed.join(index.postings.select("term", "n"), "term").groupBy("query_id").agg(F.sum("n").alias("postings"))
    return _named(full.join(read.groupBy("query_id").agg(F.sum("n").alias("read")), "query_id"), known)
