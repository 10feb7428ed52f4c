"""JSON Lines, text dumps, Parquet stores and the embedding cache."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.sources import store

PAPER_ROWS = "search_keyword string, id string, title string, abstract string, url string, year int, categories array<string>"


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share, for a table that only this application reads.

    Where that is unset, a local master takes one on its machine; a cluster fails.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return f"{found}/paperloom-{sc.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to ``scratch`` and read again: computed once, whatever is made of it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of papers; blank lines are skipped, ids are text, missing titles and abstracts are empty."""
    return spark.read.schema(PAPER_ROWS).json(path).fillna("", ["title", "abstract"])


def write_papers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text.  A file that is no UTF-8 has a line that says so for its text."""
    files = spark.read.format("binaryFile").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    failed = F.concat(F.lit("[Error reading file: "), F.element_at(F.split("path", "/"), -1), F.lit("]"))
    return files.select("path", F.coalesce(text, failed).alias("text"))


def joined_dumps(dumps: DataFrame) -> Column:
    """All dumps of a group in one text, each under a banner, by path."""
    banner = F.concat(F.lit("\n===== "), F.col("path"), F.lit(" =====\n"), F.col("text"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", banner.alias("b")))), lambda x: x["b"]), "\n")


def paper_info(title: Column, url: Column, idea: Column, parts: Column) -> Column:
    """The text kept for one paper: a head, then its extracted parts, array<struct<heading, text>>."""
    line = F.lit("=" * 80 + "\n")
    body = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("--- "), p["heading"], F.lit(" ---\n"), p["text"])), "\n\n")
    return F.concat(line, F.lit("Title: "), title, F.lit("\nURL: "), url, F.lit("\nIdea: "), idea, F.lit("\n"), line, body)


def write_text(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def result_document(papers: DataFrame, topic: str, at: Column) -> DataFrame:
    """One row: topic, time, number of papers and the papers, as they are written to one JSON document a topic."""
    rows = papers.agg(F.sort_array(F.collect_list(F.struct(*papers.columns))).alias("papers"))
    return rows.select(F.lit(topic).alias("topic"), F.date_format(at, "yyyyMMdd_HHmmss").alias("timestamp"), F.size("papers").alias("total"), "papers")


def write_results(df: DataFrame, folder: str, topic: str, at: Column | None = None, mode: str = "overwrite") -> str:
    """The topic's results as one JSON document, in a folder named after the topic."""
    import re

    path = f"{folder}/{re.sub(r'[^A-Za-z0-9_-]+', '_', topic)[:50]}"
    result_document(df, topic, at if at is not None else F.current_timestamp()).write.mode(mode).json(path)
    return path


def upsert(df: DataFrame, path: str, version: int, key: str = "id") -> None:
    """The rows of ``df`` as a version of a store; ``current`` shows, of the rows with one key, those of the highest version.

    The store is not read, so an upsert costs what its own rows cost, and one that runs again changes nothing.
    """
    store.write(df, path, key=key, version=version)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each key; of several rows of one version the least."""
    return store.read(spark, path)


def checked_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """``df``; a vector that does not have ``dim`` dimensions fails."""
    wrong = F.raise_error(F.lit(f"a vector does not have {dim} dimensions")).cast(df.schema[vector].dataType)
    return df.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong))


def append_index(df: DataFrame, path: str, dim: int, version: int = 0, vector: str = "embedding") -> None:
    """Vectors, with what belongs to them, into a store that ``current`` reads; their dimension is checked."""
    upsert(checked_vectors(df, dim, vector), path, version)


def index_rows(chunks: DataFrame, papers: DataFrame, embedding: Column) -> DataFrame:
    """Valid chunks with their vector and metadata, as they are kept in a vector store.

    chunks(chunk_id, paper_id, heading, heading_index, chunk_index, text, is_valid), papers(paper_id, arxiv_id, title, categories,
    abstract): abstracts are cut to 500 characters, a missing heading is empty.
    """
    kept = chunks.where("is_valid").withColumn("embedding", embedding).join(papers, "paper_id")
    return kept.select(
        F.col("chunk_id").alias("id"), "text", "embedding", "paper_id", "arxiv_id", F.col("title").alias("paper_title"), F.coalesce("heading", F.lit("")).alias("heading"), "heading_index", "chunk_index",
        F.array_join("categories", ",").alias("categories"), F.substring(F.coalesce("abstract", F.lit("")), 1, 500).alias("abstract"),
    )


def put_cache(df: DataFrame, path: str, model: str, mode: str, version: int) -> None:
    """df(text, embedding) into the embedding cache (key, model, embedding); a later version of a text replaces an earlier one."""
    upsert(df.select(cache_key(model, mode, F.col("text")).alias("key"), F.lit(model).alias("model"), "embedding"), path, version, "key")


def truncate_index(df: DataFrame, path: str) -> None:
    store.write(df, path, mode="overwrite")


def cache_key(model: str, mode: str, text: Column) -> Column:
    """A key for a text as a passage or as a query: the two have different vectors, so the mode is part of it."""
    return F.sha2(F.concat(F.lit(f"{model}\n{mode}\n"), text).cast("binary"), 256)


def split_cache(texts: DataFrame, cache: DataFrame, model: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their embedding, misses) of texts(id, text) in cache(key, embedding)."""
    keyed = texts.withColumn("key", cache_key(model, mode, F.col("text")))
    return keyed.join(cache.select("key", "embedding"), "key"), keyed.join(cache.select("key"), "key", "left_anti")


def embedding_text(title: Column, abstract: Column) -> Column:
    full = lambda c: F.nullif(T.strip(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n\n", full(title), full(abstract))
