"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions alone.

A window (ten words of an item, or all of a shorter item) is contained in a document only if each of its one-word shingles
is, so with these ordered by rarity over all documents, which is counted first, a prefix of one is all that is necessary.
Documents are exploded into words and joined with the windows' prefixes; position and length bounds say where the window
would have to lie, and the words there are compared exactly.  The document side is never shuffled: the windows are broadcast, in slices of a checked
size, however many they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored

WINDOW = 10
#: Distinct windows in one broadcast; more windows make more slices, and one pass over the documents for each.
SLICE = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = ""  # no word, and the prefix of no window: each document keeps one row


def words(text: Column) -> Column:
    """Words of ``text`` with A-Z lower-cased; null has none."""
    t = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, upper, upper.lower()))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def windows(items: DataFrame) -> DataFrame:
    """(win, size, ids): every distinct window with the items it belongs to.  ``items``: item_id, w."""
    own = items.where(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("size"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)
    each = own.select("item_id", "size", F.posexplode(F.transform(starts, lambda i: F.slice("w", i, F.col("size")))).alias("at", "win"))
    return each.groupBy("win", "size").agg(F.collect_set("item_id").alias("ids"))


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string> sorted) for every row of ``docs``.

    A word is hit when it lies in an occurrence of a window.  Null and empty texts have no words; items without words have
    no windows; null item ids are left out of ``items`` but their windows hit.  Repeated documents give one row each; two
    texts under one id are two documents.  Empty tables give no rows, or rows without hits.  Further columns are not read.
    """
    d = only(docs, **{doc_id: "doc", doc_text: "text"})
    one = d.select("doc", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w")).select("doc", "h", "w", F.size("w").alias("n"))
    b = only(items, **{item_id: "item_id", item_text: "text"}).select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    wins = stored(windows(b))
    slices = max(1, math.ceil(wins.count() / SLICE))
    placed = wins.select("win", "size", "ids", F.posexplode("win").alias("at", "key"))
    parts = [placed.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == i) for i in range(slices)]
    # The outer forms of explode: for the others the optimizer infers a filter on the array's size and cuts the text twice.
    prefix = None
    for part in parts:
        wanted = F.broadcast(part.select(F.col("key").alias("k")).distinct())
        flat = one.select(F.explode_outer("w").alias("key"))
        counted = flat.join(wanted, flat.key == wanted.k, "left_semi").groupBy("key").count()
        rank = Window.partitionBy("win").orderBy(F.coalesce("count", F.lit(0)), "at")
        best = part.join(counted, "key", "left").withColumn("r", F.row_number().over(rank)).where("r = 1").select("key", "at", "win", "size", "ids")
        prefix = best if prefix is None else prefix.unionByName(best)
    prefix = stored(prefix)
    base = prefix.sparkSession.createDataFrame([(BASE, 0, None, 0, None)], prefix.schema)
    hits = None
    for i in range(slices):
        mine = prefix.where(F.pmod(F.xxhash64("win"), F.lit(slices)) == i)
        side = F.broadcast(mine.unionByName(base) if i == 0 else mine).withColumnRenamed("key", "k")
        flat = one.select("doc", "h", "n", "w", F.posexplode_outer(F.concat("w", F.array(F.lit(BASE)))).alias("pos", "key"))
        start = F.col("pos") - F.col("at")
        fits = (start >= 0) & (start + F.col("size") <= F.col("n"))  # position and length bounds
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("win")
        found = flat.join(side, flat.key == side.k).where(F.col("win").isNull() | (fits & same))
        found = found.select("doc", "h", "n", F.when(F.col("win").isNotNull(), start).alias("start"), "size", "ids")
        hits = found if hits is None else hits.unionByName(found)
    at = F.when(F.col("start").isNotNull(), F.struct("start", "size"))
    whole = hits.groupBy("doc", "h", "n").agg(F.count(F.when(F.col("start").isNull(), 1)).alias("copies"), F.collect_set(at).alias("at"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
    # Sorted by start, what an occurrence adds is what lies behind the furthest end so far.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["size"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("hit"))
    n_hit = F.aggregate(F.sort_array("at"), zero, step, lambda a: a["hit"])
    out = whole.select("doc", F.col("n").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.sort_array("ids").alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return out.select(F.col("doc").alias(doc_id), "n_words", "n_hit", "items")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    joined = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select(doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
