"""Chunking as folds over each section's paragraphs and sentences, inside the section's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings
from paperloom.functions import text as T

_CHUNK = "struct<text:string,char_start:int,char_end:int,is_valid:boolean>"


def _none() -> Column:
    return F.array().cast(f"array<{_CHUNK}>")


def _chunk(text: Column, start: Column, end: Column, valid: Column) -> Column:
    return F.struct(text.alias("text"), start.cast("int").alias("char_start"), end.cast("int").alias("char_end"), valid.alias("is_valid"))


def packed_paragraphs(cleaned: Column, cfg: Settings = DEFAULT) -> Column:
    """Paragraphs packed into chunks of at most ``max_chunk``, each starting with the end of the one before.

    A full buffer shorter than ``min_chunk`` is dropped; the last one is kept, if only as invalid.
    """
    zero = F.struct(F.lit("").alias("buf"), F.lit(0).alias("start"), F.lit(0).alias("pos"), _none().alias("out"))

    def step(a: Column, p: Column) -> Column:
        full = (a["buf"] != "") & (F.length(a["buf"]) + F.length(p) + 2 > cfg.max_chunk)
        tail = T.overlap_tail(a["buf"], cfg)
        body = T.strip(a["buf"])
        done = F.array(_chunk(body, a["start"], a["pos"], F.lit(True)))
        return F.struct(
            F.when(full, F.concat(tail, p)).when(a["buf"] == "", p).otherwise(F.concat(a["buf"], F.lit("\n\n"), p)).alias("buf"),
            F.when(full, a["pos"] - F.length(tail)).when(a["buf"] == "", a["pos"]).otherwise(a["start"]).alias("start"),
            (a["pos"] + F.length(p) + 2).alias("pos"),
            F.when(full & (F.length(body) >= cfg.min_chunk), F.concat(a["out"], done)).otherwise(a["out"]).alias("out"),
        )

    def finish(a: Column) -> Column:
        body = T.strip(a["buf"])
        last = F.array(_chunk(body, a["start"], F.length(cleaned), F.length(body) >= cfg.min_chunk))
        return F.when(body != "", F.concat(a["out"], last)).otherwise(a["out"])

    return F.aggregate(T.paragraphs(cleaned), zero, step, finish)


def packed_sentences(chunk: Column, cfg: Settings = DEFAULT) -> Column:
    """A chunk cut into sentences that are packed again; a longer sentence stays whole.  Offsets add up what went before."""
    zero = F.struct(F.lit("").alias("buf"), chunk["char_start"].alias("start"), _none().alias("out"))
    valid = lambda t: F.length(T.strip(t)) >= cfg.min_chunk

    def step(a: Column, s: Column) -> Column:
        full = F.length(a["buf"]) + F.length(s) + 1 > cfg.max_chunk
        done = F.array(_chunk(T.strip(a["buf"]), a["start"], a["start"] + F.length(a["buf"]), valid(a["buf"])))
        return F.struct(
            F.when(full | (a["buf"] == ""), s).otherwise(F.concat(a["buf"], F.lit(" "), s)).alias("buf"),
            F.when(full, a["start"] + F.length(a["buf"])).otherwise(a["start"]).alias("start"),
            F.when(full & (T.strip(a["buf"]) != ""), F.concat(a["out"], done)).otherwise(a["out"]).alias("out"),
        )

    def finish(a: Column) -> Column:
        last = F.array(_chunk(T.strip(a["buf"]), a["start"], chunk["char_end"], valid(a["buf"])))
        return F.when(T.strip(a["buf"]) != "", F.concat(a["out"], last)).otherwise(a["out"])

    return F.aggregate(T.sentences(chunk["text"]), zero, step, finish)


def chunks(sections: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """sections(paper_id, heading_index, text, section_text) -> chunks with dense numbers within their section."""
    c = sections.select("paper_id", "heading_index", F.col("text").alias("heading"), T.clean(F.col("section_text")).alias("t"))
    n = F.length(T.strip(F.col("t")))
    short = F.array(_chunk(T.strip(F.col("t")), F.lit(0), F.length("t"), n >= cfg.min_chunk // 2))
    long = F.flatten(F.transform(packed_paragraphs(F.col("t"), cfg), lambda x: F.when(F.length(x["text"]) > cfg.max_chunk * 1.5, packed_sentences(x, cfg)).otherwise(F.array(x))))
    each = c.select("paper_id", "heading_index", "heading", "t", F.posexplode_outer(F.when(n < cfg.min_chunk, short).otherwise(long)).alias("chunk_index", "x")).where("x is not null")
    reason = F.when((F.length("t") < cfg.min_chunk) & ~F.col("x.is_valid"), "Section too short")
    name = F.format_string("%s_h%02d_c%02d", F.col("paper_id").cast("string"), F.col("heading_index").cast("int"), F.col("chunk_index"))
    return each.select(name.alias("chunk_id"), "paper_id", "heading", "heading_index", "chunk_index", "x.text", "x.char_start", "x.char_end", "x.is_valid", reason.alias("quality_reason"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Counts, mean length and number of headings with chunks, for each paper."""
    return chunks.groupBy("paper_id").agg(
        F.count("*").alias("total_chunks"), F.count_if("is_valid").alias("valid_chunks"), F.count_if(~F.col("is_valid")).alias("invalid_chunks"),
        F.round(F.avg(F.length("text")), 6).alias("avg_chunk_length"), F.countDistinct("heading_index").alias("headings_with_chunks"),
    )


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """``prev_text`` and ``next_text`` of the chunk just before and after in the same section; a gap gives none."""
    w = Window.partitionBy("paper_id", "heading_index").orderBy("chunk_index")
    side = lambda f, by: F.when(f("chunk_index").over(w) == F.col("chunk_index") + by, f("text").over(w))
    return chunks.withColumns({"prev_text": side(F.lag, -1), "next_text": side(F.lead, 1)})
