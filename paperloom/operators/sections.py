"""Markdown sections, from heading lines found with array functions inside each document's row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings
from paperloom.functions import text as T


def headings(markdown: Column) -> Column:
    """array<struct<line, level, body, raw>> of the heading lines; ``line`` counts from 0."""
    lines = F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda s, i: F.struct(i.alias("line"), T.strip(s).alias("raw")))
    found = F.filter(lines, lambda x: x["raw"].rlike(r"^#"))
    return F.transform(found, lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["raw"], T.HEADING, 1)).alias("level"), F.regexp_extract(x["raw"], T.HEADING, 2).alias("body"), x["raw"].alias("raw")))


def lines_between(markdown: Column, start: Column, end: Column) -> Column:
    """Lines start (from 0) to before end, trimmed as a whole."""
    return T.strip(F.array_join(F.slice(F.split(markdown, "\n"), start + 1, F.greatest(end - start, F.lit(0))), "\n"))


def n_lines(markdown: Column) -> Column:
    return F.size(F.split(markdown, "\n"))


def sections(papers: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """papers(paper_id, markdown) -> one row per kept section, numbered from 0 within its paper.

    Sections whose heading is to be skipped still end the section before them.  Null and empty markdown has no section.
    """
    h = papers.select("paper_id", "markdown", headings(F.col("markdown")).alias("h"))
    ends = F.concat(F.transform(F.slice("h", 2, F.greatest(F.size("h"), F.lit(1))), lambda x: x["line"]), F.array(n_lines(F.coalesce("markdown", F.lit("")))))
    told = F.transform(F.arrays_zip(F.col("h").alias("h"), F.when(F.size("h") > 0, ends).otherwise(F.array().cast("array<int>")).alias("end")), lambda x: F.struct(x["h"]["line"].alias("line"), x["h"]["level"].alias("level"), T.clean_heading(x["h"]["body"]).alias("text"), x["h"]["raw"].alias("raw"), x["end"].alias("end")))
    kept = h.select("paper_id", "markdown", told.alias("h")).select("paper_id", "markdown", F.posexplode_outer(F.filter("h", lambda x: ~T.is_skipped(x["text"]))).alias("heading_index", "x")).where("x is not null")
    cut = kept.select("paper_id", "heading_index", "x.level", "x.text", F.col("x.raw").alias("raw_text"), lines_between(F.col("markdown"), F.col("x.line") + 1, F.col("x.end")).alias("section_text"))
    return cut.select("paper_id", "heading_index", "level", "text", "raw_text", "section_text", (F.length("section_text") >= cfg.min_section).alias("is_valid"), T.section_quality(F.col("section_text"), cfg).alias("quality_score"))


def between(markdown: Column, start: str, end: str | None) -> Column:
    """Text after the first heading that holds ``start`` to before a later one that holds ``end``; '' if there is none."""
    h = headings(markdown)
    holds = lambda x, word: F.contains(F.lower(x["body"]), F.lit(word.lower()))
    first = F.try_element_at(F.filter(h, lambda x: holds(x, start)), F.lit(1))["line"]
    last = F.try_element_at(F.filter(h, lambda x: (x["line"] > first) & holds(x, end)), F.lit(1))["line"] if end else F.lit(None)
    return F.coalesce(lines_between(markdown, first + 1, F.coalesce(last, n_lines(markdown))), F.lit(""))


def short_headings(markdown: Column) -> Column:
    """The older heading list: array<struct<line, level, text, raw>>, the first one cleaned as a title."""
    return F.transform(headings(markdown), lambda x, i: F.struct(x["line"].alias("line"), x["level"].alias("level"), T.clean_heading_short(T.strip(x["body"]), i == 0).alias("text"), x["raw"].alias("raw")))


def _holding(h: Column, words: tuple[str, ...]) -> Column:
    return F.try_element_at(F.filter(h, lambda x: F.lower(x["text"]).rlike("|".join(words))), F.lit(1))


def between_with_heading(markdown: Column, start: str, end: str | None) -> Column:
    """The older rule: the starting heading's line is part of the text, and a missing one gives a message."""
    h = short_headings(markdown)
    holds = lambda x, word: F.contains(F.lower(x["text"]), F.lit(word.lower()))
    first = F.try_element_at(F.filter(h, lambda x: holds(x, start)), F.lit(1))["line"]
    last = F.try_element_at(F.filter(h, lambda x: (x["line"] > first) & holds(x, end)), F.lit(1))["line"] if end else F.lit(None)
    return F.coalesce(lines_between(markdown, first, F.coalesce(last, n_lines(markdown))), F.lit(f"Start heading '{start}' not found"))


def introduction(markdown: Column) -> Column:
    h = short_headings(markdown)
    first = _holding(h, ("introduction", "intro"))
    last = F.try_element_at(F.filter(h, lambda x: (x["line"] > first["line"]) & (x["level"] <= first["level"])), F.lit(1))["line"]
    return F.coalesce(lines_between(markdown, first["line"] + 1, F.coalesce(last, n_lines(markdown))), F.lit("Introduction section not found"))


def conclusion(markdown: Column) -> Column:
    """Ends at a heading of the same level, or at one of references and the like that is no deeper."""
    h = short_headings(markdown)
    first = _holding(h, ("conclusion", "concluding", "summary", "closing"))
    after = lambda x: (x["line"] > first["line"]) & ((x["level"] == first["level"]) | ((x["level"] < first["level"]) & F.lower(x["text"]).rlike("reference|acknowledgment|acknowledgement|appendix")))
    last = F.try_element_at(F.filter(h, after), F.lit(1))["line"]
    return F.coalesce(lines_between(markdown, first["line"] + 1, F.coalesce(last, n_lines(markdown))), F.lit("Conclusion section not found"))


def abstract(markdown: Column) -> Column:
    """Between the headings of abstract and introduction; else the lines below a line that says abstract, of the first 50."""
    direct = between(markdown, "abstract", "introduction")
    head = F.transform(F.slice(F.split(markdown, "\n"), 1, 50), lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    marks = F.filter(head, lambda x: F.startswith(x["s"], F.lit("#")))
    start = F.try_element_at(F.filter(marks, lambda x: F.contains(F.lower(x["s"]), F.lit("abstract"))), F.lit(1))["i"]
    stop = F.try_element_at(F.filter(marks, lambda x: (x["i"] > start) & ~F.contains(F.lower(x["s"]), F.lit("abstract"))), F.lit(1))["i"]
    inside = F.filter(head, lambda x: (x["i"] > start) & (x["i"] < F.coalesce(stop, F.lit(50))) & (T.strip(x["s"]) != "") & ~F.startswith(x["s"], F.lit("#")))
    scanned = F.coalesce(F.array_join(F.transform(inside, lambda x: T.strip(x["s"])), " "), F.lit(""))
    return F.substring(F.when(direct != "", direct).otherwise(scanned), 1, 2000)
