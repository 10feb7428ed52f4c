"""Text functions as Column expressions: splitting, cleaning, headings, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings

#: Where sentences and paragraphs end, what a heading line is, and the numberings that are taken off one.
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
PARAGRAPH_BREAK = r"(?U)\n\s*\n|\n(?=#+\s)"
HEADING = r"^(#{1,6})\s*(.*)$"
NUMBERINGS = (r"^[0-9.]+\s*", r"^[IVX]+\.\s*", r"^[A-Z]\.\s*", r"^\([0-9]+\)\s*", r"^[0-9]+\)\s*")
#: Words that mark sections to leave out.
SKIPPED = ("references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "appendices", "supplementary", "supplemental")


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def _pieces(text: Column, pattern: str, least: int) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: F.length(s) > least)


def idea_sentences(text: Column) -> Column:
    """Sentences of an idea: longer than ten characters."""
    return _pieces(text, SENTENCE_BREAK, 10)


def sentences(text: Column) -> Column:
    return _pieces(text, SENTENCE_BREAK, 0)


def paragraphs(text: Column) -> Column:
    return _pieces(text, PARAGRAPH_BREAK, 0)


def clean(text: Column) -> Column:
    """Extraction artefacts out: blank lines, runs of spaces, citation marks, figure numbers, in this order."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\[[0-9]+\]", "")
    return strip(F.regexp_replace(t, r"(?U)Fig\.\s*[0-9]+", "Figure"))


def clean_heading(text: Column) -> Column:
    """A heading without its numbering; long ones are cut at a colon, then at a word."""
    t = text
    for numbering in NUMBERINGS:
        t = F.regexp_replace(t, numbering, "")
    t = collapse(t)
    t = F.when((F.length(t) > 100) & F.contains(t, F.lit(":")), F.substring_index(t, ":", 1)).otherwise(t)
    head = F.substring(t, 1, 150)
    t = F.when(F.length(t) > 150, F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("..."))).otherwise(t)
    return strip(t)


def clean_heading_short(text: Column, is_title: Column) -> Column:
    """The older rule: titles keep 200 characters, other headings what stands before a colon, at most 100."""

    def cut(t: Column, lo: int, hi: int) -> Column:
        at_mark = F.regexp_extract(t, rf"(?s)^(.{{{lo},{hi - 1}}}?)[ ,.]", 1)
        return F.when(F.length(t) > hi, strip(F.when(at_mark != "", at_mark).otherwise(F.substring(t, 1, lo)))).otherwise(t)

    before = F.when(F.contains(text, F.lit(":")), strip(F.substring_index(text, ":", 1))).otherwise(text)
    return F.when(is_title, cut(text, 180, 200)).otherwise(cut(before, 80, 100))


def is_skipped(heading: Column) -> Column:
    return F.lower(heading).rlike("|".join(SKIPPED))


def alpha_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", "")) / F.greatest(F.length(text), F.lit(1))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def is_repetitive(text: Column) -> Column:
    w = words(text)
    return (F.size(w) > 10) & (F.size(F.array_distinct(w)) / F.size(w) < 0.3)


def section_quality(text: Column, cfg: Settings = DEFAULT) -> Column:
    """0 for an empty section, else a product of penalties for shortness, few letters and repetition."""
    n = F.length(text)
    short = F.when(n < cfg.min_section, 0.5).when(n < 2 * cfg.min_section, 0.8).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(short * F.when(alpha_ratio(text) < 0.5, 0.6).otherwise(1.0) * F.when(is_repetitive(text), 0.5).otherwise(1.0))


def chunk_problem(text: Column, cfg: Settings = DEFAULT) -> Column:
    """Why a chunk is not worth keeping; null if it is."""
    return F.when(F.length(strip(text)) < cfg.min_chunk, "Chunk too short").when(alpha_ratio(text) < 0.5, "Too few alphabetic characters").when(is_repetitive(text), "Too repetitive")


def overlap_tail(text: Column, cfg: Settings = DEFAULT) -> Column:
    """The end of a chunk that the next one starts with: from the first word that begins in it."""
    tail = F.right(text, F.lit(cfg.overlap))
    at = F.instr(tail, " ")
    return F.when(F.length(text) <= cfg.overlap, "").when(at > 1, F.substr(tail, at + 1)).otherwise(tail)


def slug(text: Column, size: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s-]", ""), r"[\s-]+", "_"), 1, size)
