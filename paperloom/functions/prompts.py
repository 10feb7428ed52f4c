"""Prompts for text models and their answers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The questions that are asked when the model gives none that can be read.
DEFAULT_QUESTIONS = (
    (1, "problem", "What specific problem or research gap does your idea address?"),
    (2, "method", "What method or approach do you propose to solve this problem?"),
    (3, "novelty", "What aspect of your idea do you consider most innovative or novel?"),
)
#: Characters of a section and of a chunk that a prompt shows.
SECTION_CHARS, CONTEXT_CHARS = 1500, 800
_QUESTIONS = "array<struct<id:int,category:string,question:string>>"


def questions(answer: Column) -> Column:
    """array<struct<id, category, question>> from {"questions": [...]}: none if the list is missing, the default ones if the
    answer is null or no JSON object."""
    own = F.from_json(answer, f"struct<questions:{_QUESTIONS}>")
    readable = F.coalesce(F.get_json_object(answer, "$").startswith("{"), F.lit(False))
    default = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit(q).alias("question")) for i, c, q in DEFAULT_QUESTIONS))
    return F.when(readable, F.coalesce(own["questions"], F.array().cast(_QUESTIONS))).otherwise(default)


def intervals(answer: Column) -> Column:
    """array<struct<from_heading, to_heading>> from a JSON list or a single object; empty if it cannot be read."""
    kind = "struct<from_heading:string,to_heading:string>"
    listed = F.when(F.ltrim(answer).startswith("["), answer).otherwise(F.concat(F.lit("["), answer, F.lit("]")))
    found = F.from_json(listed, f"array<{kind}>")
    return F.coalesce(F.filter(found, lambda x: x["from_heading"].isNotNull()), F.array().cast(f"array<{kind}>"))


def numbered(sentences: Column) -> Column:
    return F.array_join(F.transform(sentences, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def excerpts(sections: Column) -> Column:
    """The valid ones of array<struct<text, section_text, is_valid>>, each under its heading and cut to SECTION_CHARS."""
    valid = F.filter(sections, lambda s: s["is_valid"] & (s["section_text"] != ""))
    return F.array_join(F.transform(valid, lambda s: F.concat(F.lit("\n### "), s["text"], F.lit("\n"), F.substring(s["section_text"], 1, SECTION_CHARS), F.lit("...\n"))), "")


def analysis(idea: Column, sentences: Column, paper: Column, sections: Column, context: Column) -> Column:
    """What a model is asked about one paper.  paper: struct<paper_id, arxiv_id, title, categories, abstract>.

    Sections come first; without a valid one the retrieved context stands in, and without that a note.
    """
    told = excerpts(sections)
    evidence = F.when(told != "", told).when(F.coalesce(context, F.lit("")) != "", context).otherwise("No sections extracted")
    line = lambda label, value: F.concat(F.lit(label), F.coalesce(value, F.lit("")), F.lit("\n"))
    return F.concat(
        F.lit("# Idea\n"), idea, F.lit("\n\n# Its sentences\n"), numbered(sentences), F.lit("\n\n# Paper\n"),
        line("id: ", paper["paper_id"]), line("arxiv: ", paper["arxiv_id"]), line("title: ", paper["title"]), line("categories: ", F.array_join(paper["categories"], ", ")),
        F.lit("\n## Abstract\n"), F.coalesce(paper["abstract"], F.lit("")), F.lit("\n\n## Sections\n"), evidence,
        F.lit("\n\n# Wanted\nJSON: criteria_scores, overall_overlap_score, and for every sentence of the idea its overlap_score and matched_sections."),
    )


def follow_up(idea: Column) -> Column:
    return F.concat(F.lit("Ask three questions about this idea that help to judge its originality (problem, method, novelty), as JSON.\n\n"), idea)


def report(idea: Column, papers: Column) -> Column:
    """What a model is asked for a report: the idea and the texts kept for its papers (array<string>)."""
    return F.concat(F.lit("Write a Markdown report on how new this idea is, from these papers alone.\n\n"), idea, F.lit("\n\n"), F.array_join(papers, "\n\n"))
