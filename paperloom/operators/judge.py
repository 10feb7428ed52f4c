"""A judge of papers: an idea's sentences aligned with a paper's sections, told in the form a language model would answer in.

What it finds for an idea and a paper is one JSON answer with criteria, an overall overlap and, for each sentence, its overlap and
the sections it matches, so that everything after it is the same for a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings
from paperloom.functions import alignment as AL
from paperloom.functions import prompts as PR
from paperloom.functions import scores as S
from paperloom.operators import assess as A
from paperloom.operators import evidence as E
from paperloom.operators import papers as P
from paperloom.operators import search as SE

#: Headings that tell which criterion a section speaks to, in turn; sections of other headings speak to the domain.
KINDS = (
    ("problem_similarity", "introduction|background|motivation|problem"),
    ("method_similarity", "method|approach|model|algorithm|architecture|implementation|design"),
    ("contribution_similarity", "result|conclusion|contribution|discussion|evaluation|experiment|summary"),
)
#: Matched sections told for a sentence, the least overlap of one, and overlap from which an idea counts as existing already.
MATCHES, LEAST, EXISTS = 3, 0.3, 0.8


def kind(heading: Column) -> Column:
    out = F.lit("domain_overlap")
    for name, words in reversed(KINDS):
        out = F.when(F.lower(F.coalesce(heading, F.lit(""))).rlike(words), name).otherwise(out)
    return out


def weighed_sentences(sentences: DataFrame, index: SE.Index) -> DataFrame:
    """sentences(idea_id, sentence_index, sentence) -> one row for each idea: its sentences with their words and the words' rarity.

    A word that no indexed text holds weighs as much as one that a single text holds.
    """
    told = sentences.select("idea_id", "sentence_index", F.posexplode_outer(SE.words(F.col("sentence"))).alias("at", "term"))
    weight = F.coalesce("rarity", F.lit(float(np.log(1 + (max(index.documents, 1) - 0.5) / 1.5))))
    known = told.join(SE.rarities(told.select("term").where("term is not null").distinct(), index), "term", "left")
    word = F.struct("at", F.coalesce("term", F.lit("")).alias("term"), F.round(weight, 6).alias("weight"))
    each = known.groupBy("idea_id", "sentence_index").agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), word))).alias("words"))
    return each.groupBy("idea_id").agg(F.sort_array(F.collect_list(F.struct("sentence_index", "words"))).alias("sentences"))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("sentence_index", pa.int32()), ("overlap", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = []
        for sentences, text in zip(batch.column("sentences").to_pylist(), batch.column("w").to_pylist(), strict=True):
            number: dict[str, int] = {}
            own = [np.array([number.setdefault(w["term"], len(number)) for w in s["words"]], dtype=np.int64) for s in sentences]
            section = np.array([number.get(w, -1) for w in text], dtype=np.int64)
            rows = []
            for s, ids in zip(sentences, own, strict=True):
                weight = np.array([w["weight"] for w in s["words"]])
                score, start, stop = AL.align(ids, weight, section)
                rows.append({"sentence_index": s["sentence_index"], "overlap": round(score / weight.sum(), 6) if score else 0.0, "start": start, "stop": stop})
            out.append(rows)
        keep = [n for n in batch.schema.names if n not in ("sentences", "w")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, kinds)], [*keep, "found"])


def section_overlaps(ideas: DataFrame, papers: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each sentence and section of a paper of its idea: how much of the sentence the section holds, and where.

    ideas: ``weighed_sentences``; papers(idea_id, paper_id, paper_pos); sections(paper_id, heading_index, text, section_text).  Work is
    a row's own, an idea against one section of one of its papers; sections of a paper that many ideas share are not gathered.
    """
    s = sections.select("paper_id", "heading_index", F.coalesce("text", F.lit("")).alias("heading"), SE.words(F.col("section_text")).alias("w"))
    rows = papers.select("idea_id", "paper_id", "paper_pos").join(ideas, "idea_id").join(s, "paper_id").select("idea_id", "paper_id", "paper_pos", "heading_index", "heading", "sentences", "w")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("sentences", "w"))
    found = rows.mapInArrow(_aligned, f"{fields}, found array<struct<sentence_index:int, overlap:double, start:int, stop:int>>")
    each = found.select("idea_id", "paper_id", "paper_pos", "heading_index", "heading", kind(F.col("heading")).alias("kind"), F.explode_outer("found").alias("f")).where("f is not null")
    return each.select("idea_id", "paper_id", "paper_pos", "heading_index", "heading", "kind", "f.sentence_index", "f.overlap", "f.start", "f.stop")


def answers(papers: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(idea_id, paper_id, paper_pos, json): an answer for every paper; one without sections has zeros and no sentence.

    A criterion is the mean, over the idea's sentences, of the best overlap in sections of its kind; the overall overlap that of the best
    in any section.  A sentence's matched sections are those with LEAST or more of it, at most MATCHES, best first.
    """
    best = lambda name: F.coalesce(F.max(F.when(F.col("kind") == name, F.col("overlap"))), F.lit(0.0)).alias(name)
    match = F.when(F.col("overlap") >= LEAST, F.struct((-F.col("overlap")).alias("less"), "heading_index", "heading", "start", "stop"))
    names = [name for name, _ in S.CRITERIA]
    each = overlaps.groupBy("idea_id", "paper_id", "sentence_index").agg(F.max("overlap").alias("overlap"), *(best(n) for n in names), F.slice(F.sort_array(F.collect_list(match)), 1, MATCHES).alias("m"))
    reason = lambda x: F.format_string("Words %d to %d of the section align with the sentence.", x["start"] + 1, x["stop"])
    matched = F.transform("m", lambda x: F.struct(x["heading"].alias("heading"), (-x["less"]).alias("similarity"), reason(x).alias("reason")))
    sentence = F.struct("sentence_index", F.col("overlap").alias("overlap_score"), matched.alias("matched_sections"))
    mean = lambda c: F.round(F.avg(c), 6)
    told = each.groupBy("idea_id", "paper_id").agg(F.struct(*(mean(n).alias(n) for n in names)).alias("criteria_scores"), mean("overlap").alias("overall_overlap_score"), F.sort_array(F.collect_list(sentence)).alias("sentence_level"))
    full = papers.select("idea_id", "paper_id", "paper_pos").join(told, ["idea_id", "paper_id"], "left")
    zeros = F.lit("{" + '"criteria_scores":{' + ",".join(f'"{n}":0.0' for n in names) + '},"overall_overlap_score":0.0,"sentence_level":[]}')
    return full.select("idea_id", "paper_id", "paper_pos", F.when(F.col("sentence_level").isNotNull(), F.to_json(F.struct("criteria_scores", "overall_overlap_score", "sentence_level"))).otherwise(zeros).alias("json"))


def reality(raw: DataFrame) -> DataFrame:
    """(id, json) of a check whether an idea exists already: the paper that holds most of it, from EXISTS on as an example."""
    overall = F.coalesce(F.get_json_object("json", "$.overall_overlap_score").cast("double"), F.lit(0.0))
    top = raw.groupBy("idea_id").agg(F.min(F.struct((-overall).alias("less"), "paper_pos", "paper_id")).alias("t"))
    most, name = -F.col("t.less"), F.concat(F.lit("paper "), F.col("t.paper_id").cast("string"))
    example = F.when(most >= EXISTS, F.array(F.struct(name.alias("name"), most.alias("similarity")))).otherwise(F.array().cast("array<struct<name:string,similarity:double>>"))
    said = F.struct((most >= EXISTS).alias("already_exists"), most.alias("confidence"), example.alias("existing_examples"), F.format_string("%.0f%% of the idea stands in one paper.", most * 100).alias("assessment"), F.lit("Say what the paper does not.").alias("recommendation"))
    return top.select(F.col("idea_id").alias("id"), F.to_json(said).alias("json"))


def novelty(ideas: DataFrame, corpus: DataFrame, sections_of, index: SE.Index, keep=lambda df, name: df, cfg: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Everything from ideas(idea_id, text) to their assessment against corpus(doc_id, text), indexed as ``index``.

    Key phrases, ranked hits, the first of each paper, the ``max_papers`` first of these, their sections (``sections_of`` makes them of
    (paper_id, text)), the judge's answers, and from these sentence rows with linked sections, criteria, score, reality check, summary,
    warning and cost.  ``keep(frame, name)`` stores what several later stages read.  Ideas without sentences or papers score 100 with zeros.
    """
    sentences = keep(A.idea_sentences(ideas), "sentences")
    phrases = keep(P.keyphrases(ideas, corpus), "phrases")
    hits = keep(P.ranked_hits(phrases, index), "hits")
    papers = keep(P.selected(P.first_hits(hits), cfg.max_papers).select("idea_id", F.col("doc_id").alias("paper_id"), "paper_pos", "search_keyword"), "papers")
    texts = corpus.select(F.col("doc_id").alias("paper_id"), "text").join(papers.select("paper_id").distinct(), "paper_id", "left_semi")
    sections = keep(sections_of(texts), "sections")
    overlaps = keep(section_overlaps(weighed_sentences(sentences, index), papers, sections), "overlaps")
    raw = keep(answers(papers, overlaps), "answers")
    rows = E.sentence_rows(raw, sentences)
    linked = keep(E.linked_sections(rows), "linked")
    criteria = E.criteria(raw)
    annotated = sentences.join(linked, ["idea_id", "sentence_index"], "left").select("idea_id", "sentence_index", "sentence", F.coalesce("overlap_score", F.lit(0.0)).alias("overlap_score"), F.coalesce("originality_score", F.lit(1.0)).alias("originality_score"), F.coalesce("label", F.lit("high")).alias("label"), "linked_sections")
    scored = A.assessments(ideas, annotated, papers, cfg)
    # What a model would have read: the idea and, of each paper's valid sections, what a prompt shows of them; four characters a token.
    shown = sections.where("is_valid").groupBy("paper_id").agg(F.sum(F.least(F.length("section_text"), F.lit(PR.SECTION_CHARS))).alias("chars"))
    size = papers.join(shown, "paper_id", "left").join(ideas.select("idea_id", F.length("text").alias("own")), "idea_id")
    tokens = F.ceil((F.coalesce("chars", F.lit(0)) + F.coalesce("own", F.lit(0))) / 4)
    cost = size.groupBy("idea_id").agg(F.round(F.sum(S.token_cost(tokens, 0.8, cfg)) + cfg.keyword_cost, 9).alias("cost"))
    checked = A.reality(reality(raw)).withColumnRenamed("id", "idea_id")
    names = [name for name, _ in S.CRITERIA]
    j = scored.join(criteria.drop("papers_analyzed"), "idea_id", "left").join(checked, "idea_id", "left").join(cost, "idea_id", "left")
    j = j.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in names} | {"already_exists": F.coalesce("already_exists", F.lit(False))})
    final = F.coalesce(S.adjusted(F.col("score"), F.col("already_exists"), F.col("confidence"), F.col("max_similarity")), F.col("score"))
    summary = F.when(F.col("papers_analyzed") == 0, S.NO_PAPERS).otherwise(S.summary(F.col("score"), [F.col(n) for n in names], F.col("red"), F.col("yellow"), F.col("green")))
    told = E.checked_summary(summary, F.col("score"), final, F.col("top_example"))
    warning = S.warning(F.col("already_exists"), F.col("confidence"), F.col("top_example"), F.col("assessment"), F.col("recommendation"))
    assessed = j.select("idea_id", final.alias("score"), F.col("score").alias("unchecked_score"), "overlap", S.score_label(final, cfg).alias("label"), *names, "red", "yellow", "green", "papers_analyzed", F.coalesce("cost", F.lit(cfg.keyword_cost)).alias("cost"), told.alias("summary"), warning.alias("warning"))
    return {"sentences": sentences, "phrases": phrases, "hits": hits, "papers": papers, "sections": sections, "overlaps": overlaps, "answers": raw, "annotations": annotated, "assessments": assessed}
