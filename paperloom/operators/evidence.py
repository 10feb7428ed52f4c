"""Evidence for an assessment: criteria, linked sections, selected headings, contexts, costs and statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings
from paperloom.functions import answers as AN
from paperloom.functions import prompts as PR
from paperloom.functions import scores as S

_MATCHES = "array<struct<heading:string,similarity:double,reason:string>>"


def _criterion(name: str) -> Column:
    return F.coalesce(AN.number(F.col("v"), f"$.criteria_scores.{name}"), F.lit(0.0)).alias(name)


def criteria(raw: DataFrame) -> DataFrame:
    """raw(idea_id, paper_id, json): (idea_id, four criteria, papers_analyzed), each the mean over the idea's papers.

    An answer that cannot be read counts with zeros, as does a criterion that is missing or no number.
    """
    j = raw.select("idea_id", AN.parsed(F.col("json")).alias("v"))
    mean = lambda name: F.round(F.avg(_criterion(name)), 6).alias(name)
    return j.groupBy("idea_id").agg(*(mean(name) for name, _ in S.CRITERIA), F.count("*").alias("papers_analyzed"))


def _said(v: Column) -> Column:
    """array<struct<sentence_index, told, overlap, matched_sections>> of an answer; entries whose index is no number are left out."""
    match = lambda m: F.struct(AN.text(m, "$.heading").alias("heading"), AN.number(m, "$.similarity").alias("similarity"), AN.text(m, "$.reason").alias("reason"))
    entry = lambda s: F.struct(
        AN.whole(s, "$.sentence_index", 0).alias("sentence_index"), F.nullif(AN.text(s, "$.sentence"), F.lit("")).alias("told"), F.coalesce(AN.number(s, "$.overlap_score"), F.lit(0.0)).alias("overlap"), F.transform(AN.objects(s, "$.matched_sections"), match).alias("matched_sections"),
    )
    return F.filter(F.transform(AN.objects(v, "$.sentence_level"), entry), lambda s: s["sentence_index"].isNotNull())


def analyses(raw: DataFrame) -> DataFrame:
    """raw(idea_id, paper_id, json) -> (idea_id, paper_id, four criteria, overall, sentence_index, overlap, n_matches).

    One row for each sentence that an answer tells, or one without a sentence.  A missing overall is the mean of the criteria.
    """
    j = raw.select("idea_id", "paper_id", AN.parsed(F.col("json")).alias("v"))
    rows = j.select("idea_id", "paper_id", *(_criterion(name) for name, _ in S.CRITERIA), AN.number(F.col("v"), "$.overall_overlap_score").alias("told"), F.explode_outer(_said(F.col("v"))).alias("s"))
    names = [name for name, _ in S.CRITERIA]
    mean = sum(F.col(n) for n in names) / len(names)
    return rows.select("idea_id", "paper_id", *names, F.coalesce("told", mean).alias("overall"), "s.sentence_index", "s.overlap", F.coalesce(F.size("s.matched_sections"), F.lit(0)).alias("n_matches"))


def sentence_rows(raw: DataFrame, sentences: DataFrame) -> DataFrame:
    """raw(idea_id, paper_id, paper_pos, json) x sentences(idea_id, sentence_index, sentence): one row for each paper and sentence.

    Sentences that an answer leaves out overlap by 0 and match nothing; a missing sentence text is the idea's own.
    """
    j = raw.select("idea_id", "paper_id", "paper_pos", AN.parsed(F.col("json")).alias("v"))
    said = j.select("idea_id", "paper_id", F.explode_outer(_said(F.col("v"))).alias("s")).where("s is not null").select("idea_id", "paper_id", "s.*")
    every = j.select("idea_id", "paper_id", "paper_pos").join(sentences, "idea_id")
    full = every.join(said, ["idea_id", "paper_id", "sentence_index"], "left")
    return full.select("idea_id", "paper_id", "paper_pos", "sentence_index", F.coalesce("told", "sentence").alias("sentence"), F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.coalesce("matched_sections", F.array().cast(_MATCHES)).alias("matched_sections"))


def linked_sections(rows: DataFrame, most: int = 5) -> DataFrame:
    """For each sentence the largest overlap, its label, and its ``most`` best matches over all papers: array<struct<paper_id,
    heading, similarity, reason>>, by similarity, then in the papers' and the answers' order."""
    one = rows.select("idea_id", "sentence_index", "overlap", F.transform("matched_sections", lambda m, i: F.struct((-F.coalesce(m["similarity"], F.lit(0.0))).alias("minus"), F.col("paper_pos").alias("pos"), i.alias("i"), F.col("paper_id").alias("paper_id"), F.coalesce(m["heading"], F.lit("")).alias("heading"), F.coalesce(m["reason"], F.lit("")).alias("reason"))).alias("m"))
    best = one.groupBy("idea_id", "sentence_index").agg(F.max("overlap").alias("overlap"), F.slice(F.sort_array(F.flatten(F.collect_list("m"))), 1, most).alias("m"))
    linked = F.transform("m", lambda m: F.struct(m["paper_id"].alias("paper_id"), m["heading"].alias("heading"), (-m["minus"]).alias("similarity"), m["reason"].alias("reason")))
    return best.select("idea_id", "sentence_index", F.col("overlap").alias("overlap_score"), F.round(1 - F.col("overlap"), 6).alias("originality_score"), S.overlap_label(F.col("overlap")).alias("label"), linked.alias("linked_sections"))


def by_label(annotated: DataFrame) -> DataFrame:
    """The sentences of each label: (idea_id, label, sentences), in their order."""
    return annotated.groupBy("idea_id", "label").agg(F.sort_array(F.collect_list(F.struct("sentence_index", "sentence"))).alias("s")).select("idea_id", "label", F.transform("s", lambda x: x["sentence"]).alias("sentences"))


def selected_intervals(sections: DataFrame, ideas: DataFrame, most: int = 3) -> DataFrame:
    """(paper_id, from_heading, to_heading): the ``most`` sections that share most words with the idea, neighbours as one interval.

    sections(paper_id, heading_index, text, section_text), ideas(paper_id, idea).  Words have four letters or more.  Introductions
    and conclusions are not chosen, nor sections that share nothing; an interval goes up to before ``to_heading``, or to the end.
    The stand-in for a language model that names headings.
    """
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+")), lambda w: F.length(w) >= 4)
    paper = Window.partitionBy("paper_id").orderBy("heading_index")
    s = sections.withColumn("next", F.lead("text").over(paper)).join(ideas, "paper_id")
    s = s.withColumn("shared", F.size(F.array_intersect(words(F.col("section_text")), words(F.col("idea"))))).where((F.col("shared") > 0) & ~F.lower("text").rlike("introduction|conclusion"))
    best = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("shared"), "heading_index"))
    chosen = s.withColumn("r", best).where(F.col("r") <= most)
    island = chosen.withColumn("island", F.col("heading_index") - F.row_number().over(paper))
    ends = island.groupBy("paper_id", "island").agg(F.min_by("text", "heading_index").alias("f"), F.max_by(F.struct("next"), "heading_index").alias("t"))
    return ends.select("paper_id", F.upper("f").alias("from_heading"), F.upper("t.next").alias("to_heading"))


def paper_context(chunks: DataFrame, most: int = DEFAULT.top_k) -> DataFrame:
    """(paper_id, context) without a query: the first ``most`` chunks(paper_id, heading, chunk_index, text) of each paper."""
    piece = F.concat(F.lit("["), F.coalesce("heading", F.lit("Section")), F.lit("]\n"), F.substring("text", 1, PR.CONTEXT_CHARS))
    first = chunks.where(F.col("chunk_index") < most)
    return first.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", piece.alias("p")))).alias("p")).select("paper_id", F.array_join(F.transform("p", lambda x: x["p"]), "\n\n").alias("context"))


def processed(papers: DataFrame) -> DataFrame:
    """Papers that were read without an error: (.., is_processed, processing_error)."""
    return papers.where(F.col("is_processed") & F.col("processing_error").isNull())


def stage_costs(usage: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """usage(run_id, stage, tokens): cost in US dollars of each stage and in total, one row for each run.

    Layer 1 is summed over papers, four fifths of its tokens going in; of the other stages seven tenths go in.  Keywords cost a
    constant.  The total is of follow-up, keywords and the two layers.
    """
    cost = lambda stage, share: F.coalesce(F.sum(F.when(F.col("stage") == stage, S.token_cost(F.col("tokens"), share, cfg))), F.lit(0.0)).alias(stage)
    runs = usage.groupBy("run_id").agg(cost("followup", 0.7), cost("layer1", 0.8), cost("layer2", 0.7), F.count_if(F.col("stage") == "layer1").alias("papers"))
    total = F.col("followup") + cfg.keyword_cost + F.col("layer1") + F.col("layer2")
    dollars = lambda c: F.round(c, 9)
    return runs.select("run_id", dollars(F.col("followup")).alias("followup"), F.lit(cfg.keyword_cost).alias("keywords"), dollars(F.col("layer1")).alias("layer1"), dollars(F.col("layer2")).alias("layer2"), dollars(total).alias("total"), "papers")


def checked_summary(summary: Column, score: Column, adjusted: Column, example: Column) -> Column:
    """The summary after a reality check has changed the score; ``example``: struct<name> of the closest product, or null."""
    name = F.coalesce(example["name"], F.lit("existing products"))
    told = F.concat(F.lit("⚠️ This idea closely resembles "), name, F.lit(". "), summary, F.lit(" Score adjusted from "), score.cast("string"), F.lit(" to "), adjusted.cast("string"), F.lit(" due to existing similar products."))
    return F.when((score != adjusted) & example.isNotNull(), told).otherwise(summary)


def statistics(hits: DataFrame, papers: DataFrame, chunks: DataFrame, keywords: DataFrame) -> DataFrame:
    """One row: papers found, analysed and processed, chunks in the store, keywords."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    some = papers.agg(F.count("*").alias("papers_analyzed"), F.count_if("is_processed").alias("papers_processed"))
    words = keywords.agg(F.array_join(F.sort_array(F.collect_set("word")), ",").alias("keywords"))
    whole = n(hits, "papers_found").unionByName(some, True).unionByName(n(chunks, "total_chunks"), True).unionByName(words, True)
    return whole.agg(*(F.max(c).alias(c) for c in whole.columns))


class Watched:
    """Stores frames and counts them on the way: what ``count`` says of a frame comes with the pass that writes it, no pass is added.

    Tasks that are run again because an executor was lost are counted once where they write; a frame is observed as it is written.
    """

    def __init__(self, store: Callable[[DataFrame], DataFrame], **more: dict[str, Column]) -> None:
        self.store, self.more, self.seen = store, more, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.seen[name] = Observation(name)
        return self.store(df.observe(self.seen[name], F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in self.more.get(name, {}).items())))

    def row(self, spark: SparkSession) -> DataFrame:
        """One row: <name>_rows and <name>_<metric> of every frame that was stored."""
        told = {f"{name}_{k}": v for name, o in self.seen.items() for k, v in o.get.items()}
        return spark.createDataFrame([tuple(told.values())], list(told))


def per_topic(rows: DataFrame, topic: str = "topic") -> DataFrame:
    return rows.groupBy(topic).agg(F.count("*").alias("n"))


def html_records(entries: DataFrame, sections: DataFrame) -> DataFrame:
    """Papers that have a page, with its sections: entries(arxiv_id, title, ..., has_html), sections(arxiv_id, introduction,
    methodology, conclusion; null where the page could not be had, which leaves the paper out)."""
    found = sections.where("introduction is not null").select("arxiv_id", "introduction", "methodology", "conclusion")
    got = entries.where("has_html").join(found, "arxiv_id")
    page = F.regexp_replace("url", "/abs/", "/html/")
    return got.select("arxiv_id", "title", "authors", F.col("published_date").alias("published"), "updated", F.col("abstract").alias("summary"), page.alias("html_url"), F.struct("introduction", "methodology", "conclusion").alias("sections"))


def without_scores(hits: DataFrame, score: str = "similarity") -> DataFrame:
    """Search results as they are handed on when no scores are asked for."""
    return hits.drop(score)
