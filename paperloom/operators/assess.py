"""Originality: sentence overlaps with papers, their maxima, labels, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import DEFAULT, Settings
from paperloom.functions import answers as AN
from paperloom.functions import scores as S
from paperloom.functions import text as T


#: Bigrams of sentences in one broadcast.
BROADCAST_BIGRAMS = 200_000


def idea_sentences(ideas: DataFrame) -> DataFrame:
    """ideas(idea_id, text) -> (idea_id, sentence_index, sentence)."""
    return ideas.select("idea_id", F.posexplode_outer(T.idea_sentences(F.col("text"))).alias("sentence_index", "sentence")).where("sentence is not null")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words (letters and digits, lower case)."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    n = F.size(w)
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def lexical_overlaps(sentences: DataFrame, papers: DataFrame) -> DataFrame:
    """(idea_id, sentence_index, paper_id, overlap): the share of a sentence's bigrams that the paper holds; 0 has no row.

    The sentences are a stated set of questions to all papers: their bigrams are broadcast, at most BROADCAST_BIGRAMS at a time, to
    where the papers lie, so no bigram's papers meet in one task, and what is shuffled are partial counts.  The stand-in for a
    language model's judgement.
    """
    s = sentences.select("idea_id", "sentence_index", bigrams(F.col("sentence")).alias("g")).select("idea_id", "sentence_index", F.size("g").alias("n"), F.explode_outer("g").alias("b")).where("b is not null")
    p = papers.select("paper_id", F.explode_outer(bigrams(F.col("text"))).alias("b")).where("b is not null")
    slices, shared = max(1, -(-s.count() // BROADCAST_BIGRAMS)), None
    for i in range(slices):
        mine = s if slices == 1 else s.where(F.pmod(F.xxhash64("b"), F.lit(slices)) == i)
        part = p.join(F.broadcast(mine), "b").groupBy("idea_id", "sentence_index", "paper_id", "n").agg(F.count("*").alias("c"))
        shared = part if shared is None else shared.unionByName(part)
    if slices > 1:
        shared = shared.groupBy("idea_id", "sentence_index", "paper_id", "n").agg(F.sum("c").alias("c"))
    return shared.select("idea_id", "sentence_index", "paper_id", F.round(F.col("c") / F.col("n"), 6).alias("overlap"))


def candidates(sentences: DataFrame, overlaps: DataFrame, k: int = DEFAULT.max_papers) -> DataFrame:
    """The ``k`` papers of each idea with the highest mean overlap over all its sentences; ties to the smaller id."""
    from pyspark.sql import Window

    n = sentences.groupBy("idea_id").agg(F.count("*").alias("n"))
    mean = overlaps.groupBy("idea_id", "paper_id").agg(F.sum(S.whole(F.col("overlap"))).alias("total")).join(n, "idea_id").select("idea_id", "paper_id", S.millionths(F.col("total"), F.col("n")).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("idea_id").orderBy(F.desc("mean"), "paper_id"))
    return mean.withColumn("paper_pos", rank).where(F.col("paper_pos") <= k)


def completed(sentences: DataFrame, analyses: DataFrame, papers: DataFrame) -> DataFrame:
    """One row for every sentence and candidate paper of its idea; sentences without analysis overlap by 0."""
    every = sentences.join(papers.select("idea_id", "paper_id", "paper_pos"), "idea_id")
    return every.join(analyses, ["idea_id", "sentence_index", "paper_id"], "left").select("idea_id", "paper_id", "paper_pos", "sentence_index", "sentence", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def annotations(sentences: DataFrame, layer1: DataFrame, most: int = 5) -> DataFrame:
    """Each sentence's maximum over papers, its label, and its best matches, by overlap, then the papers' order."""
    found = layer1.where("overlap > 0")
    best = found.groupBy("idea_id", "sentence_index").agg(F.max("overlap").alias("overlap"), F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("minus"), "paper_pos", "paper_id"))).alias("m"))
    all_ = sentences.join(best, ["idea_id", "sentence_index"], "left")
    o = F.coalesce("overlap", F.lit(0.0))
    linked = F.coalesce(F.array_join(F.transform(F.slice("m", 1, most), lambda x: x["paper_id"].cast("string")), ","), F.lit(""))
    return all_.select("idea_id", "sentence_index", "sentence", o.alias("overlap_score"), F.round(1 - o, 6).alias("originality_score"), S.overlap_label(o).alias("label"), linked.alias("linked"))


def assessments(ideas: DataFrame, annotated: DataFrame, papers: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """One row per idea.  Without papers or sentences: score 100, label high, overlap 0."""
    per = annotated.groupBy("idea_id").agg(S.millionths(F.sum(S.whole(F.col("overlap_score"))), F.count("overlap_score")).alias("o"), F.count_if(F.col("label") == "low").alias("red"), F.count_if(F.col("label") == "medium").alias("yellow"), F.count_if(F.col("label") == "high").alias("green"))
    n = papers.groupBy("idea_id").agg(F.count("*").alias("n"))
    j = ideas.select("idea_id").join(per, "idea_id", "left").join(n, "idea_id", "left")
    o = F.coalesce("o", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("idea_id", S.originality(o).alias("score"), o.alias("overlap"), S.score_label(S.originality(o), cfg).alias("label"), zero("red"), zero("yellow"), zero("green"), F.coalesce("n", F.lit(0)).alias("papers_analyzed"))


def assess(ideas: DataFrame, corpus: DataFrame, cfg: Settings = DEFAULT) -> dict[str, DataFrame]:
    """All stages for ideas(idea_id, text) against corpus(paper_id, text): a lazy DataFrame for each."""
    s = idea_sentences(ideas)
    o = lexical_overlaps(s, corpus)
    c = candidates(s, o, cfg.max_papers)
    layer1 = completed(s, o, c)
    a = annotations(s, layer1)
    return {"sentences": s, "overlaps": o, "papers": c, "layer1": layer1, "annotations": a, "assessments": assessments(ideas, a, c, cfg)}


def reality(raw: DataFrame) -> DataFrame:
    """raw(id, json) -> what a reality check says, with defaults for what is missing; an answer that is no JSON object has failed.

    Values that have the wrong type count as missing, one by one; examples that are no objects are left out.
    """
    r = raw.select("id", AN.parsed(F.col("json")).alias("v"))
    example = lambda e: F.struct(AN.text(e, "$.name").alias("name"), AN.number(e, "$.similarity").alias("similarity"), AN.text(e, "$.description").alias("description"))
    r = r.select("id", "v", F.transform(AN.objects(F.col("v"), "$.existing_examples"), example).alias("e"), (~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))).alias("failed"))
    # Fixed values below: what stands in for a missing assessment and advice.
    best = F.coalesce(F.array_max(F.transform("e", lambda e: F.coalesce(e["similarity"], F.lit(0.0)))), F.lit(0.0))
    return r.select(
        "id", F.coalesce(AN.flag(F.col("v"), "$.already_exists"), F.lit(False)).alias("already_exists"), F.coalesce(AN.number(F.col("v"), "$.confidence"), F.lit(0.0)).alias("confidence"), best.alias("max_similarity"),
        F.try_element_at("e", F.lit(1)).alias("top_example"), F.size("e").alias("n_examples"),
        F.when(F.col("failed"), "Unable to perform reality check. Proceeding with paper analysis.").otherwise(F.coalesce(AN.text(F.col("v"), "$.assessment"), F.lit(""))).alias("assessment"),
        F.when(F.col("failed"), "Consider manually verifying if similar products/research exist.").otherwise(F.coalesce(AN.text(F.col("v"), "$.recommendation"), F.lit("Consider what makes your approach unique."))).alias("recommendation"),
    )


def report(ideas: DataFrame, assessed: DataFrame, annotated: DataFrame) -> DataFrame:
    """(idea_id, report): score, summary and a line for each sentence, as Markdown.  Criteria that ``assessed`` lacks count as 0."""
    line = F.format_string("- [%s] %s (%d%% overlap)", "label", "sentence", F.floor(F.col("overlap_score") * 100 + 0.5).cast("int"))
    lines = annotated.groupBy("idea_id").agg(F.sort_array(F.collect_list(F.struct("sentence_index", line.alias("l")))).alias("p"))
    told = F.when(F.col("papers_analyzed") == 0, S.NO_PAPERS).otherwise(S.summary(F.col("score"), [F.col(n) if n in assessed.columns else F.lit(0.0) for n, _ in S.CRITERIA], F.col("red"), F.col("yellow"), F.col("green")))
    j = ideas.select("idea_id").join(assessed, "idea_id").join(lines, "idea_id", "left")
    body = F.coalesce(F.array_join(F.transform("p", lambda x: x["l"]), "\n"), F.lit(""))
    return j.select("idea_id", F.concat(F.lit("# Originality: "), F.col("score").cast("string"), F.lit("/100\n\n"), told, F.lit("\n\n"), body).alias("report"))


def enriched(idea: Column, pairs: Column) -> Column:
    """An idea with its questions and answers; ``pairs``: array<struct<category, question, answer>>."""
    block = F.transform(pairs, lambda x: F.concat(F.lit("\n["), F.upper(F.coalesce(x["category"], F.lit("general"))), F.lit("]\nQ: "), F.coalesce(x["question"], F.lit("")), F.lit("\nA: "), F.coalesce(x["answer"], F.lit("")), F.lit("\n")))
    return T.strip(F.concat(F.lit("RESEARCH IDEA:\n"), idea, F.lit("\n\nCLARIFICATIONS:\n"), F.array_join(block, "")))
