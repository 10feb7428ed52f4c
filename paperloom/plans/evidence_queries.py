"""Queries of the evidence operators, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.config import DEFAULT as CFG
from paperloom.functions import prompts as PR
from paperloom.functions import text as T
from paperloom.operators import chunks as C
from paperloom.operators import evidence as E
from paperloom.operators import papers as P
from paperloom.operators import retrieval as R
from paperloom.operators import sections as SEC
from paperloom.plans import queries as Q
from paperloom.sources import files
from paperloom.plans.queries import _bodies, _hits, _marked, _md5, _t, _vectors, query, sentences_sql

# --- prompts and answers -------------------------------------------------------------------------------------------------

IDEA = "A new graph index. It is faster than others! Does it scale? We think so."
PROMPT = rf"""with i as (select '{IDEA}' as idea, {sentences_sql(f"'{IDEA}'", 10)} as s
), n as (select idea, array_to_string(list_transform(s, lambda x, k: '[' || (k - 1) || '] ' || x), chr(10)) as numbered from i
), d as (select *, '[' || source || ']' || chr(10) || left(text, 800) as context, case when length(text) >= 200 then chr(10) || '### Body' || chr(10) || left(text, 1500) || '...' || chr(10) else '' end as told from documents)
select doc_id, md5('# Idea' || chr(10) || idea || chr(10) || chr(10) || '# Its sentences' || chr(10) || numbered || chr(10) || chr(10) || '# Paper' || chr(10) || 'id: ' || doc_id || chr(10) || 'arxiv: ' || chr(10) || 'title: ' || source || chr(10) || 'categories: ' || lang || ', cs' || chr(10) || chr(10) || '## Abstract' || chr(10) || left(text, 100) || chr(10) || chr(10) || '## Sections' || chr(10)
  || case when told <> '' then told when context <> '' then context else 'No sections extracted' end || chr(10) || chr(10) || '# Wanted' || chr(10) || 'JSON: criteria_scores, overall_overlap_score, and for every sentence of the idea its overlap_score and matched_sections.') as digest from d, n"""


@query(PROMPT)
def analysis_prompt(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    paper = F.struct(F.col("doc_id").cast("string").alias("paper_id"), F.lit(None).cast("string").alias("arxiv_id"), F.col("source").alias("title"), F.array("lang", F.lit("cs")).alias("categories"), F.substring("text", 1, 100).alias("abstract"))
    body = F.array(F.struct(F.lit("Body").alias("text"), F.col("text").alias("section_text"), (F.length("text") >= CFG.min_section).alias("is_valid")))
    context = F.concat(F.lit("["), F.col("source"), F.lit("]\n"), F.substring("text", 1, PR.CONTEXT_CHARS))
    return d.select("doc_id", _md5(PR.analysis(F.lit(IDEA), T.idea_sentences(F.lit(IDEA)), paper, body, context)).alias("digest"))


WORDS4 = r"list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^\p{{L}}]+')), lambda w: length(w) >= 4)"


@query(rf"""with {Q.SECTIONS}, pair as (
  select s.paper_id, s.heading_index, s.text, lead(s.text) over (partition by s.paper_id order by s.heading_index) as nxt, len(list_intersect({WORDS4.format('s.section_text')}, {WORDS4.format('b.text')})) as shared
  from sections s join benchmark b on b.item_id = s.paper_id % (select count(*) from benchmark)
), top as (select *, row_number() over (partition by paper_id order by shared desc, heading_index) as r from pair where shared > 0 and not regexp_matches(lower(text), 'introduction|conclusion')
), isle as (select *, heading_index - row_number() over (partition by paper_id order by heading_index) as island from top where r <= 3)
select paper_id, upper(replace(arg_min(text, heading_index), 'ß', 'ss')) as from_heading, nullif(upper(replace(arg_max(coalesce(nxt, chr(0)), heading_index), 'ß', 'ss')), chr(0)) as to_heading from isle group by paper_id, island""")
def heading_selector(spark, sf_dir):
    ideas = _t(spark, sf_dir, "benchmark")
    n = ideas.agg(F.count("*")).scalar()
    sections = SEC.sections(_marked(spark, sf_dir))
    pairs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % n).alias("item_id")).join(ideas, "item_id").select("paper_id", F.col("text").alias("idea"))
    return E.selected_intervals(sections, pairs)


# --- criteria, matches, labels -------------------------------------------------------------------------------------------


def _answers(spark, sf_dir):
    """Answers of a model, one for each labelled document: its quality and flags play the scores.

    By the last digit of the document's number something is wrong with them: 9 is no JSON, 8 tells a number as text, 7 and 6 have a
    branch of another shape, 5 a word for a number, 4 a key too many.
    """
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    fault = F.col("doc_id") % 10
    match = F.array(F.struct(F.col("source").alias("heading"), ((F.col("doc_id") % 100) / 100).alias("similarity"), F.col("lang").alias("reason")))
    entry = lambda overlap: F.struct((F.col("doc_id") % 3).cast("int").alias("sentence_index"), overlap.alias("overlap_score"), match.alias("matched_sections"))
    scores = lambda problem: F.struct(problem.alias("problem_similarity"), F.col("toxic").cast("double").alias("method_similarity"), (F.col("quality") * 0.5).alias("domain_overlap"))
    told = lambda criteria, level, *more: F.to_json(F.struct(criteria.alias("criteria_scores"), level.alias("sentence_level"), *more))
    problem, overlap = F.col("quality").cast("double"), F.col("quality") * 0.5
    answer = (
        F.when(fault == 9, "no json").when(fault == 8, told(scores(problem.cast("string")), F.array(entry(overlap)))).when(fault == 7, told(F.array(scores(problem)), F.array(entry(overlap))))
        .when(fault == 6, told(scores(problem), entry(overlap))).when(fault == 5, told(scores(problem), F.array(entry(F.lit("high"))))).when(fault == 4, told(scores(problem), F.array(entry(overlap)), F.lit("hm").alias("thoughts")))
        .otherwise(told(scores(problem), F.array(entry(overlap))))
    )
    return j.select((F.col("doc_id") % 20).alias("idea_id"), F.col("doc_id").alias("paper_id"), F.col("doc_id").alias("paper_pos"), answer.alias("json"))


ANSWERS = "ans as (select doc_id % 20 as idea_id, doc_id as paper_id, case when doc_id % 10 in (7, 9) then 0 else quality end as problem, case when doc_id % 10 in (7, 9) then 0 else toxic end as method, case when doc_id % 10 in (5, 6, 9) then 0 else quality * 0.5::double end as overlap, doc_id % 3 as k, (doc_id % 100) / 100.0::double as sim, source, lang, doc_id % 10 in (6, 9) as broken from labels join documents using (doc_id))"


@query(f"with {ANSWERS} select idea_id, round(avg(problem), 6) as problem_similarity, round(avg(method), 6) as method_similarity, round(avg(problem * 0.5::double), 6) as domain_overlap, 0.0::double as contribution_similarity, count(*) as papers_analyzed from ans group by idea_id")
def criteria_mean(spark, sf_dir):
    return E.criteria(_answers(spark, sf_dir))


@query(f"with {ANSWERS} select idea_id, paper_id, problem::double as problem_similarity, method::double as method_similarity, problem * 0.5::double as domain_overlap, 0.0::double as contribution_similarity, (problem * 1.5::double + method) / 4 as overall, case when not broken then k end::int as sentence_index, case when not broken then overlap end as overlap, case when broken then 0 else 1 end::int as n_matches from ans")
def layer1_parse(spark, sf_dir):
    return E.analyses(_answers(spark, sf_dir))


THREE = [(k, f"Sentence number {k}.") for k in range(3)]
LINKED = f"""with {ANSWERS}, every as (select a.idea_id, a.paper_id, s.k as sentence_index, case when not broken and a.k = s.k then a.overlap else 0.0::double end as overlap, not broken and a.k = s.k as hit, sim, source, lang from ans a, (select unnest(range(3)) as k) s
), best as (select idea_id, sentence_index, max(overlap) as o from every group by all
), ranked as (select *, row_number() over (partition by idea_id, sentence_index order by sim desc, paper_id) as r from every where hit
), told as (select idea_id, sentence_index, string_agg(paper_id || '/' || source || '/' || lang || '/' || printf('%.2f', sim), ';' order by r) as linked from ranked where r <= 5 group by all)
select idea_id, sentence_index::int as sentence_index, o as overlap_score, round(1 - o, 6) as originality_score, case when o >= 0.7 then 'low' when o >= 0.4 then 'medium' else 'high' end as label, coalesce(linked, '') as linked from best left join told using (idea_id, sentence_index)"""


@query(LINKED)
def linked_sections(spark, sf_dir):
    raw = _answers(spark, sf_dir)
    three = F.array(*(F.struct(F.lit(k).alias("sentence_index"), F.lit(s).alias("sentence")) for k, s in THREE))
    rows = E.sentence_rows(raw, raw.select("idea_id").distinct().select("idea_id", F.inline(three)))
    told = F.transform("linked_sections", lambda m: F.concat_ws("/", m["paper_id"].cast("string"), m["heading"], m["reason"], F.format_string("%.2f", m["similarity"])))
    return E.linked_sections(rows).withColumn("linked", F.array_join(told, ";")).drop("linked_sections")


@query(f"with {Q.OVERLAPS} select idea_id, label, md5(string_agg(sentence, '|' order by sentence_index)) as digest from ann group by idea_id, label")
def sentences_by_label(spark, sf_dir):
    return E.by_label(Q._assess(spark, sf_dir)["annotations"]).select("idea_id", "label", _md5(F.array_join("sentences", "|")).alias("digest"))


# --- costs, statistics, contexts -----------------------------------------------------------------------------------------

TOKENS = "value * {0}::double / 1e6 * 0.075::double + value * (1::double - {0}::double) / 1e6 * 0.3::double"
STAGES = "case event_type when 'view' then 'layer1' when 'click' then 'layer2' else 'followup' end"


def _paid(stage: str, share: float) -> str:
    return f"coalesce(sum(case when stage = '{stage}' then {TOKENS.format(share)} end), 0)"


@query(f"with u as (select user_id as run_id, {STAGES} as stage, value from events) select run_id, round({_paid('followup', 0.7)}, 9) as followup, 0.001::double as keywords, round({_paid('layer1', 0.8)}, 9) as layer1, round({_paid('layer2', 0.7)}, 9) as layer2, round({_paid('followup', 0.7)} + 0.001::double + {_paid('layer1', 0.8)} + {_paid('layer2', 0.7)}, 9) as total, count(*) filter (stage = 'layer1') as papers from u group by run_id")
def stage_costs(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "layer1").when(F.col("event_type") == "click", "layer2").otherwise("followup")
    return E.stage_costs(_t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), stage.alias("stage"), F.col("value").alias("tokens")))


@query(f"with recursive {Q.CHUNKS} select paper_id, md5(string_agg('[Body]' || chr(10) || left(text, 800), chr(10) || chr(10) order by chunk_index)) as digest from chunks where chunk_index < 5 group by paper_id")
def paper_context(spark, sf_dir):
    return E.paper_context(C.chunks(_bodies(spark, sf_dir)).withColumn("heading", F.lit("Body"))).select("paper_id", _md5("context").alias("digest"))


@query(f"with recursive {Q.CHUNKS} select printf('%s_h00_c%02d', paper_id::varchar, chunk_index) as id, paper_id, source as paper_title, lang || ',x' as categories, chunk_index::int as chunk_index, md5(c.text || left(d.text, 500)) as digest from chunks c join documents d on d.doc_id = c.paper_id where is_valid")
def store_rows(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    papers = d.select(F.col("doc_id").alias("paper_id"), F.lit("").alias("arxiv_id"), F.col("source").alias("title"), F.array("lang", F.lit("x")).alias("categories"), F.col("text").alias("abstract"))
    rows = files.index_rows(C.chunks(_bodies(spark, sf_dir)).withColumn("heading", F.lit("Body")), papers, F.array(F.lit(0.0)))
    return rows.select("id", "paper_id", "paper_title", "categories", "chunk_index", _md5(F.concat("text", "abstract")).alias("digest"))


PAPERS = "papers as (select doc_id, source, length(text) >= 200 as is_processed, case when lang = 'fr' then 'failed' end as processing_error from documents)"


def _read_papers(spark, sf_dir):
    error = F.when(F.col("lang") == "fr", "failed")
    return _t(spark, sf_dir, "documents").select("doc_id", "source", (F.length("text") >= CFG.min_section).alias("is_processed"), error.alias("processing_error"))


@query(f"with {PAPERS} select doc_id, source from papers where is_processed and processing_error is null")
def processed_papers(spark, sf_dir):
    return E.processed(_read_papers(spark, sf_dir)).select("doc_id", "source")


@query(f"with recursive {Q.CHUNKS}, {Q.HITS}, {PAPERS} select (select count(*) from hits) as papers_found, (select count(*) from papers) as papers_analyzed, (select count(*) from papers where is_processed) as papers_processed, (select count(*) from chunks where is_valid) as total_chunks, (select md5(string_agg(distinct phrase, ',' order by phrase)) from keyphrases) as keywords")
def pipeline_stats(spark, sf_dir):
    phrases = files.stored(Q._keyphrases(spark, sf_dir))
    words = phrases.withColumnRenamed("phrase", "word")
    out = E.statistics(P.ranked_hits(phrases, Q._index(spark, sf_dir)), _read_papers(spark, sf_dir), C.chunks(_bodies(spark, sf_dir)).where("is_valid"), words)
    return out.withColumn("keywords", _md5("keywords"))


@query("select source as topic, count(*) as n from documents group by source")
def topic_counts(spark, sf_dir):
    return E.per_topic(_t(spark, sf_dir, "documents").select(F.col("source").alias("topic")))


@query(f"with {Q.PAIRS}, {Q.RANKED.format('')} select query_id, id, rank::int as rank from ranked where rank <= 5")
def results_without_scores(spark, sf_dir):
    q, s = _vectors(spark, sf_dir)
    return E.without_scores(R.top_k(q.drop("label"), s, 5))


@query("select doc_id // 10 as paper, md5(string_agg(chr(10) || '===== doc_' || doc_id || '.txt =====' || chr(10) || text, chr(10) order by 'doc_' || doc_id || '.txt')) as digest from documents group by 1")
def dump_banners(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("paper"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return d.groupBy("paper").agg(files.joined_dumps(d).alias("t")).select("paper", _md5("t").alias("digest"))
