"""Queries over feeds, pages, headings and answers that are made of the tables, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import prompts as PR
from paperloom.functions import scores as S
from paperloom.functions import text as T
from paperloom.operators import assess as A
from paperloom.operators import evidence as E
from paperloom.plans.queries import _md5, _t, heading_sql, query, strip_sql
from paperloom.sources import atom, html_sections, pdf


def _joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# --- headings ------------------------------------------------------------------------------------------------------------

NUMBERS = ("1. ", "2.3  ", "IV. ", "(2) ", "1) ", "3", "A. ", "", "Part: ", "12 ", "XI.")


@query(f"with h as (select doc_id, {list(NUMBERS)}[doc_id % 11 + 1] || left(split_part(text, chr(10), 1), 40 + doc_id % 160) as h from documents) select doc_id, {heading_sql('h')} as cleaned from h")
def heading_clean(spark, sf_dir):
    head = F.concat(F.get(F.array(*map(F.lit, NUMBERS)), (F.col("doc_id") % 11).cast("int")), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(1), (40 + F.col("doc_id") % 160).cast("int")))
    return _t(spark, sf_dir, "documents").select("doc_id", head.alias("h")).select("doc_id", T.clean_heading(F.col("h")).alias("cleaned"))


@query("select doc_id, case doc_id % 4 when 0 then source || '>' || lang || ';DATA>' when 1 then lang || '>' || source else '' end as spans from documents")
def heading_intervals(spark, sf_dir):
    two = F.to_json(F.array(F.struct(F.col("source").alias("from_heading"), F.col("lang").alias("to_heading")), F.struct(F.lit("DATA").alias("from_heading"), F.lit(None).cast("string").alias("to_heading"))))
    one = F.to_json(F.struct(F.col("lang").alias("from_heading"), F.col("source").alias("to_heading")))
    answer = F.when(F.col("doc_id") % 4 == 0, two).when(F.col("doc_id") % 4 == 1, one).when(F.col("doc_id") % 4 == 2, "broken").otherwise(F.to_json(F.array(F.struct(F.col("lang").alias("to_heading")))))
    a = _t(spark, sf_dir, "documents").select("doc_id", PR.intervals(answer).alias("x"))
    return a.select("doc_id", F.array_join(F.transform("x", lambda s: F.concat(s["from_heading"], F.lit(">"), F.coalesce(s["to_heading"], F.lit("")))), ";").alias("spans"))


FIXED = " | ".join(f"{i}:{c}:{q}" for i, c, q in PR.DEFAULT_QUESTIONS)


@query(f"select conv_id, case conv_id % 5 when 1 then '{FIXED}' when 2 then '' when 3 then '{FIXED}' else string_agg(concat_ws(':', turn::varchar, role, text), ' | ' order by turn, role, text) end as asked from conversations group by conv_id")
def follow_up_questions(spark, sf_dir):
    each = F.struct(F.col("turn").alias("id"), F.col("role").alias("category"), F.col("text").alias("question"))
    c = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(each)).alias("questions"))).alias("j"))
    kind = F.col("conv_id") % 5
    answer = F.when(kind == 1, "no json").when(kind == 2, "{}").when(kind == 3, F.lit(None)).otherwise(F.col("j"))
    a = c.select("conv_id", PR.questions(answer).alias("q"))
    return a.select("conv_id", F.array_join(F.transform("q", lambda x: F.concat_ws(":", x["id"].cast("string"), x["category"], x["question"])), " | ").alias("asked"))


# --- feeds ---------------------------------------------------------------------------------------------------------------

WORDS = r"left(regexp_replace(text, '[^\p{L}\p{N}]+', ' ', 'g'), 60)"
#: Ten documents a feed, by number; some lack an id, links, categories or a date, and some feeds are cut off.
FEED_ROWS = rf"""f as (
  select *, doc_id // 10 as topic, doc_id // 10 % 17 = 3 as broken, doc_id % 11 = 5 as nameless, case when doc_id % 7 = 3 then 'weird-' || doc_id else doc_id || 'v1' end as arxiv_id, {WORDS} as w from documents
), e as (
  select doc_id, topic, arxiv_id, trim(regexp_replace(w || ' end', '\s+', ' ', 'g')) as title, case when doc_id % 4 <> 0 then lang else '' end as abstract,
    case when doc_id % 3 <> 0 then 'http://arxiv.org/abs/' || doc_id || 'v1' else 'https://arxiv.org/abs/' || arxiv_id end as url, case when doc_id % 5 <> 0 then 'http://arxiv.org/pdf/' || doc_id || 'v1' else 'https://arxiv.org/pdf/' || arxiv_id end as pdf_url,
    case when doc_id % 2 = 0 then source else source || ';Bo' end as authors, case when doc_id % 6 = 1 then '' else lang || ';x' end as categories, case when doc_id % 6 = 1 then '' else lang end as primary_category,
    case when doc_id % 9 = 4 then 'unknown' else '20' || lpad((doc_id % 25)::varchar, 2, '0') || '-01-02T00:00:00Z' end as published_date, case when doc_id % 4 = 1 then '10.1/' || doc_id end as doi, doc_id % 3 <> 0 as has_html
  from f where not broken and not nameless
)"""


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, xml)."""
    d = _t(spark, sf_dir, "documents")
    n, no = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.substring(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "), 1, 60)
    some = lambda test, *parts: F.when(test, _joined(*parts)).otherwise("")
    name = F.when(n % 7 == 3, F.concat(F.lit("weird-"), no)).otherwise(_joined("http://arxiv.org/abs/", no, "v1"))
    entry = _joined(
        "<entry>", some(n % 11 != 5, "<id>", name, "</id>"), "<title> ", title, "\n  end</title>", some(n % 4 != 0, "<summary> ", F.col("lang"), "\n</summary>"),
        "<published>", F.when(n % 9 == 4, "unknown").otherwise(_joined("20", F.lpad((n % 25).cast("string"), 2, "0"), "-01-02T00:00:00Z")), "</published>", "<author><name>", F.col("source"), "</name></author>", some(n % 2 == 1, "<author><name>Bo</name></author>"),
        some(n % 3 != 0, '<link href="http://arxiv.org/abs/', no, 'v1" rel="alternate" type="text/html"/>'), some(n % 5 != 0, '<link title="pdf" href="http://arxiv.org/pdf/', no, 'v1" rel="related" type="application/pdf"/>'),
        some(n % 6 != 1, '<category term="', F.col("lang"), '"/><category term="x"/><arxiv:primary_category term="', F.col("lang"), '"/>'), some(n % 4 == 1, "<arxiv:doi>10.1/", no, "</arxiv:doi>"), "</entry>",
    )
    # A feed has ten documents at most, whatever the table's size.
    feed = d.groupBy(F.floor(n / 10).alias("topic")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("x")))), lambda e: e["x"]), "\n").alias("entries"), F.count("*").alias("n"))
    head = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>Feed  '
    whole = _joined(head, F.col("topic").cast("string"), "</title><opensearch:totalResults>", (F.col("n") * 7).cast("string"), "</opensearch:totalResults>", F.when(F.col("topic") % 4 == 0, "<opensearch:startIndex>0</opensearch:startIndex>").otherwise(""), F.col("entries"), "</feed>")
    return feed.select("topic", F.when(F.col("topic") % 17 == 3, "<feed><entry>").otherwise(whole).alias("xml"))


@query(f"with {FEED_ROWS} select * exclude (doc_id) from e")
def atom_parse(spark, sf_dir):
    e = atom.entries(_feeds(spark, sf_dir)).withColumns({"authors": F.array_join("authors", ";"), "categories": F.array_join("categories", ";")})
    return e.select("topic", "arxiv_id", "title", "abstract", "url", "pdf_url", "authors", "categories", "primary_category", "published_date", "doi", "has_html")


@query("select doc_id // 10 as topic, case when doc_id // 10 % 17 <> 3 then 'Feed ' || doc_id // 10 end as feed_title, case when doc_id // 10 % 17 <> 3 then count(*) * 7 end::int as total_results, case when doc_id // 10 % 17 <> 3 and doc_id // 10 % 4 = 0 then 0 end::int as start_index, null::int as items_per_page, case when doc_id // 10 % 17 <> 3 then count(*) else 0 end::int as n_entries from documents group by doc_id // 10")
def atom_feed_meta(spark, sf_dir):
    return atom.feed_meta(_feeds(spark, sf_dir))


@query(f"with {FEED_ROWS} select topic, arxiv_id as id, title, abstract, url, try_cast(left(published_date, 4) as int) as year, case when categories = '' then 0 else 2 end::int as n_categories from e")
def feed_to_rows(spark, sf_dir):
    return atom.as_rows(atom.entries(_feeds(spark, sf_dir))).withColumn("n_categories", F.size("categories")).drop("categories")


# --- pages ---------------------------------------------------------------------------------------------------------------

NOTE = "[1] a note that is long enough to stay"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers as pages, made of documents: section elements, headings among lines, or headings among paragraphs; every tenth is missing."""
    clean = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.split(clean, "\n"), lambda s: F.trim(s) != "")
    d = _t(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"))
    part = lambda k: F.filter("lines", lambda s, i: i % 3 == k)
    ps = lambda k: F.concat_ws("", F.transform(part(k), lambda s: _joined("<p>", s, "</p>")))
    ls = lambda k: F.concat_ws("\n", part(k))
    head = _joined("<html><head><title>Paper  ", F.col("doc_id").cast("string"), "</title></head><body>")
    elements = _joined(head, "<section><h2>1. Introduction</h2>", ps(0), f"<p>{NOTE}</p></section><section><h3>Our Method</h3>", ps(1), "</section></body></html>")
    plain = _joined(head, "<pre>\n1. Introduction\n", ls(0), "\nMethodology\n", ls(1), "\n2.\nConclusion\n", ls(2), "\nReferences\n</pre></body></html>")
    beside = _joined(head, "<div><h2>Introduction and aims</h2>", ps(0), "<h3>Detail</h3><p>A deeper paragraph stands here.</p><h2>Approach</h2>", ps(1), "<h2>Our conclusions</h2>", ps(2), "</div></body></html>")
    page = F.when(F.col("doc_id") % 3 == 0, elements).when(F.col("doc_id") % 3 == 1, plain).otherwise(beside)
    return d.select("doc_id", F.when(F.col("doc_id") % 10 != 2, page).alias("html"))


_MISSING = {name: html_sections.NOT_FOUND.format(", ".join(p)) for name, p in html_sections.PATTERNS.items()}
_CUT, _MOST = html_sections.MOST_CHARS, html_sections.MOST_PARAGRAPHS


def _paragraphs_sql(k: int, more: str = "[]") -> str:
    kept = f"list_filter(list_concat(list_transform(p{k}, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), {more}), lambda s: length(s) > {html_sections.LEAST_PARAGRAPH})"
    return f"nullif(array_to_string(({kept})[1 : {_MOST}], chr(10) || chr(10)), '')"


def _lines_sql(k: int) -> str:
    body = strip_sql(f"array_to_string(p{k}, chr(10))")
    return f"(select case when length(b) > {html_sections.LEAST_SECTION} then left(b, {_CUT}) end from (select regexp_replace({body}, '[ \\t]+', ' ', 'g') as b))"


PAGE_ROWS = f"""l as (select doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') as lines from documents
), p as (select doc_id, {', '.join(f"list_filter(lines, lambda s, i: (i - 1) % 3 = {k}) as p{k}" for k in range(3))} from l
), found as (select doc_id,
  case doc_id % 3 when 0 then coalesce({_paragraphs_sql(0)}, '{NOTE}') when 1 then {_lines_sql(0)} else {_paragraphs_sql(0, "['A deeper paragraph stands here.']")} end as introduction,
  case doc_id % 3 when 1 then {_lines_sql(1)} else {_paragraphs_sql(1)} end as methodology,
  case doc_id % 3 when 0 then null when 1 then {_lines_sql(2)} else {_paragraphs_sql(2)} end as conclusion from p
), paged as (select doc_id, case when doc_id % 10 <> 2 then 'Paper ' || doc_id end as title, {', '.join(f"case when doc_id % 10 <> 2 then coalesce({n}, '{m}') end as {n}" for n, m in _MISSING.items())} from found)"""


@query(f"with {PAGE_ROWS} select doc_id, title, md5(introduction) as introduction, md5(methodology) as methodology, md5(conclusion) as conclusion from paged")
def html_paper_sections(spark, sf_dir):
    s = html_sections.sections(_pages(spark, sf_dir), "doc_id")
    return s.select("doc_id", "title", *(_md5(n).alias(n) for n in _MISSING))


@query(f"with {PAGE_ROWS} select doc_id, length(introduction) as n, length(introduction) - length(replace(introduction, chr(10) || chr(10), chr(10))) + 1 as n_paragraphs, length(introduction) = {_CUT} as cut, md5(introduction) as digest from paged where introduction is not null")
def html_cap(spark, sf_dir):
    """What the limits leave of introductions, which long documents exceed."""
    s = html_sections.sections(_pages(spark, sf_dir), "doc_id").where("introduction is not null")
    return s.select("doc_id", F.length("introduction").alias("n"), (F.length("introduction") - F.length(F.replace("introduction", F.lit("\n\n"), F.lit("\n"))) + 1).alias("n_paragraphs"), (F.length("introduction") == _CUT).alias("cut"), _md5("introduction").alias("digest"))


@query(f"with {FEED_ROWS}, {PAGE_ROWS} select arxiv_id, e.title, replace(url, '/abs/', '/html/') as html_url, published_date as published, abstract as summary, md5(introduction) as introduction, md5(conclusion) as conclusion from e join paged using (doc_id) where has_html and introduction is not null")
def html_records(spark, sf_dir):
    s = html_sections.sections(_pages(spark, sf_dir), "doc_id")
    no = F.col("doc_id").cast("string")
    named = s.withColumn("arxiv_id", F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("weird-"), no)).otherwise(F.concat(no, F.lit("v1"))))
    r = E.html_records(atom.entries(_feeds(spark, sf_dir)), named)
    return r.select("arxiv_id", "title", "html_url", "published", "summary", _md5("sections.introduction").alias("introduction"), _md5("sections.conclusion").alias("conclusion"))


# --- criteria and reality checks -----------------------------------------------------------------------------------------

FOUR = "select doc_id as id, quality * 0.5::double as a, toxic * 0.5::double as b, doc_id % 10 / 10.0::double as c, case when doc_id % 4 <> 0 then doc_id % 7 / 7.0::double end as d from labels"


@query(f"select id, case when m = coalesce(a, 0) then 'problem definition' when m = coalesce(b, 0) then 'methodology' when m = coalesce(c, 0) then 'application domain' else 'contributions' end as name, m as value from (select *, greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0), coalesce(d, 0)) as m from ({FOUR}))")
def argmax_criterion(spark, sf_dir):
    n = F.col("doc_id")
    four = [F.col("quality") * 0.5, F.col("toxic") * 0.5, n % 10 / 10, F.when(n % 4 != 0, n % 7 / 7)]
    return _t(spark, sf_dir, "labels").select(n.alias("id"), S.main_criterion(four).alias("m")).select("id", "m.name", "m.value")


#: Answers of a reality check by document: some are no JSON, name no example, tell numbers as text or leave things out.
CHECKS = """checks as (
  select *, case when broken then false else quality = 1 end as found, case when broken then 0.0::double else (doc_id % 11) / 10.0::double end as confidence, not broken and doc_id % 3 <> 0 as named, case when not broken and doc_id % 3 <> 0 then (doc_id % 50) / 50.0::double else 0.0::double end as similarity,
    case when broken then 'Unable to perform reality check. Proceeding with paper analysis.' else lang end as assessment, case when broken then 'Consider manually verifying if similar products/research exist.' when doc_id % 2 = 0 then 'Consider what makes your approach unique.' else 'Look at ' || source end as recommendation
  from (select labels.doc_id, labels.doc_id as id, (labels.doc_id * 7 % 101)::int as score, labels.doc_id % 13 = 0 as broken, quality, lang, source from labels join documents using (doc_id))
), adjusted as (select *, case when found then greatest(5, score - trunc(score * (confidence * similarity) * 0.8::double)::int) else score end as after from checks)"""


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    n = F.col("doc_id")
    own = F.struct(F.col("source").alias("name"), (n % 50 / 50).alias("similarity"))
    examples = F.when(n % 3 != 0, F.array(own, F.struct(F.lit("Y").alias("name"), F.lit(None).cast("double").alias("similarity"))))
    body = lambda sure: F.to_json(F.struct((F.col("quality") == 1).alias("already_exists"), sure.alias("confidence"), examples.alias("existing_examples"), F.col("lang").alias("assessment"), F.when(n % 2 == 1, F.concat(F.lit("Look at "), F.col("source"))).alias("recommendation")))
    sure = n % 11 / 10
    answer = F.when(n % 13 == 0, "oops").when(n % 5 == 0, body(sure.cast("string"))).otherwise(body(sure))
    raw = j.select(n.alias("id"), (n * 7 % 101).cast("int").alias("score"), answer.alias("json"))
    return raw.select("id", "score").join(A.reality(raw.select("id", "json")), "id")


@query(f"with {CHECKS} select id, after as adjusted, similarity as max_similarity from adjusted")
def reality_adjust(spark, sf_dir):
    return _checks(spark, sf_dir).select("id", S.adjusted(F.col("score"), F.col("already_exists"), F.col("confidence"), F.col("max_similarity")).alias("adjusted"), "max_similarity")


@query(f"""with {CHECKS} select id, case when found and confidence >= 0.8 and named then '⚠️ **Warning: This idea may already exist!**' || chr(10) || chr(10) || 'Your idea closely resembles **' || source || '** (similarity: ' || round(similarity * 100)::int || '%).' || chr(10) || chr(10) || '*' || assessment || '*' || chr(10) || chr(10) || '**Recommendation:** ' || recommendation
  when found and confidence >= 0.5 then '⚠️ **Note:** Similar concepts may exist.' || chr(10) || chr(10) || '*' || assessment || '*' end as warning from checks""")
def reality_warning(spark, sf_dir):
    return _checks(spark, sf_dir).select("id", S.warning(F.col("already_exists"), F.col("confidence"), F.col("top_example"), F.col("assessment"), F.col("recommendation")).alias("warning"))


@query(f"with {CHECKS} select id, broken as failed, assessment, recommendation, case when named then 2 else 0 end::int as n_examples from checks")
def default_rows(spark, sf_dir):
    return _checks(spark, sf_dir).select("id", F.startswith("assessment", F.lit("Unable")).alias("failed"), "assessment", "recommendation", "n_examples")


@query(f"with {CHECKS} select id, case when score <> after and named then '⚠️ This idea closely resembles ' || source || '. S' || id || '. Score adjusted from ' || score || ' to ' || after || ' due to existing similar products.' else 'S' || id || '.' end as summary from adjusted")
def checked_summary(spark, sf_dir):
    after = S.adjusted(F.col("score"), F.col("already_exists"), F.col("confidence"), F.col("max_similarity"))
    return _checks(spark, sf_dir).select("id", E.checked_summary(_joined("S", F.col("id").cast("string"), "."), F.col("score"), after, F.col("top_example")).alias("summary"))


# --- PDF files -----------------------------------------------------------------------------------------------------------

CLOSING = "The paper ends here, with more small letters than there are large ones in it."
_PDF_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda s, i: trim(case when (i - 1) % 4 = 0 then '## ' || (i - 1) // 4 || ' Part' || chr(10) || regexp_replace(trim(s), '\s+', ' ', 'g') else regexp_replace(trim(s), '\s+', ' ', 'g') end)), lambda s: s <> '')"


def _as_pdf(batches):
    import pyarrow as pa

    for batch in batches:
        made = []
        for n, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            lines = [(20.0, f"Paper {n}")]
            for i, s in enumerate((text or "").split("\n")):
                lines += [(14.0, f"{i // 4} Part")] * (i % 4 == 0) + [(10.0, t) for t in [" ".join(s.split(" ")).strip()] if t]
            lines.append((10.0, CLOSING))
            made.append(pdf.written(lines, modern=n % 2 == 1)[: None if n % 10 != 3 else 60])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])


@query(rf"""with p as (select doc_id, {_PDF_LINES} as l from documents), m as (select doc_id, list_transform(list_append(l, '{CLOSING}'), lambda s: case when starts_with(s, '## ') then chr(10) || split_part(s, chr(10), 1) || chr(10) || case when contains(s, chr(10)) then chr(10) || split_part(s, chr(10), 2) else '' end else s end) as t from p)
select doc_id, case when doc_id % 10 <> 3 then md5(rtrim('# Paper ' || doc_id || chr(10) || regexp_replace(array_to_string(t, chr(10)), '


+', chr(10) || chr(10), 'g'), chr(10))) end as digest, doc_id % 10 = 3 as broken from m""")
def pdf_markdown(spark, sf_dir):
    """Documents as PDF files, of either kind of table, read back; every tenth is cut off."""
    files = _t(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_as_pdf, "doc_id long, content binary")
    return pdf.read_pdfs(files).select("doc_id", _md5("markdown").alias("digest"), F.col("problem").isNotNull().alias("broken"))
