"""Atom feeds of a paper search service, parsed by Spark's XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T

_LINK = "array<struct<_href:string,_title:string,_rel:string,_type:string>>"
_ENTRY = (
    "struct<id:string,title:string,summary:string,published:string,updated:string,author:array<struct<name:string>>,"
    f"link:{_LINK},category:array<struct<_term:string>>,`arxiv:primary_category`:struct<_term:string>,"
    "`arxiv:comment`:string,`arxiv:journal_ref`:string,`arxiv:doi`:string>"
)
_FEED = f"title string, id string, updated string, `opensearch:totalResults` string, `opensearch:startIndex` string, `opensearch:itemsPerPage` string, entry array<{_ENTRY}>"


def feeds(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with ``feed``; a feed that is not XML is null."""
    return df.withColumn("feed", F.from_xml(xml, _FEED, {"mode": "PERMISSIVE"}))


def feed_meta(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Feed-level fields; counts as integers, null where they are missing."""
    number = lambda c: F.col(f"feed.`opensearch:{c}`").try_cast("int")
    f = feeds(df, xml)
    return f.select(*(c for c in df.columns if c != xml), T.collapse(F.col("feed.title")).alias("feed_title"), number("totalResults").alias("total_results"), number("startIndex").alias("start_index"), number("itemsPerPage").alias("items_per_page"), F.coalesce(F.size("feed.entry"), F.lit(0)).alias("n_entries"))


def _entries(df: DataFrame, xml: str) -> DataFrame:
    keep = [c for c in df.columns if c != xml]
    return feeds(df, xml).select(*keep, F.posexplode_outer("feed.entry").alias("rank", "e")).where("e is not null and e.id is not null")


def _href(test) -> Column:
    return F.try_element_at(F.filter("e.link", test), F.lit(-1))["_href"]


def entries(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per entry that has an id: names, links with constructed fallbacks, lists of authors and categories."""
    e = _entries(df, xml)
    paper = F.regexp_replace(T.strip(F.col("e.id")), r"^.*/abs/", "")
    built = lambda kind: F.concat(F.lit(f"https://arxiv.org/{kind}/"), paper)
    pdf, page = _href(lambda x: x["_title"] == "pdf"), _href(lambda x: (x["_rel"] == "alternate") & (F.coalesce(x["_title"], F.lit("")) != "pdf"))
    full = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(None))
    return e.select(
        *(c for c in df.columns if c != xml), F.col("rank"), paper.alias("arxiv_id"), F.coalesce(T.collapse(F.col("e.title")), F.lit("")).alias("title"), F.coalesce(T.collapse(F.col("e.summary")), F.lit("")).alias("abstract"),
        F.coalesce(full(page), built("abs")).alias("url"), F.coalesce(full(pdf), built("pdf")).alias("pdf_url"),
        F.coalesce(F.transform("e.author", lambda a: a["name"]), F.array()).alias("authors"),
        F.coalesce(F.filter(F.transform("e.category", lambda c: c["_term"]), lambda t: t.isNotNull()), F.array()).alias("categories"),
        F.coalesce(F.col("e.`arxiv:primary_category`._term"), F.lit("")).alias("primary_category"), F.col("e.published").alias("published_date"),
        F.col("e.updated").alias("updated"), F.col("e.`arxiv:comment`").alias("comment"), F.col("e.`arxiv:journal_ref`").alias("journal_ref"), F.col("e.`arxiv:doi`").alias("doi"),
        F.coalesce(F.exists("e.link", lambda x: F.coalesce((x["_type"] == "text/html") | F.contains(x["_href"], F.lit("/html/")), F.lit(False))), F.lit(False)).alias("has_html"),
        F.map_from_entries(F.transform(F.filter("e.link", lambda x: x["_title"].isNotNull()), lambda x: F.struct(x["_title"], x["_href"]))).alias("links"),
    )


def as_rows(entries: DataFrame) -> DataFrame:
    """Flat rows with the year of publication, null where the date does not start with one."""
    return entries.select("topic", F.col("arxiv_id").alias("id"), "title", "abstract", "url", F.substring("published_date", 1, 4).try_cast("int").alias("year"), "categories")
