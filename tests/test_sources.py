import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions import models as M
from paperloom.sources import files, html_sections, search


def test_papers_from_json_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": 7, "title": "A", "year": 2020}\n\n{"id": "x", "abstract": "B", "categories": ["c"]}\n')
    rows = {r.id: r for r in files.read_papers(spark, str(tmp_path / "p.jsonl")).collect()}
    assert rows["7"].title == "A" and rows["7"].abstract == "" and rows["x"].title == "" and rows["x"].categories == ["c"]
    files.write_papers(files.read_papers(spark, str(tmp_path / "p.jsonl")), str(tmp_path / "out"))
    assert sorted(json.loads(x)["id"] for f in (tmp_path / "out").glob("part*") for x in f.read_text().splitlines()) == ["7", "x"]


def test_appending_twice_adds_nothing_and_checks_dimensions(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, embedding array<float>")
    for _ in range(2):
        files.append_index(v, str(tmp_path / "ix"), 2)
    assert files.current(spark, str(tmp_path / "ix")).count() == 2
    with pytest.raises(Exception, match="dimensions"):
        files.append_index(spark.createDataFrame([(3, [1.0])], "id int, embedding array<float>"), str(tmp_path / "ix"), 2)


def test_passages_and_queries_have_different_keys(spark):
    row = spark.range(1).select(files.cache_key("m", "query", F.lit("t")).alias("q"), files.cache_key("m", "passage", F.lit("t")).alias("p")).first()
    assert row.q != row.p


def test_search_expressions():
    assert search.query(["graph"]) == "all:graph"
    assert search.query(["a", "b"], operator="OR", category="cs.LG", field="ti") == "(ti:a OR ti:b) AND (cat:cs.LG)"
    assert search.query(date_to="202101010000") == "submittedDate:[200001010000 TO 202101010000]"
    with pytest.raises(ValueError):
        search.query()


def test_fetch_tries_again_and_gives_up():
    waits = []

    def broken(*_, **__):
        raise OSError

    assert search.fetch("http://x", opener=broken, sleep=waits.append) is None and waits == [5.0, 10.0]


def test_retries_of_models():
    waits, calls = [], []

    def call(p):
        calls.append(p)
        if len(calls) == 1:
            raise M.ServiceBusy(2)
        if len(calls) == 2:
            raise ValueError
        return "ok"

    assert M.with_retries(call, "p", sleep=waits.append) == "ok" and waits == [5, 6]


def test_html_sections_by_each_strategy():
    p = ("introduction", "intro")
    by_element = "<section><h2>1. Introduction</h2><p>This paragraph is long enough to stay.</p><p>[1] a reference that is long</p></section>"
    assert html_sections.section(html_sections.Page(by_element), p) == "This paragraph is long enough to stay."
    by_line = "<pre>\n1. Introduction\n" + "word " * 20 + "\n\nResults\nother</pre>"
    assert html_sections.section(html_sections.Page(by_line), p) == ("word " * 20).strip()
    by_heading = "<div><h2>An intro to it</h2><p>The first long paragraph here.</p><h3>x</h3><p>The second long paragraph here.</p><h2>End</h2><p>Not this paragraph any more.</p></div>"
    assert html_sections.section(html_sections.Page(by_heading), p) == "The first long paragraph here.\n\nThe second long paragraph here."
    assert html_sections.section(html_sections.Page("<p>nothing</p>"), p) == "Section not found (searched for: introduction, intro)"


def test_streamed_papers_are_indexed_once(spark, tmp_path):
    from paperloom.streaming.index import index_stream

    spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d")], "id int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    assert files.current(spark, str(tmp_path / "store")).count() == 2


def test_title_as_the_page_writes_it_beside_the_decoded_one(spark, tmp_path):
    import __spark_entry__ as e

    pages = ["<html>\n<head>\n<title>A &amp; B\n &quot;c&quot; d &amp</title></head><body><h1>Other</h1></body></html>", "<p>none</p>", None, "<title></title>", "<h1 class='x'>cut off &lt; &am"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {r.page_id: (r.title, r.title_source) for r in html_sections.sections(df).collect()}
    assert got == {0: ('A & B "c" d &', "A &amp; B\n &quot;c&quot; d &amp"), 1: (None, None), 2: (None, None), 3: ("", ""), 4: ("cut off < &am", "cut off &lt; &am")}
    df.write.parquet(f"{tmp_path}/pages.parquet")
    told = {r.page_id: r.title for r in e.queries()["html_sections_query"](spark, str(tmp_path)).collect()}
    assert told == {0: "A & B &quot;c&quot; d &amp", 1: "", 2: None, 3: "", 4: "cut off < &am"}
