"""Interfaces to outside models with stand-ins, stores, dumps and the search source."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import models as M
from paperloom.functions import prompts as PR
from paperloom.functions import vectors as V
from paperloom.operators import evidence as E
from paperloom.sources import files, search


def test_one_embedder_in_columns_and_batches(spark):
    texts = ["", "Größe Straße 42", "a a b", "x_y-z", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = df.select("id", V.hashed(F.col("text")).alias("a"), M.embed(F.col("text"), M.HashingEmbedder).alias("b"), M.embed(F.col("text"), M.HashingEmbedder, as_query=True).alias("c")).collect()
    for r in rows:
        assert np.allclose(r.a, r.b, atol=1e-6) and r.b == r.c and len(r.a) == 64
        assert abs(np.linalg.norm(r.a) - (1 if texts[r.id] else 0)) < 1e-9


def test_service_gets_lists_of_bounded_size():
    sizes, pauses = [], []

    def call(texts):
        sizes.append(len(texts))
        return [[1.0]] * len(texts)

    assert M.ServiceEmbedder("m", call, size=2, sleep=pauses.append).passages(["a", "b", "c"]).shape == (3, 1)
    assert sizes == [2, 1] and pauses == [0.05, 0.05]


def test_a_chat_keeps_what_was_answered():
    def call(prompt):
        if "fail" in prompt.split("\n")[-1]:
            raise ValueError
        return f"{len(prompt.splitlines())} lines"

    chat = M.Chat(call, sleep=lambda _: None)
    assert chat.say("hi") == "1 lines" and chat.say("fail") is None and chat.say("again") == "3 lines"
    assert chat.history == [("user", "hi"), ("model", "1 lines"), ("user", "again"), ("model", "3 lines")]


def test_generated_and_converted_rows(spark):
    df = spark.createDataFrame([(1, "p"), (2, None)], "id int, prompt string")
    assert [r.answer for r in M.generate(df, "prompt", lambda: str.upper).orderBy("id").collect()] == ["P", None]
    pages = spark.createDataFrame([("a", b"x"), ("b", b"\xff")], "path string, content binary")
    assert [r.markdown for r in M.convert(pages, lambda: lambda b: b.decode()).orderBy("path").collect()] == ["x", None]


def test_a_later_version_replaces_an_earlier_one(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, heading string, embedding array<float>")
    where = str(tmp_path / "store")
    files.append_index(rows((1, "a", [1.0]), (2, "b", [2.0])), where, 1, 0)
    files.append_index(rows((2, "c", [3.0]), (3, "d", [4.0]), (3, "d", [4.0])), where, 1, 1)
    assert sorted((r.id, r.heading, r.embedding) for r in files.current(spark, where).collect()) == [(1, "a", [1.0]), (2, "c", [3.0]), (3, "d", [4.0])]


def test_cache_round_trip(spark, tmp_path):
    where = str(tmp_path / "cache")
    put = lambda v, n: files.put_cache(spark.createDataFrame([("t", v)], "text string, embedding array<float>"), where, "m", "passage", n)
    put([1.0], 0)
    put([2.0], 1)
    cache = files.current(spark, where)
    hits, misses = files.split_cache(spark.createDataFrame([(1, "t"), (2, "u")], "id int, text string"), cache, "m", "passage")
    assert [(r.id, r.embedding) for r in hits.collect()] == [(1, [2.0])] and [r.id for r in misses.collect()] == [2]
    assert files.split_cache(spark.createDataFrame([(1, "t")], "id int, text string"), cache, "m", "query")[0].count() == 0


def test_dumps_with_banners_and_unreadable_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_bytes(b"\xff\xfe")
    dumps = files.read_dumps(spark, str(tmp_path / "*.txt"))
    text = dumps.agg(files.joined_dumps(dumps).alias("t")).first().t
    assert text.index("a.txt") < text.index("[Error reading file: a.txt]") < text.index("b.txt") < text.index("two\nlines")
    info = spark.range(1).select(files.paper_info(F.lit("T"), F.lit("u"), F.lit("i"), F.array(F.struct(F.lit("H").alias("heading"), F.lit("x").alias("text")))).alias("t"))
    assert "Title: T\nURL: u\nIdea: i\n" in info.first().t and info.first().t.endswith("--- H ---\nx")
    files.write_text(info, "t", str(tmp_path / "out"))
    assert "--- H ---" in "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))


def test_results_are_one_document(spark, tmp_path):
    papers = spark.createDataFrame([("b", "B"), ("a", "A")], "id string, title string")
    where = files.write_results(papers, str(tmp_path), "graph & nets?", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    lines = [x for f in (tmp_path / "graph_nets_").glob("part*") for x in f.read_text().splitlines()]
    assert where.endswith("graph_nets_") and len(lines) == 1
    got = json.loads(lines[0])
    assert got["topic"] == "graph & nets?" and got["timestamp"] == "20240102_030405" and got["total"] == 2 and [p["id"] for p in got["papers"]] == ["a", "b"]


def test_truncating_a_store(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "id int, embedding array<float>")
    files.append_index(v, str(tmp_path / "s"), 1)
    files.truncate_index(v.withColumn("version", F.lit(0).cast("long")).limit(0), str(tmp_path / "s"))
    assert files.current(spark, str(tmp_path / "s")).count() == 0


def test_options_of_the_search_source():
    where = search.address("graphs", {"field": "ti", "category": "cs.LG", "dateFrom": "202001010000", "dateTo": "202101010000", "start": "20", "maxResults": "5", "sortBy": "submittedDate", "sortOrder": "ascending"})
    assert "search_query=%28ti%3Agraphs%29+AND+%28cat%3Acs.LG%29+AND+%28submittedDate%3A%5B202001010000+TO+202101010000%5D%29" in where
    assert where.endswith("start=20&max_results=5&sortBy=submittedDate&sortOrder=ascending")


def test_prompt_falls_back_to_context(spark):
    paper = F.struct(*(F.lit(x).alias(n) for n, x in (("paper_id", "p"), ("arxiv_id", "x"), ("title", "t"))), F.array(F.lit("cs")).alias("categories"), F.lit("abs").alias("abstract"))
    part = lambda text, ok: F.array(F.struct(F.lit("H").alias("text"), F.lit(text).alias("section_text"), F.lit(ok).alias("is_valid")))
    made = lambda sections, context: spark.range(1).select(PR.analysis(F.lit("idea"), F.array(F.lit("s0"), F.lit("s1")), paper, sections, F.lit(context)).alias("p")).first().p
    long = made(part("y" * 2000, True), "ctx")
    assert "### H\n" + "y" * 1500 + "..." in long and "y" * 1501 not in long and "ctx" not in long and "[0] s0\n[1] s1" in long
    assert "ctx" in made(part("short", False), "ctx") and "No sections extracted" in made(part("", True), "")
    assert spark.range(1).select(PR.follow_up(F.lit("idea")).alias("p")).first().p.endswith("idea")
    assert spark.range(1).select(PR.report(F.lit("idea"), F.array(F.lit("one"), F.lit("two"))).alias("p")).first().p.endswith("idea\n\none\n\ntwo")


def test_neighbouring_sections_are_one_interval(spark):
    rows = [("p", 0, "Introduction", "graph index graph"), ("p", 1, "Method", "graph index"), ("p", 2, "Results", "index speed"), ("p", 3, "Data", "nothing here"), ("p", 4, "More", "graph"), ("p", 5, "End", "x")]
    sections = spark.createDataFrame(rows, "paper_id string, heading_index int, text string, section_text string")
    ideas = spark.createDataFrame([("p", "A graph index of high speed")], "paper_id string, idea string")
    got = sorted((r.from_heading, r.to_heading) for r in E.selected_intervals(sections, ideas).collect())
    assert got == [("METHOD", "DATA"), ("MORE", "END")]


@pytest.mark.parametrize("answer", [None, "oops"])
def test_unreadable_answers_count_with_zeros(spark, answer):
    raw = spark.createDataFrame([(1, "p", 0, answer)], "idea_id int, paper_id string, paper_pos int, json string")
    c = E.criteria(raw).first()
    assert (c.problem_similarity, c.contribution_similarity, c.papers_analyzed) == (0.0, 0.0, 1)
    s = spark.createDataFrame([(1, 0, "Own words.")], "idea_id int, sentence_index int, sentence string")
    r = E.sentence_rows(raw, s).first()
    assert (r.sentence, r.overlap, r.matched_sections) == ("Own words.", 0.0, [])
