"""Feeds, answers and reality checks that the tables do not show: odd shapes, broken text, ties."""

import json

from pyspark.sql import functions as F

from paperloom.functions import prompts as PR
from paperloom.functions import scores as S
from paperloom.operators import assess as A
from paperloom.operators import evidence as E
from paperloom.sources import atom

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>Some  Query</title><id>q1</id><opensearch:totalResults>42</opensearch:totalResults>
<entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A
  long   title</title><summary> Some
 abstract. </summary><published>2021-01-02T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author><link href="http://arxiv.org/abs/2101.00001v2" rel="alternate" type="text/html"/><link title="pdf" href="http://arxiv.org/pdf/2101.00001v2" rel="related" type="application/pdf"/><category term="cs.LG"/><arxiv:primary_category term="cs.LG"/></entry>
<entry><title>No id</title><summary>x</summary></entry><entry><id>weird-id</id><title>Bare</title><published>unknown</published></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("graphs", FEED), ("broken", "<feed><entry>"), ("none", '<feed xmlns="http://www.w3.org/2005/Atom"><title>Empty</title></feed>')], "topic string, xml string")
    rows = {r.arxiv_id: r for r in atom.entries(df).collect()}
    assert set(rows) == {"2101.00001v2", "weird-id"}
    assert rows["2101.00001v2"].title == "A long title" and rows["2101.00001v2"].authors == ["Ann", "Bo"] and rows["2101.00001v2"].has_html
    assert rows["weird-id"].pdf_url == "https://arxiv.org/pdf/weird-id" and not rows["weird-id"].has_html
    meta = {r.topic: (r.feed_title, r.total_results, r.n_entries) for r in atom.feed_meta(df).collect()}
    assert meta == {"graphs": ("Some Query", 42, 3), "broken": (None, None, 0), "none": ("Empty", None, 0)}


def _told(spark, *answers):
    return spark.createDataFrame([(0, f"p{i}", i, a) for i, a in enumerate(answers)], "idea_id int, paper_id string, paper_pos int, json string")


def test_a_fault_in_an_answer_costs_its_own_value(spark):
    good = {"criteria_scores": {"problem_similarity": 0.5, "method_similarity": 0.25, "domain_overlap": 1.0, "contribution_similarity": 0.25}, "sentence_level": [{"sentence_index": 0, "overlap_score": 0.8, "matched_sections": [{"heading": "A", "similarity": 0.9}]}, {"sentence_index": 2}]}
    text = json.loads(json.dumps(good))
    text["criteria_scores"]["problem_similarity"] = "0.5"
    text["sentence_level"][0]["sentence_index"] = "0"
    odd = {"criteria_scores": [1], "overall_overlap_score": 0.75, "sentence_level": [{"sentence_index": "two", "overlap_score": 1}, 7, None, {"overlap_score": "much", "matched_sections": {"heading": "x"}}]}
    raw = _told(spark, json.dumps(good), json.dumps(text), json.dumps(odd), "not json", None, "[]", '{"a":1,"a":2}')
    got = {}
    for r in E.analyses(raw).collect():
        got.setdefault(r.paper_id, []).append((r.problem_similarity, r.overall, r.sentence_index, r.overlap, r.n_matches))
    assert got["p0"] == got["p1"] == [(0.5, 0.5, 0, 0.8, 1), (0.5, 0.5, 2, 0.0, 0)]
    assert got["p2"] == [(0.0, 0.75, 0, 0.0, 0)]
    assert all(got[p] == [(0.0, 0.0, None, None, 0)] for p in ("p3", "p4", "p5", "p6"))
    mean = E.criteria(raw).first()
    assert mean.papers_analyzed == 7 and mean.domain_overlap == round(2 / 7, 6)
    sentences = spark.createDataFrame([(0, 0, "Own words."), (0, 1, "More.")], "idea_id int, sentence_index int, sentence string")
    rows = E.sentence_rows(raw, sentences).where("sentence_index = 1").collect()
    assert len(rows) == 7 and all(r.overlap == 0 and r.sentence == "More." and r.matched_sections == [] for r in rows)


CHECKS = [
    (1, '{"already_exists":true,"confidence":0.95,"existing_examples":[{"name":"X","similarity":0.98},{"name":"Y"}],"assessment":"a","recommendation":"r"}', 80, 21, "X"),
    (2, '{"already_exists":"true","confidence":"0.95","existing_examples":[{"name":"X","similarity":0.98}],"assessment":"a","recommendation":"r"}', 3, 5, "X"),
    (3, '{"already_exists":true,"confidence":0.5,"assessment":"b"}', 50, 50, None),
    (4, '{"already_exists":true,"confidence":1.0,"existing_examples":[{"similarity":1.0}],"assessment":"c"}', 100, 20, None),
    (5, '{"already_exists":false,"confidence":0.9,"assessment":"d"}', 70, 70, None),
    (6, "oops", 60, 60, None),
    (7, '{"already_exists":true,"confidence":1,"existing_examples":["X",{"name":"Z","similarity":0.5}]}', 100, 60, "Z"),
]


def test_reality_checks(spark):
    raw = spark.createDataFrame([c[:3] for c in CHECKS], "id int, json string, score int")
    j = raw.select("id", "score").join(A.reality(raw.select("id", "json")), "id")
    r = {x.id: x for x in j.select("*", S.adjusted(F.col("score"), F.col("already_exists"), F.col("confidence"), F.col("max_similarity")).alias("after"), S.warning(F.col("already_exists"), F.col("confidence"), F.col("top_example"), F.col("assessment"), F.col("recommendation")).alias("warning")).collect()}
    assert {k: x.after for k, x in r.items()} == {c[0]: c[3] for c in CHECKS}
    assert {k: x.top_example.name if x.top_example else None for k, x in r.items()} == {c[0]: c[4] for c in CHECKS}
    assert r[6].assessment.startswith("Unable to perform") and r[3].recommendation == "Consider what makes your approach unique."
    assert "**X** (similarity: 98%)" in r[1].warning and "existing products" in r[4].warning and r[3].warning.startswith("⚠️ **Note:**") and r[5].warning is None


def test_questions_intervals_and_ties(spark):
    asked = spark.createDataFrame([(1, '{"questions":[{"id":7,"category":"scope","question":"How far?"}]}'), (2, "no json"), (3, "{}"), (4, None)], "id int, answer string").select("id", PR.questions(F.col("answer")).alias("q")).collect()
    assert {r.id: len(r.q) for r in asked} == {1: 1, 2: 3, 3: 0, 4: 3}
    spans = spark.createDataFrame([(1, '[{"from_heading":"METHOD","to_heading":"RESULTS"},{"from_heading":"DATA"}]'), (2, '{"from_heading":"A","to_heading":"B"}'), (3, "broken"), (4, '[{"to_heading":"B"}]')], "id int, answer string").select("id", PR.intervals(F.col("answer")).alias("x")).collect()
    assert {r.id: [(s.from_heading, s.to_heading) for s in r.x] for r in spans} == {1: [("METHOD", "RESULTS"), ("DATA", None)], 2: [("A", "B")], 3: [], 4: []}
    four = spark.createDataFrame([(1, 0.5, 0.5, 0.2, 0.1), (2, 0.1, 0.9, 0.9, 0.3), (3, 0.0, 0.0, 0.0, 0.0), (4, None, 0.6, None, 0.6)], "id int, a double, b double, c double, d double")
    names = {r.id: r.m.name for r in four.select("id", S.main_criterion([F.col(c) for c in "abcd"]).alias("m")).collect()}
    assert names == {1: "problem definition", 2: "methodology", 3: "problem definition", 4: "methodology"}
