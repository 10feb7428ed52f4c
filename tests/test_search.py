"""Search with block maxima against a full BM25, key phrases, and the hits that follow."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import papers as P
from paperloom.operators import search as SE


def _full(docs, terms, k):
    bags = {d: t.split() for d, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    scores = {}
    for d, w in bags.items():
        total = 0.0
        for t in set(terms):
            df = sum(t in x for x in bags.values())
            if t in w:
                tf = w.count(t)
                total += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        if total:
            scores[d] = round(total, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i * 3 - 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(700)]
    docs += [(9000, "same words here"), (9001, "same words here"), (9002, "same words here")]
    return docs, spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash"))


@pytest.mark.parametrize(("k", "block"), [(1, 4), (3, 16), (10, 64)])
def test_search_finds_what_a_full_search_finds(spark, corpus, tmp_path, monkeypatch, k, block):
    monkeypatch.setattr(SE, "BLOCK", block)
    docs, df = corpus
    index = SE.write_index(df, f"file://{tmp_path}/index")
    asked = [["w1"], ["w1", "w2", "w3"], ["w5", "w1", "w1"], ["w40", "w77", "w2"], ["same", "words"], ["nothing"], [], None, ["w9", "w12", "w33", "w2", "w6"]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, terms array<string>")
    got = {}
    for r in SE.search(queries, index, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc, r.score))
    for i, terms in enumerate(asked):
        want = _full(docs, terms or [], k)
        assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
        assert [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in want], abs=2e-6)
    cost = {r.query_id: (r.postings, r.read) for r in SE.cost(queries, index, k).collect()}
    assert all(read <= full for full, read in cost.values())
    if k == 1:
        assert sum(read for _, read in cost.values()) < 0.5 * sum(full for full, _ in cost.values())


def test_search_in_nulls_repeats_and_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two"), (1, "one"), (None, "one"), (2, None), (3, "")], "doc_id long, text string")
    index = SE.write_index(df, f"file://{tmp_path}/a")
    q = spark.createDataFrame([(1, ["one"]), (2, ["none"])], "query_id int, terms array<string>")
    assert [(r.query_id, r.doc, r["rank"]) for r in SE.search(q, index).collect()] == [(1, 1, 1)]
    assert index.documents == 4
    empty = SE.write_index(df.limit(0), f"file://{tmp_path}/b")
    assert SE.search(q, empty).count() == 0 and SE.cost(q, empty).count() == 0
    again = SE.open_index(spark, f"file://{tmp_path}/a")
    assert (again.documents, again.mean) == (index.documents, index.mean)


def test_plans_read_no_documents_for_bounds(spark, corpus, tmp_path):
    index = SE.write_index(corpus[1], f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, ["w1"])], "query_id int, terms array<string>")
    plan = SE.search(q, index)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_keyphrases_absorb_what_they_hold(spark):
    corpus = ["deep residual learning works", "deep residual learning again", "deep residual learning"] + [f"other words number{chr(97 + i % 26)} deep" for i in range(60)] + [None, ""]
    ideas = [(1, "We want deep residual learning for other words"), (2, "a an of"), (3, None), (4, "Zebra zebra. Unknown words here, residual!")]
    got = {}
    for r in P.keyphrases(spark.createDataFrame(ideas, "idea_id int, text string"), spark.createDataFrame([(t,) for t in corpus], "text string")).orderBy("idea_id", "kw_pos").collect():
        got.setdefault(r.idea_id, []).append((r.phrase, r.df, r.kind))
    assert got[1][0] == ("deep residual learning", 3, "specific")
    assert not {"deep", "residual", "learning", "deep residual"} & {p for p, _, _ in got[1]}
    assert [p for p, _, _ in got[4]] == ["residual", "words", "here", "unknown", "zebra"]
    assert set(got) == {1, 4}
    assert [k for _, _, k in got[4]] == ["specific"] * 4 + ["broad"]


def test_hits_of_phrases_lead_to_papers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, "delta"), (4, "epsilon")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, 1, "alpha beta"), (7, 2, "delta alpha"), (8, 1, "zeta")], "idea_id int, kw_pos int, phrase string")
    hits = P.ranked_hits(phrases, SE.write_index(docs, f"file://{tmp_path}/i"))
    papers = P.selected(P.first_hits(hits), 5).orderBy("paper_pos").collect()
    assert [(r.idea_id, r.paper_id, r.arxiv_id, r.search_keyword) for r in papers] == [(7, "paper_01", "2", "alpha beta"), (7, "paper_02", "1", "alpha beta"), (7, "paper_03", "3", "delta alpha")]


def test_index_of_blocks_cut_by_batches_and_numbers_that_rows_share(spark, tmp_path):
    """Against a plain count; one list for each word and block, however the rows fall into batches."""
    rng = random.Random(5)
    rows = [(rng.randrange(-40, 200), " ".join(rng.choice("aa bb cc dd éé ff7".split()) for _ in range(rng.randrange(0, 9))) or None) for _ in range(400)] + [(None, "aa")]
    want = {}
    for doc, text in rows:
        w = (text or "").split()
        for term in set(w) if doc is not None else ():
            tf, length = want.setdefault((term, doc // 32), {}).get(doc, (0, 0))
            want[term, doc // 32][doc] = (tf + w.count(term), max(length, len(w)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = SE.write_index(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = index.postings.collect()
    assert index.documents == 400 and len(got) == len(want)
    assert {(r.term, r.block): {d.doc: (d.tf, d.length) for d in r.docs} for r in got} == want
    assert all(r.n == len(r.docs) and [d.doc for d in r.docs] == sorted(d.doc for d in r.docs) for r in got)


def test_search_shuffles_no_lists_but_those_of_its_words(spark, tmp_path):
    rows = [(i, f"common word{i}") for i in range(200)]
    index = SE.write_index(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    own = SE._own(spark.createDataFrame([((1, 2), ["word7"])], "query_id struct<a:int,b:int>, terms array<string>"), index)
    assert [r.term for r in own.postings.collect()] == ["word7"]
    hits = SE.search(spark.createDataFrame([((1, 2), ["word7"])], "query_id struct<a:int,b:int>, terms array<string>"), index).collect()
    assert [((r.query_id.a, r.query_id.b), r.doc, r["rank"]) for r in hits] == [((1, 2), 7, 1)]


def test_search_shuffles_lists_and_the_best_of_each_part_only(spark, tmp_path, monkeypatch):
    """Neither the rows of queries and blocks nor those of queries and documents; parts grow in number, not in size."""
    monkeypatch.setattr(SE, "PART", 100)
    rows = [(i, f"common word{i % 7} other{i % 11}") for i in range(1500)]
    index = SE.write_index(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ix"))
    queries = spark.createDataFrame([(i, ["common", f"word{i}", f"other{i}"]) for i in range(6)], "query_id int, terms array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = SE.search(queries, index, 3)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        got = [(r.query_id, r.doc, r.score) for r in hits.orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert [("(block" in line and ", 15)" in line) or "(query_id" in line for line in dealt] == [True] * len(dealt), plan
    assert sum("(query_id" in line and "block" not in line for line in dealt) == 1, plan
    assert [(q, d) for q, d, _ in got] == [(q, d) for q in range(6) for d, _ in _full(rows, ["common", f"word{q}", f"other{q}"], 3)]
