"""Alignment against a table filled cell by cell; the judge's answers; the chain from idea to assessment."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import alignment as AL
from paperloom.operators import evidence as E
from paperloom.operators import judge as J
from paperloom.operators import search as SE
from paperloom.operators import sections as SEC
from paperloom.sources import files


def _plain(sentence, weight, text):
    between = AL.BETWEEN * sum(weight) / len(weight)
    h = [[0.0] * (len(text) + 1) for _ in range(len(sentence) + 1)]
    for i, (w, c) in enumerate(zip(sentence, weight, strict=True), 1):
        for j, x in enumerate(text, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + (c if w == x else -AL.REPLACED * c), h[i - 1][j] - AL.LEFT_OUT * c, h[i][j - 1] - between)
    return max(max(r) for r in h)


def test_alignment_against_a_plain_table():
    rng = random.Random(3)
    for _ in range(300):
        sentence = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        weight = [rng.choice([0.3, 1.0, 2.5]) for _ in sentence]
        text = [rng.randrange(-1, 6) for _ in range(rng.randint(0, 30))]
        score, start, stop = AL.align(np.array(sentence), np.array(weight), np.array(text, dtype=int))
        assert score == pytest.approx(_plain(sentence, weight, text) if text else 0.0, abs=1e-9)
        if score:
            assert 0 <= start < stop <= len(text) and _plain(sentence, weight, text[start:stop]) == pytest.approx(score, abs=1e-9)


def test_alignment_finds_changed_copies():
    sentence, weight = np.arange(10), np.ones(10)
    text = np.array([50, 51, 0, 1, 2, 90, 3, 4, 99, 6, 7, 8, 9, 52])
    score, start, stop = AL.align(sentence, weight, text)
    assert (start, stop) == (2, 13) and score == pytest.approx(10 - 1 - AL.REPLACED - AL.BETWEEN)
    assert AL.align(sentence, weight, text[:0])[0] == AL.align(sentence[:0], weight[:0], text)[0] == 0


IDEA = "Sparse graph kernels speed up protein folding on small machines. They need no training data at all."
COPY = "# Copy\n## Introduction\nSome words before. Sparse graph kernels speed up protein folding on small machines. They need no training data at all.\n## Method\nunrelated text follows here"
NEAR = "# Near\n## Method\nwe show that sparse graph kernels greatly speed up protein folding on tiny machines\n## Results\nnothing more"
OTHER = "# Other\n## Method\nfolding chairs are made of machines and data"


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, COPY), (2, NEAR), (3, OTHER), (4, None), (5, ""), *((i, f"## Text\nplain filler words number {i} in the corpus") for i in range(6, 40))], "doc_id long, text string")
    ideas = spark.createDataFrame([(1, IDEA), (2, "Zymurgy flummoxes quixotic jabberwocks everywhere today."), (3, ""), (4, None), (5, "Sparse graph kernels run well on machines that we have.")], "idea_id long, text string")
    index = SE.write_index(docs, f"file://{tmp_path_factory.mktemp('ix')}")
    sections = lambda texts: SEC.sections(texts.withColumnRenamed("text", "markdown"))
    watched = E.Watched(files.stored, answers={"first": F.count_if(F.col("paper_pos") == 1)})
    return J.novelty(ideas, docs, sections, index, watched) | {"watched": watched}


def test_chain_from_idea_to_assessment(chain):
    got = {r.idea_id: r for r in chain["assessments"].collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    copied = got[1]
    assert copied.unchecked_score == 0 and copied.overlap == 1.0 and copied.label == "low" and copied.red == 2
    assert copied.problem_similarity > copied.method_similarity > 0 and copied.papers_analyzed >= 3
    assert "paper 1" in copied.warning and "may already exist" in copied.warning and copied.score == 5
    assert copied.summary.startswith("⚠️ This idea closely resembles paper 1.") and copied.cost > 0.001
    for new in (got[2], got[3], got[4]):
        assert (new.score, new.label, new.overlap, new.papers_analyzed, new.cost) == (100, "high", 0.0, 0, 0.001) and new.warning is None
        assert new.summary.startswith("No similar papers were found.")
    assert got[1].score < got[5].score < 100 and got[5].yellow + got[5].red + got[5].green == 1


def test_answers_of_the_judge(chain):
    said = {(r.idea_id, r.paper_id): json.loads(r.json) for r in chain["answers"].collect()}
    copied = said[1, 1]
    assert copied["overall_overlap_score"] == 1.0 and copied["criteria_scores"]["problem_similarity"] == 1.0
    assert [s["sentence_index"] for s in copied["sentence_level"]] == [0, 1]
    assert copied["sentence_level"][0]["matched_sections"][0]["heading"] == "Introduction"
    near = said[1, 2]
    assert 0.6 < near["sentence_level"][0]["overlap_score"] < 1 and near["criteria_scores"]["method_similarity"] > 0.3
    rows = {(r.sentence_index, r.heading): r for r in chain["overlaps"].where("idea_id = 1 and paper_id = 2").collect()}
    assert (rows[0, "Method"].start, rows[0, "Method"].stop) == (3, 14)


def test_linked_sections_and_kinds(chain, spark):
    a = {(r.idea_id, r.sentence_index): r for r in chain["annotations"].collect()}
    assert a[1, 0].label == "low" and [(m.paper_id, m.heading) for m in a[1, 0].linked_sections][:2] == [(1, "Introduction"), (2, "Method")]
    kinds = spark.createDataFrame([("1. Introduction",), ("Our Approach",), ("Results and Discussion",), ("Abstract",), (None,)], "h string").select(J.kind(F.col("h")).alias("k")).collect()
    assert [r.k for r in kinds] == ["problem_similarity", "method_similarity", "contribution_similarity", "domain_overlap", "domain_overlap"]


def test_papers_without_sections_have_zeros(chain, spark):
    papers = spark.createDataFrame([(9, 1, 1)], "idea_id long, paper_id long, paper_pos int")
    told = J.answers(papers, chain["overlaps"].limit(0)).first()
    assert json.loads(told.json)["criteria_scores"]["method_similarity"] == 0.0


def test_counts_come_with_the_pass(chain, spark):
    row = chain["watched"].row(spark).first().asDict()
    for name in ("sentences", "phrases", "hits", "papers", "sections", "overlaps", "answers"):
        assert row[f"{name}_rows"] == chain[name].count()
    assert row["answers_first"] == 2
