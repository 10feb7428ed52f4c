"""Abstract, introduction and conclusion of hand-written papers."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import sections as SEC

PAPERS = [
    (1, "# Title\n## Abstract\nShort words.\nMore.\n## Introduction\nIntro text.\n### Detail\nDeep.\n## Method\nM.\n# Conclusion\nDone.\n## Inner\nstill\n# References\n[1]"),
    (2, "no headings at all\nabstract"),
    (3, "#Title\n## 1. INTRODUCTION: why\nbody\n## Summary\nsum\n# Next\nafter\n## Other\nx"),
    (4, "## abstract\n\nonly this\nand that\n## End"),
    (5, ""),
    (6, "## Concluding Remarks\nc1\n# Acknowledgements\nthanks"),
    (7, "# About\nx\n# Extended Abstract\n  one\n\ntwo\n# Introduction\nz"),
]

NO_INTRODUCTION, NO_CONCLUSION = "Introduction section not found", "Conclusion section not found"


@pytest.fixture(scope="module")
def parts(spark):
    m = F.col("markdown")
    rows = spark.createDataFrame([*PAPERS, (8, None)], "paper_id int, markdown string").select("paper_id", SEC.abstract(m).alias("a"), SEC.introduction(m).alias("i"), SEC.conclusion(m).alias("c")).collect()
    return {r.paper_id: r for r in rows}


def test_abstracts(parts):
    assert [parts[k].a for k in range(1, 8)] == ["Short words.\nMore.", "", "", "only this\nand that\n## End", "", "", "one\n\ntwo"]


def test_introductions(parts):
    assert [parts[k].i for k in range(1, 8)] == ["Intro text.\n### Detail\nDeep.", NO_INTRODUCTION, "body", NO_INTRODUCTION, NO_INTRODUCTION, NO_INTRODUCTION, "z"]


def test_conclusions(parts):
    assert [parts[k].c for k in range(1, 8)] == ["Done.\n## Inner\nstill", NO_CONCLUSION, "sum\n# Next\nafter", NO_CONCLUSION, NO_CONCLUSION, "c1", NO_CONCLUSION]
