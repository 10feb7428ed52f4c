"""Chunks against a plain packer over random paragraphs."""

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import assess as A
from paperloom.operators import chunks as C


def plain(text: str) -> list[str]:
    def sentences(t):
        return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if s.strip()]

    if len(text) < 100:
        return [text]
    out, buf = [], ""
    for p in (p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()):
        if buf and len(buf) + len(p) + 2 > 512:
            if len(buf.strip()) >= 100:
                out.append(buf.strip())
            tail = buf[-50:] if len(buf) > 50 else ""
            buf = (tail[tail.find(" ") + 1 :] if tail.find(" ") > 0 else tail) + p
        else:
            buf = f"{buf}\n\n{p}" if buf else p
    if buf.strip():
        out.append(buf.strip())
    final = []
    for c in out:
        if len(c) <= 768:
            final.append(c)
            continue
        buf = ""
        for s in sentences(c):
            if len(buf) + len(s) + 1 > 512:
                if buf.strip():
                    final.append(buf.strip())
                buf = s
            else:
                buf = f"{buf} {s}" if buf else s
        if buf.strip():
            final.append(buf.strip())
    return final


def test_chunks_match_a_plain_packer(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(2, 30))).capitalize() + "."
    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(i, 0, "h", t) for i, t in enumerate(texts)], "paper_id int, heading_index int, text string, section_text string")
    got: dict[int, list] = {i: [] for i in range(len(texts))}
    for r in sorted(C.chunks(df).collect(), key=lambda r: (r.paper_id, r.chunk_index)):
        assert r.chunk_index == len(got[r.paper_id]) and r.chunk_id == f"{r.paper_id}_h00_c{r.chunk_index:02d}"
        got[r.paper_id].append(r.text)
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_ideas_without_papers_or_sentences_are_original(spark):
    ideas = spark.createDataFrame([(1, "One long enough sentence."), (2, ""), (3, None)], "idea_id int, text string")
    corpus = spark.createDataFrame([], "paper_id int, text string")
    rows = A.assess(ideas, corpus)["assessments"].collect()
    assert {r.idea_id: (r.score, r.label, r.overlap, r.papers_analyzed) for r in rows} == {i: (100, "high", 0.0, 0) for i in (1, 2, 3)}


def test_neighbours_stop_at_gaps(spark):
    df = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 0, 3, "d")], "paper_id int, heading_index int, chunk_index int, text string")
    rows = {r.text: (r.prev_text, r.next_text) for r in C.with_neighbours(df).collect()}
    assert rows == {"a": (None, "b"), "b": ("a", None), "d": (None, None)}
    assert C.chunk_stats(C.chunks(spark.createDataFrame([], "paper_id int, heading_index int, text string, section_text string"))).count() == 0
    assert F is not None
