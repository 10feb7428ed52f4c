"""Fill-in-middle against slices of code points, periodic runs against a plain search."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fim, queries, runs


def _arranged(doc_id, text):
    t = text or ""
    n = len(t)
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not t or doc_id is None or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def _odd_texts():
    rng = random.Random(11)
    texts = [None, "", "a", "é", "😀", "<P", "x<S>y", "<", "P>", "S>a<M", "\n\n", "é" * 300, "<" * 700, "<P" * 400, "ab\0c"]
    texts += ["".join(rng.choice("ab<PSM>é漢😀\n ") for _ in range(rng.choice([3, 40, 255, 256, 257, 1000, 5000]))) for _ in range(150)]
    return texts + ["".join(rng.choice("aé漢😀") for _ in range(300_000)), texts[-1], texts[-1]]


def test_fill_in_middle_against_slices(spark):
    rows = list(enumerate(_odd_texts())) + [(None, "no id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit(1))
    got = fim.transform(df).withColumn("back", fim.restored()).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted(((d, *_arranged(d, t)) for d, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(d), t or "") for d, t in rows)


def test_checkpoints_of_every_step():
    text = "aé漢😀" * 50
    body = np.frombuffer(text.encode(), dtype=np.uint8)
    for step in (1, 2, 3, 5, 64, 1000):
        index = fim.Checkpoints(body, step)
        assert index.n == len(text)
        assert [index.byte_of(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_fill_in_middle_of_nothing_and_of_bad_marks(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for marks in (("<P>", "<P>x", "<M>"), ("ab", "bc", "d"), ("aba", "x", "y"), ("", "x", "y")):
        with pytest.raises(ValueError, match="overlap"):
            fim.restored(marks=marks)


def _runs(w):
    found, n = {}, len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1 if j > i else i + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def _periodic(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        part = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        out += (part * rng.randint(1, 9))[: rng.randint(1, 50)]
    return out


def test_runs_against_a_plain_search():
    rng = random.Random(12)
    cases = [_periodic(rng) for _ in range(400)] + [list("a" * n) for n in range(0, 30)] + [list("ab" * 12), list("aab" * 40 + "ab" * 40)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    cases += [list(fib[-1]), [str(bin(k).count("1") % 2) for k in range(512)]]
    for w in cases:
        assert [tuple(r) for r in runs.find_runs(runs.word_ids([x.encode() for x in w])).tolist()] == _runs(w)


def test_runs_of_long_texts_are_found_in_blocks(monkeypatch):
    rng = random.Random(5)
    cases = [_periodic(rng) for _ in range(60)]
    ids = [runs.word_ids([x.encode() for x in w]) for w in cases]
    want = [runs.find_runs(i).tolist() for i in ids]
    monkeypatch.setattr(runs, "KEPT", 4)
    monkeypatch.setattr(runs, "BLOCK", 10)
    assert [runs.find_runs(i).tolist() for i in ids] == want


def test_a_hash_collision_is_noticed(monkeypatch):
    ids = runs.word_ids([x.encode() for x in "x a a a a a a b a a a a a a c d e f".split()])
    want = runs.find_runs(ids).tolist()
    real, turns = runs.Hashes.same, []
    monkeypatch.setattr(runs.Hashes, "__init__", lambda self, ids, bases, f=runs.Hashes.__init__: (turns.append(bases), f(self, ids, bases))[1])
    monkeypatch.setattr(runs.Hashes, "same", lambda self, i, q, size: real(self, i, q, size) | (len(turns) < 2))
    assert runs.find_runs(ids).tolist() == want and len(turns) == 2


def test_runs_of_all_equal_words_take_little_time():
    found = runs.find_runs(np.zeros(200_000, dtype=np.int64))
    assert found.tolist() == [[0, 200_000, 1]]


def _wanted(doc_id, text):
    w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if x]
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = _runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *longest, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_against_a_plain_search(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(_periodic(rng))) for i in range(120)] + [(200, None), (201, ""), (202, " \t\v\f\n"), (None, "a a a a a a b"), (203, "x x " * 9), (203, "x x " * 9), (204, "é\x1fa\x85 " * 8), (205, "w v " * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((_wanted(*r) for r in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[:120])
    assert runs.collapse(spark.createDataFrame([], "doc_id long, text string")).count() == 0
