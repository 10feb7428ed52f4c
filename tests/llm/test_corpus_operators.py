"""Jaccard join, line dedup, quality, toxicity and the pipeline: against plain versions and held-out labels."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard, linedup, quality, toxicity

SF = "/root/testdata/sf0.01"


def _sets(texts, k):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def _components(ids, sets, num, den):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize(("k", "num"), [(3, 90), (2, 80), (5, 80)])
def test_jaccard_components_against_brute_force(spark, k, num):
    rng = random.Random(num + k)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)] for n in (4, 12, 18, 25, 60, 150) for _ in range(3)]
    texts = []
    for w in base:
        for _ in range(9):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                v[rng.randrange(len(v))] = rng.choice("ABxyz") + str(rng.randrange(3))
            texts.append(" ".join(v))
    texts += [None, "", "  ", "one", "one", "One two", texts[0]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("node", F.lit("clash"))
    sets = _sets(texts, k)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(df, k=k, num=num).collect()}
    assert got == {d: (len(s), c) for d, s, c in zip(ids, sets, _components(ids, sets, num, 100), strict=True)}


def test_jaccard_of_lists_with_three_members_in_two_parts(spark, monkeypatch):
    """Two sets link by frequent words only, whose salted lists hold a third, smaller set besides and nothing more."""
    monkeypatch.setattr(jaccard, "PART", 2)
    monkeypatch.setattr(jaccard, "PARTNERS", 1)
    monkeypatch.setattr(jaccard, "SMALL_LIMIT", 0)
    texts = []
    for g in range(30):
        words, own = [f"g{g}w{i}" for i in range(9)], iter(range(10_000))
        more = lambda n: [f"g{g}x{next(own)}" for _ in range(n)]  # noqa: B023, E731
        texts += [words + more(1), words + more(1), words[:7], words[7:] + more(30)] + [words + more(30) for _ in range(10)]
    texts = [" ".join(w) for w in texts]
    sets, ids = _sets(texts, 1), list(range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in jaccard.link(df, k=1, num=80).collect()}
    assert got == dict(zip(ids, _components(ids, sets, 80, 100), strict=True))


@pytest.mark.parametrize("size", [12, 120])
def test_jaccard_of_null_and_repeated_ids(spark, size):
    """Texts in chains, a neighbour like the next and unlike the one after, under ids that are null or stand for several texts."""
    rng, rows = random.Random(size), []
    step = max(1, size // 15)
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(size + 4 * step)]
        texts = [" ".join(words[j * step : j * step + size]) for j in range(4)]
        ids = [rng.choice([None, None, 10 * g + 1, 10 * g + 2, 7]) for _ in texts]
        rows += list(zip(ids, texts, strict=True)) + [(ids[0], texts[0])]
    rows += [(None, None), (None, ""), (None, "alone in here"), (7, "one more text"), (7, None)]
    assert any(d is None for d, _ in rows)
    texts = [t for _, t in rows]
    sets = _sets(texts, 3)
    tags = _components(list(range(len(rows))), sets, 80, 100)
    least = {}
    for (d, _), c in zip(rows, tags, strict=True):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    want = sorted((str(d), len(s), str(least.get(c, d) if s else d)) for (d, _), s, c in zip(rows, sets, tags, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.link(df, k=3, num=80).collect())
    assert got == want


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _kept(docs, least):
    lines = [[tuple(x.split()) for x in t.split("\n")] for _, t in docs]
    places = [(d, i) for d in range(len(lines)) for i in range(len(lines[d]))]
    gone = set()
    for d, i in places:
        best = 0
        for e, j in places:
            if (e, j) >= (d, i):
                break
            n = 0
            while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                n += 1
            if sum(map(len, lines[d][i : i + n])) >= least:
                best = max(best, n)
        gone |= {(d, i + n) for n in range(best)}
    return {docs[d][0]: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, (_, t) in enumerate(docs)}


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(6)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 8]))) for _ in range(9)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 16)))) for i in range(70)] + [(500, ""), (501, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    want = _kept(docs, 7)
    assert sum(want[i] != t for i, t in docs) > 20
    assert {r.doc_id: r.text for r in linedup.dedup_lines(df, min_words=7).collect()} == want


def test_line_dedup_of_nulls_repeats_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(2, f"a\n{long}\nb"), (1, long), (3, None), (None, "x"), (2, f"a\n{long}\nb")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0), r.text) for r in linedup.dedup_lines(df).collect() if r.text is not None)
    assert rows == [(0, "x"), (1, long), (2, "a\nb"), (2, "a\nb")]
    assert linedup.dedup_lines(df.limit(0)).count() == 0


def _held(doc_id, by, rest):
    return zlib.crc32(str(doc_id).encode()) % by == rest


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = quality.fit(docs, train)
    rows = [r for r in quality.score(docs.withColumn("score", F.lit("clash")).drop("score"), model).collect() if r.doc_id in known and _held(r.doc_id, 4, 2)]
    assert sum((r.score >= 0.7) == bool(known[r.doc_id]) for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert quality.fit(docs, labels.limit(0)).score(__import__("pyarrow").array(["x"])).shape == (1,)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    model = toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    rows = [r for r in toxicity.score(docs, model).collect() if r.doc_id in known and _held(r.doc_id, 3, 1)]
    assert sum((r.score >= 0.7) == bool(known[r.doc_id]) for r in rows) >= 0.93 * len(rows)
    assert not any(r.score >= 0.7 and not known[r.doc_id] for r in rows)
    odd = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert all(0 <= r.score < 0.7 for r in toxicity.score(odd, model).collect())
    assert toxicity.fit(docs, labels.limit(0)).beta[0] < 0


def test_negation_report_and_targets_change_a_clause():
    g = toxicity.grammar()

    def weight(kinds):
        state, total = 0, 0.0
        for k in kinds:
            total += g.gain[state, k]
            state = g.step[state, k]
        return total

    plain = weight([toxicity.OTHER, toxicity.INSULT])
    assert weight([toxicity.TARGET, toxicity.INSULT]) > plain > weight([toxicity.NEGATION, toxicity.INSULT]) > 0
    assert weight([toxicity.REPORT, toxicity.OTHER, toxicity.INSULT]) < plain
    assert weight([toxicity.TARGET, toxicity.THREAT]) > weight([toxicity.THREAT])


def test_pipeline_takes_out_what_is_planted(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, prose(60)) for i in range(40)]
    item, passage = prose(20), prose(70)
    toxic = [(100 + i, prose(20) + " idiot " + prose(5) + " scum you moron. " + prose(5)) for i in range(30)]
    near = clean[0][1].rsplit(" ", 2)[0] + " other end"
    planted = [(200, clean[1][1]), (201, near), (202, f"{prose(5)} {item} {prose(5)}"), (203, f"{prose(30)}\n{passage}"), (204, f"{prose(30)}\n{passage}"), (205, None), (206, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + toxic + planted]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in range(100, 130))) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = C.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert all(r.round_trip for r in out)
    assert kept == {i for i, _ in clean} | {203, 204, 205, 206}


def test_pipeline_stages_drop_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as C

    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("etaoinsr") for _ in range(rng.randint(3, 9))) for _ in range(n))
    clean, other, item, lone, twice, late = prose(60), prose(60), prose(20), prose(60), prose(60), prose(60)
    bad = f"{prose(5)} {item} {prose(5)}"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    read = lambda out: order((r.doc_id, r.text) for r in out.collect())
    mixed = [(None, bad), (None, clean), (None, None), (7, bad), (7, other), (8, bad), (9, "")]
    assert read(C.drop_contaminated(spark, df(mixed), str(tmp_path))) == order([(None, clean), (None, None), (7, other), (9, "")])
    mixed = [(1, clean), (None, clean), (None, lone), (None, lone), (7, other), (7, clean), (8, twice), (8, twice), (8, late), (9, None), (9, None), (None, None)]
    want = [(1, clean), (None, lone), (7, other), (8, twice), (8, late), (9, None), (9, None), (None, None)]
    assert read(C.drop_near_duplicates(spark, df(mixed), str(tmp_path))) == order(want)


def test_round_trip_compares_bytes(spark, monkeypatch):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(1, "abc é"), (2, None), (None, "")], "doc_id long, text string")
    assert all(r.round_trip for r in C.tokenize(spark, docs, "").collect())
    decode = C.bpe.decode
    monkeypatch.setattr(C.bpe, "decode", lambda *a: decode(*a).withColumn("decoded", F.when(F.col("doc_id") == 1, F.encode(F.lit("xxxxxx"), "utf-8")).otherwise(F.col("decoded"))))
    assert {r.doc_id: r.round_trip for r in C.tokenize(spark, docs, "").collect()} == {1: False, 2: True, None: True}
