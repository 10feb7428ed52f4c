"""Long words, hostile pages, triggers of the toxicity grammar, repeated ids."""

import random
import time

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from paperloom.llm import bpe, htmlmain, topk, toxicity

PATH = P.path("byte_bpe_50k.tiktoken")


def test_words_longer_than_a_part(spark):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    texts = ["a" * 5000, "哈" * 1500, "the" * 1000, "=-" * 1500, " " * 4097 + "x", letters, "aab" * 999, "x" * 512, "x" * 513]
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    df = spark.createDataFrame([(None if i == 0 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect():
        t = texts[r.doc_id or 0]
        assert list(r.ids) == own.encode_ordinary(t) and bytes(r.decoded).decode() == t


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<html><head><title>x</title><body><article><p>One two three.</p></article>", ["One two three."]),
        ("<head><title>x</title>Bare text", ["Bare text"]),
        ("<button>Go<p>Text here.</p>", ["Go", "Text here."]),
        ("<textarea>abc <p>Text here.</p>", ["Text here."]),
        ('<a href="x>link</a><p class="y">Text here.</p>', ["link", "Text here."]),
        ('<p title="a > b">Text here.</p>', ["Text here."]),
        ("<p>a &lt; b && c <3 d</p>", ["a < b && c <3 d"]),
        ("<script>var t='<p>no</p>'</script><p>yes</p>", ["yes"]),
    ],
)
def test_blocks_of_careless_pages(page, texts):
    assert [t for _, t, _ in htmlmain.blocks(page)] == texts


@pytest.mark.parametrize("part", ['<a "', '<a x="', '<b y=">" ', "<div>", "<p>a", "<!--", "<script>", "<textarea>", "<a x='", "</ ", "<![CDATA[", "<", "<button>", "&"])
def test_hostile_pages_take_linear_time(part):
    began = time.time()
    htmlmain.blocks(part * (1_000_000 // len(part)))
    assert time.time() - began < 10


def test_triggers_change_the_score_of_a_text():
    key = toxicity.word_key("scum")
    model = toxicity.Model(words=pa.array([int(key)], pa.uint64()).to_numpy(), word_weights=__import__("numpy").array([2.0]))
    model.beta[:] = [-3.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    plain, aimed, denied, told, none = model.score(pa.array(["this is scum", "he is scum", "this is not scum", "she said it was scum", "all is well"]))
    assert aimed > plain > denied > none and plain > told > none
    assert model.score(pa.array(["word. " * 50_000 + "scum"]))[0] == pytest.approx(plain, abs=0.2)


def test_of_vectors_under_one_id_the_smallest_counts(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.25, 0.0]), (2, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in topk.top_k(df).orderBy("rank").collect()] == [(1, 256 * 64), (2, 256 * 64)]
