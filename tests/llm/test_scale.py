"""Hot names, memory, and growth with the size of a group."""

import random
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.llm import common, graph, jaccard


def test_hot_names_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.createDataFrame([(k if k < 5 else 9, v) for k in range(12) for v in range(3)], "name int, v int")
    one = common.stored(rows.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("low")))
    got = sorted(tuple(r) for r in common.joined_by(rows, one, ["name"], "n").select("name", "v", "n", "low").collect())
    assert got == sorted((k if k < 5 else 9, v, 3 if k < 5 else 21, 0) for k in range(12) for v in range(3))
    common.discard(one)


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    edges = [(0, k) for k in range(1, 60)] + [(100, 101), (101, 102), (103, 102), (59, 200)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(60), 200]} | {k: 100 for k in range(100, 104)}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Tasks join up what they hold, and stars are known as such; a round, and another that repeats it, ran here before."""
    seen, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda *a: seen.append(1) or star(*a))
    edges = [(k, k + 1) for k in range(-3, 30)] + [(50, k) for k in range(51, 60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    assert got == dict.fromkeys(range(-3, 31), -3) | dict.fromkeys(range(50, 60), 50) and not seen


@contextmanager
def _uncoalesced(spark):
    """Shuffles keep their partitions, however few rows these hold."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_of_few_edges_in_many_partitions_take_no_round(spark, monkeypatch):
    """Each partition holds a few edges of a long path; several rounds over all of them ran here before."""
    seen, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda *a: seen.append(1) or star(*a))
    nodes = list(range(-100, 100))
    random.Random(3).shuffle(nodes)
    edges = spark.createDataFrame([*zip(nodes, nodes[1:]), (500, 501), (7, 7), (600, 600)], "a long, b long").repartition(8)
    with _uncoalesced(spark):
        got = [(r.node, r.root) for r in graph.components(edges).collect()]
        none = graph.components(edges.where("a = b")).collect()
    assert sorted(got) == sorted((dict.fromkeys(nodes, -100) | {500: 500, 501: 500}).items()) and none == [] and not seen


def test_components_of_more_edges_than_a_task_joins_up(spark, monkeypatch):
    """Above the bound several tasks join up edges, and rounds between them go on."""
    seen, star = [], graph._star
    monkeypatch.setattr(graph, "_star", lambda *a: seen.append(1) or star(*a))
    monkeypatch.setattr(graph, "AT_ONCE", 30)
    nodes = list(range(-100, 100))
    random.Random(4).shuffle(nodes)
    edges = spark.createDataFrame([*zip(nodes, nodes[1:]), (500, 501)], "a long, b long").repartition(8)
    with _uncoalesced(spark):
        got = [(r.node, r.root) for r in graph.components(edges).collect()]
    assert sorted(got) == sorted((dict.fromkeys(nodes, -100) | {500: 500, 501: 500}).items()) and seen


def test_edges_are_joined_up_in_bounded_parts(monkeypatch):
    rng = random.Random(2)
    chain = [(k + 1, k) for k in range(-40, 60)]
    rng.shuffle(chain)
    for at_once in (3, 20, 1000):
        monkeypatch.setattr(graph, "AT_ONCE", at_once)
        parts = (pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in chain[i : i + 7]]) for i in range(0, len(chain), 7))
        out = [(r["a"], r["b"]) for p in graph._joined_up(parts) for r in p.to_pylist()]
        assert all(a > b for a, b in out)
        node, root = graph._forest(*np.array(out).T)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == dict.fromkeys(range(-39, 61), -40)


def test_the_driver_gives_memory_back(spark):
    assert common._trimmed(spark)


def test_candidates_of_a_group_of_near_copies_grow_with_its_members(spark, monkeypatch):
    """Twice the members may give about twice the pairs, not four times."""
    monkeypatch.setattr(jaccard, "SMALL_LIMIT", 0)
    found = {}
    for n in (60, 120):
        rng = random.Random(1)
        base = [f"w{i}" for i in range(120)]
        texts = []
        for k in range(n):
            words = list(base)
            words[rng.randrange(len(words))] = f"own{k}"
            texts.append((k, " ".join(words)))
        seen = []
        with monkeypatch.context() as m:
            for name in ("_neighbours", "_others"):
                made = getattr(jaccard, name)
                m.setattr(jaccard, name, lambda *a, made=made: seen.append(made(*a)) or seen[-1])  # noqa: B023
            counts = []
            verified = jaccard.components
            m.setattr(jaccard, "components", lambda e: counts.append(sum(q.count() for q in seen)) or verified(e))  # noqa: B023
            out = jaccard.link(spark.createDataFrame(texts, "doc_id long, text string"), k=3, num=90)
            assert {r.component_id for r in out.collect()} == {0}
        found[n] = max(counts)
    assert found[120] <= 3 * found[60] + 60
