"""Vector lists against comparing all: clustered, scattered and odd vectors."""

import numpy as np
import pytest

from paperloom.operators import retrieval as R
from paperloom.operators import vector_lists as VL


def _frames(spark, x, q):
    store = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")
    return store, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, q array<double>")


def _rows(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("least", [None, 0.5])
def test_lists_find_what_comparing_all_finds(spark, least):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(30, 16)) * 4
    x = np.vstack([centre[rng.integers(0, 30, 900)] + rng.normal(size=(900, 16)) * 0.1, rng.normal(size=(100, 16)), np.zeros((2, 16)), np.ones((40, 16))])
    store, queries = _frames(spark, x, x[::37])
    lists = VL.build(store)
    assert _rows(VL.top_k(queries, lists, 5, least=least)) == _rows(R.top_k(queries, store, 5, least=least))
    share = VL.compared(queries, lists, 5).groupBy().sum("compared", "stored").first()
    assert share[0] < 0.35 * share[1]


def test_plan_has_no_cross_join_and_slices_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    store, queries = _frames(spark, x, x[:20])
    lists = VL.build(store)
    plan = VL.top_k(queries, lists, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    whole = _rows(VL.top_k(queries, lists, 3))
    monkeypatch.setattr(VL, "PAIRS", 3 * len(lists.count))
    assert _rows(VL.top_k(queries, lists, 3)) == whole == _rows(R.top_k(queries, store, 3))


def test_odd_vectors_ties_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (1, [0.0, 1.0]), (None, [0.5, 0.5])]
    store = spark.createDataFrame(rows, "id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 0.0]), (4, [])], "query_id long, q array<double>")
    got = VL.top_k(queries, VL.build(store), 3).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.similarity) for r in got] == [(1, 1, 1.0), (1, 2, 1.0), (1, None, 0.5)]
    assert VL.top_k(queries, VL.build(store.limit(0)), 3).count() == 0
    assert VL.top_k(queries.limit(0), VL.build(store), 3).count() == 0
