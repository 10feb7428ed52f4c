"""Search in matrices against a plain loop over pairs: copies, ties, groups, slices, and no row for each pair."""

import numpy as np

from paperloom.operators import retrieval as R
from paperloom.operators import vector_lists as VL


def _data(spark, parts=3):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (60, 1)), np.tile(rng.integers(-2, 3, size=(10, 6)), (4, 1))]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    store = spark.createDataFrame([(i, [float(c) for c in v], i % 3 if i % 7 else None) for i, v in zip(ids, x, strict=True)], "id long, v array<float>, label int").repartition(parts)
    queries = store.where("id % 10 = 0").selectExpr("id as query_id", "v as q", "label")
    rows = {i: ([float(c) for c in v], i % 3 if i % 7 else None) for i, v in zip(ids, x, strict=True)}
    return store, queries, rows


def _dot(a, b):
    s = 0.0
    for x, y in zip(a, b, strict=True):
        s += x * y
    return s


def _plain(rows, k, least=None, same=False):
    out = set()
    for q in (i for i in rows if i % 10 == 0):
        found = [(-_dot(rows[q][0], v), i) for i, (v, label) in rows.items() if not same or (label is not None and label == rows[q][1])]
        found = sorted(f for f in found if least is None or -f[0] >= least)
        out |= {(q, i, -s, n) for n, (s, i) in enumerate(found[:k], 1)}
    return out


def _told(df):
    return {(r.query_id, r.id, r.similarity, r["rank"]) for r in df.collect()}


def test_matrices_find_what_a_loop_over_pairs_finds(spark, monkeypatch):
    store, queries, rows = _data(spark)
    for k, least, same in ((5, None, False), (3, 0.3, False), (4, None, True), (500, None, False)):
        assert _told(R.top_k(queries if same else queries.drop("label"), store, k, least=least, same="label" if same else None)) == _plain(rows, k, least, same)
    lists = VL.build(store.drop("label"))
    assert _told(VL.top_k(queries.drop("label"), lists, 5)) == _plain(rows, 5)
    monkeypatch.setattr(R, "PRODUCTS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        assert _told(R.top_k(queries.drop("label"), store, 5)) == _told(VL.top_k(queries.drop("label"), lists, 5)) == _plain(rows, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_best_of_groups(spark):
    store, queries, rows = _data(spark)
    got = {(r.query_id, r.label): r.similarity for r in R.best_per_group(queries.drop("label"), store, "label").collect()}
    want = {}
    for q in (i for i in rows if i % 10 == 0):
        for v, label in rows.values():
            want[q, label] = max(want.get((q, label), -np.inf), _dot(rows[q][0], v))
    assert got == want


def test_no_search_makes_a_row_of_each_pair(spark):
    store, queries, _ = _data(spark)
    q = queries.drop("label")
    lists = VL.build(store.drop("label"))
    for df in (R.top_k(q, store, 5), R.top_k(queries, store, 5, same="label"), R.best_per_group(q, store, "label"), VL.top_k(q, lists, 5)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan
