"""Selection of papers that are relevant and unlike one another, against a plain loop."""

import random

from paperloom.operators import assess as A
from paperloom.operators import papers as P


def _alike(a, b):
    n = max(len(a), len(b))
    a, b = a + [0] * (n - len(a)), b + [0] * (n - len(b))
    top = sum(map(max, a, b))
    return sum(map(min, a, b)) / top if top else 0.0


def _picked(rows, k, weight):
    left = sorted(sorted(rows, key=lambda r: (-r[1], r[0]))[:15])
    out = []
    while left and len(out) < k:
        gain = lambda r: round(weight * r[1] - (1 - weight) * max((_alike(r[2], o[2]) for o in out), default=0.0), 6)  # noqa: B023, E731
        best = min(left, key=lambda r: (-gain(r), r[0]))
        left.remove(best)
        out.append((*best, gain(best)))
    return [(r[0], i, r[3]) for i, r in enumerate(out, 1)]


def test_selection_against_a_plain_loop(spark):
    rng = random.Random(2)
    ideas = {i: [(p, round(rng.random(), 1), [round(rng.random(), 1) for _ in range(rng.choice([0, 3, 3]))]) for p in rng.sample(range(100), n)] for i, n in enumerate([1, 3, 5, 12, 30])}
    flat = [(i, *r) for i, rows in ideas.items() for r in rows]
    df = spark.createDataFrame(flat, "idea_id int, paper_id long, relevance double, covers array<double>")
    for k, weight in ((5, 0.7), (3, 0.2), (20, 1.0)):
        got = {}
        for r in P.diverse(df, k, weight).orderBy("idea_id", "rank").collect():
            got.setdefault(r.idea_id, []).append((r.paper_id, r["rank"], r.gain))
        assert got == {i: _picked(rows, k, weight) for i, rows in ideas.items()}


def test_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, 2, 0.5, [1.0]), (1, 1, 0.5, [1.0]), (1, 3, None, None), (1, 4, 0.4, [None, 1.0])], "idea_id int, paper_id long, relevance double, covers array<double>")
    assert [(r.paper_id, r["rank"]) for r in P.diverse(df).orderBy("rank").collect()] == [(1, 1), (4, 2), (2, 3), (3, 4)]
    assert P.diverse(df.limit(0)).count() == 0


def test_gain_is_rounded_as_in_the_sql(spark):
    """0.7 * 0.000365 is told as 0.0002555, but its millionths lie below the half."""
    df = spark.createDataFrame([(1, 90, 0.000365, [0.1])], "idea_id int, paper_id long, relevance double, covers array<double>")
    assert P.diverse(df).first().gain == 0.000255


def test_mean_overlap_does_not_depend_on_the_order_of_its_sum(spark):
    """0.04 + 0.25 + 0.181818, a quarter of which ends in a 5, is 0.47181799999999996 in this order and 0.471818 in others."""
    s = spark.createDataFrame([(1, i, "") for i in range(4)], "idea_id int, sentence_index int, sentence string")
    for order in ([0.04, 0.25, 0.181818], [0.181818, 0.25, 0.04]):
        o = spark.createDataFrame([(1, i, 7, v) for i, v in enumerate(order)], "idea_id int, sentence_index int, paper_id long, overlap double").coalesce(1)
        assert A.candidates(s, o).first()["mean"] == 0.117955
