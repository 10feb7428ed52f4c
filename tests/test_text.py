from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import scores as S
from paperloom.functions import text as T
from paperloom.functions import vectors as V


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sentences_follow_the_worked_example(spark):
    text = "We use e.g. Graphs. It works! does it? Yes.\nÉtude here. Done now please."
    assert one(spark, T.sentences(F.col("t")), t=text) == ["We use e.g.", "Graphs.", "It works! does it?", "Yes.\nÉtude here.", "Done now please."]
    assert one(spark, T.idea_sentences(F.col("t")), t=text) == ["We use e.g.", "It works! does it?", "Yes.\nÉtude here.", "Done now please."]


def test_clean_text_follows_the_worked_example(spark):
    assert one(spark, T.clean(F.col("t")), t="  As in [12],  Fig. 3\tshows\n\n\n\nit [1, 2]. ") == "As in , Figure shows\n\nit [1, 2]."


def test_scores_follow_the_worked_examples(spark):
    rows = spark.createDataFrame([(0.42,), (0.55,), (0.90,), (1.0,), (0.0,)], "o double").select(S.originality(F.col("o")).alias("s")).collect()
    assert [r.s for r in rows] == [58, 44, 9, 0, 100]
    labels = spark.createDataFrame([(0.7,), (0.4,), (0.399,)], "o double").select(S.overlap_label(F.col("o")).alias("l")).collect()
    assert [r.l for r in labels] == ["low", "medium", "high"]
    bands = spark.createDataFrame([(70,), (40,), (39,)], "s int").select(S.score_label(F.col("s")).alias("l")).collect()
    assert [r.l for r in bands] == ["high", "medium", "low"]


def test_token_costs_follow_the_worked_examples(spark):
    assert abs(one(spark, S.token_cost(F.lit(1000), 0.8)) - 0.00012) < 1e-12
    assert abs(one(spark, S.token_cost(F.lit(1000), 0.7)) - 0.0001425) < 1e-12


def test_hashed_vectors_have_unit_length_or_are_zero(spark):
    rows = spark.createDataFrame([("graph neural nets",), ("",)], "t string").select(V.norm(V.hashed(F.col("t"))).alias("n")).collect()
    assert abs(rows[0].n - 1) < 1e-9 and rows[1].n == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=20))
def test_labels_fall_as_overlap_rises(spark, overlaps):
    rows = spark.createDataFrame([(o,) for o in sorted(overlaps)], "o double").select("o", S.overlap_label(F.col("o")).alias("l"), S.originality(F.col("o")).alias("s")).orderBy("o").collect()
    order = {"high": 0, "medium": 1, "low": 2}
    assert [order[r.l] for r in rows] == sorted(order[r.l] for r in rows)
    assert all(0 <= r.s <= 100 for r in rows)
