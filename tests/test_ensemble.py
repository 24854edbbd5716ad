"""Ties, averages and metrics on tables small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from chirpmill.functions.arrays import argmax
from chirpmill.operators import ensemble, metrics


def _wide(spark, rows):
    """rows: (label, [m1, m2, m3, m4]) with three probabilities each."""
    flat = [(i, label, *[x for m in members for x in m]) for i, (label, members) in enumerate(rows)]
    columns = ", ".join(f"m{m}_p{k} double" for m in ensemble.MEMBERS for k in range(3))
    return spark.createDataFrame(flat, f"post_id int, label_id int, {columns}")


def _pred(df, method, weights=None):
    return [r[0] for r in df.orderBy("post_id").select(argmax(ensemble.combine(df, method, weights))).collect()]


def test_first_class_wins_an_equal_row(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],), ([0.2, 0.4, 0.4],), ([0.0, 0.0, 1.0],)], "p array<double>")
    assert [r[0] for r in df.select(argmax(F.col("p"))).collect()] == [0, 1, 2]


A, B, C = [0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]


def test_even_votes_go_to_the_lower_class(spark):
    df = _wide(spark, [(0, [C, C, B, B]), (0, [C, B, A, C]), (0, [B, A, B, A])])
    assert _pred(df, "Voting") == [1, 2, 0]
    assert _pred(df, "Confidence") == [1, 2, 0]


def test_confidence_beats_the_count(spark):
    sure, unsure = [0.0, 0.0, 1.0], [0.34, 0.33, 0.33]
    df = _wide(spark, [(2, [sure, sure, unsure, unsure])])
    assert _pred(df, "Voting") == [0]
    assert _pred(df, "Confidence") == [2]


def test_weights_move_the_mean(spark):
    df = _wide(spark, [(1, [B, A, A, [0.5, 0.3, 0.2]])])
    weights = spark.createDataFrame([(1, 0.97), (2, 0.01), (3, 0.01), (4, 0.01)], "model_id int, weight double")
    assert _pred(df, "Average") == [0]
    assert _pred(df, "Weighted", weights) == [1]


def test_weights_sum_to_one(spark):
    long = ensemble.long_scores(_wide(spark, [(0, [A, B, A, C]), (1, [B, B, A, A])]), ["post_id", "label_id"])
    rows = {r["model_id"]: r["weight"] for r in ensemble.ensemble_weights(long).collect()}
    assert rows == pytest.approx({1: 1 / 1.5, 2: 0.25 / 1.5, 3: 0.25 / 1.5, 4: 0.0})


def test_long_and_wide_are_the_same(spark):
    df = _wide(spark, [(0, [A, B, A, C]), (1, [B, B, A, A])])
    back = ensemble.align_scores(ensemble.long_scores(df, ["post_id", "label_id"]), ["post_id", "label_id"])
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_earlier_method_wins_a_tie(spark):
    df = spark.createDataFrame([(1, "Average", 0.5), (2, "Weighted", 0.7), (3, "Voting", 0.7), (4, "Confidence", 0.7)],
                               "method_order int, method string, accuracy double")
    assert ensemble.best_method(df).first()["method"] == "Weighted"


@pytest.fixture(scope="module")
def judged(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(2, 0)] * 4
    return spark.createDataFrame(pairs, "label_id int, pred int")


def test_confusion_matrix_keeps_zeros(judged):
    rows = metrics.confusion_matrix(judged).orderBy("label_id").collect()
    assert [tuple(r)[2:] for r in rows] == [(5, 2, 0, 0), (1, 3, 0, 0), (4, 0, 0, 0)]


def test_absent_class_has_a_row(spark):
    df = spark.createDataFrame([(0, 0)], "label_id int, pred int")
    assert [tuple(r)[2:5] for r in metrics.confusion_matrix(df).orderBy("label_id").collect()] == [(1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_weighted_recall_is_accuracy(judged):
    prf = metrics.weighted_prf(judged).first()
    assert prf["recall"] == pytest.approx(metrics.accuracy(judged).first()["accuracy"])
    assert prf["precision"] == pytest.approx((0.5 * 7 + 0.6 * 4 + 0) / 15)


def test_report_agrees_with_the_spark_evaluator(judged):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    doubles = judged.select(F.col("label_id").cast("double").alias("label_id"), F.col("pred").cast("double").alias("pred"))
    prf = metrics.weighted_prf(judged).first()
    for metric, name in (("weightedPrecision", "precision"), ("weightedRecall", "recall"), ("f1", "f1")):
        found = MulticlassClassificationEvaluator(labelCol="label_id", predictionCol="pred", metricName=metric).evaluate(doubles)
        assert prf[name] == pytest.approx(found)


def test_target_gap(spark):
    df = spark.createDataFrame([(0.95,), (0.85,)], "accuracy double")
    a, b = metrics.target_gap(df).collect()
    assert (a["passed"], a["gap"]) == (True, 0.0)
    assert b["passed"] is False and b["gap"] == pytest.approx(5.0) and b["improvement"] == pytest.approx(-4.28)


def test_a_row_without_a_prediction_is_a_miss(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 7), (2, 2)], "label_id int, pred int")
    assert metrics.accuracy(df).first()["accuracy"] == 0.5
    report = {r["name"]: r for r in metrics.classification_report(df).collect()}
    assert report["accuracy"]["f1"] == 0.5 and report["accuracy"]["support"] == 4
    with pytest.raises(Exception, match="label in no class"):
        metrics.confusion_matrix(spark.createDataFrame([(9, 0)], "label_id int, pred int")).collect()
