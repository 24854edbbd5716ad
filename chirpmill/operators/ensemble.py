"""Putting the members' probabilities together in four ways.

Scores are a long table ``(*keys, label, model_id, p0..pk)``; ``align_scores`` turns it into one row per
post. Members that score the same DataFrame are wide already and need no shuffle at all. Sums are
written out in model order, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import argmax

MEMBERS = (1, 2, 3, 4)
N_CLASSES = 3
METHODS = ("Average", "Weighted", "Voting", "Confidence")


def _p(model: int, k: int) -> str:
    return f"m{model}_p{k}"


def align_scores(scores: DataFrame, keys: list[str], models: tuple[int, ...] = MEMBERS, n_classes: int = N_CLASSES) -> DataFrame:
    """One row per post with the probabilities of every member side by side."""
    return scores.groupBy(*keys).agg(*[
        F.max(F.when(F.col("model_id") == m, F.col(f"p{k}"))).alias(_p(m, k))
        for m in models for k in range(n_classes)
    ])


def _probs(model: int, n_classes: int) -> Column:
    return F.array(*[F.col(_p(model, k)) for k in range(n_classes)])


def long_scores(wide: DataFrame, keys: list[str], models: tuple[int, ...] = MEMBERS, n_classes: int = N_CLASSES) -> DataFrame:
    """The reverse of ``align_scores``, without a shuffle."""
    rows = [F.struct(F.lit(m).alias("model_id"), *[F.col(_p(m, k)).alias(f"p{k}") for k in range(n_classes)]) for m in models]
    return wide.select(*keys, F.inline(F.array(*rows)))


def member_prediction(scores: DataFrame, n_classes: int = N_CLASSES) -> DataFrame:
    """Add each member's own class to the long scores."""
    return scores.withColumn("pred", argmax(F.array(*[F.col(f"p{k}") for k in range(n_classes)])))


def member_accuracy(scores: DataFrame, by: list[str], label: str = "label_id", n_classes: int = N_CLASSES) -> DataFrame:
    # as in ``metrics.accuracy``, a row without a prediction or label is a miss
    hit = F.coalesce(F.col("pred") == F.col(label), F.lit(False)).cast("double")
    return member_prediction(scores, n_classes).groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("n"))


def ensemble_weights(val_scores: DataFrame, label: str = "label_id", n_classes: int = N_CLASSES) -> DataFrame:
    """Validation accuracy squared, scaled to sum 1: one row per member."""
    accuracy = member_accuracy(val_scores, ["model_id"], label, n_classes)
    squared = F.pow("accuracy", F.lit(2.0))
    return accuracy.select("model_id", "accuracy", (squared / F.sum(squared).over(Window.partitionBy())).alias("weight"))


def _average(models: tuple[int, ...], n_classes: int) -> list[Column]:
    return [reduce(add, [F.col(_p(m, k)) for m in models]) / len(models) for k in range(n_classes)]


def _weighted(models: tuple[int, ...], n_classes: int, weights: DataFrame | dict[int, float]) -> list[Column]:
    if isinstance(weights, dict):
        return [reduce(add, [F.col(_p(m, k)) * F.lit(weights[m]) for m in models]) for k in range(n_classes)]
    # one row per member, read as one small map
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("model_id", "weight")))).scalar()
    return [reduce(add, [F.col(_p(m, k)) * F.element_at(table, F.lit(m)) for m in models]) for k in range(n_classes)]


def _votes(models: tuple[int, ...], n_classes: int) -> list[Column]:
    own = [argmax(_probs(m, n_classes)) for m in models]
    return [reduce(add, [F.when(pred == k, 1).otherwise(0) for pred in own]) for k in range(n_classes)]


def _confidences(models: tuple[int, ...], n_classes: int) -> list[Column]:
    own = [(argmax(_probs(m, n_classes)), F.array_max(_probs(m, n_classes))) for m in models]
    return [reduce(add, [F.when(pred == k, top).otherwise(0.0) for pred, top in own]) for k in range(n_classes)]


def combine(wide: DataFrame, method: str, weights: DataFrame | dict[int, float] | None = None,
            models: tuple[int, ...] = MEMBERS, n_classes: int = N_CLASSES) -> Column:
    """The class scores of one method as an array column for ``wide``; ties go to the lowest class."""
    if method == "Average":
        scores = _average(models, n_classes)
    elif method == "Weighted":
        scores = _weighted(models, n_classes, weights)
    elif method == "Voting":
        scores = _votes(models, n_classes)
    elif method == "Confidence":
        scores = _confidences(models, n_classes)
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.array(*scores)


def with_methods(wide: DataFrame, weights: DataFrame | dict[int, float], models: tuple[int, ...] = MEMBERS, n_classes: int = N_CLASSES) -> DataFrame:
    """Add the prediction of every method, ``pred_<method>``, in one pass."""
    return wide.withColumns({f"pred_{m}": argmax(combine(wide, m, weights, models, n_classes)) for m in METHODS})


def compare_methods(predicted: DataFrame, label: str = "label_id") -> DataFrame:
    """Accuracy of each method from one aggregation over the rows; a row without a prediction or label is a miss."""
    hit = lambda m: F.coalesce(F.col(f"pred_{m}") == F.col(label), F.lit(False)).cast("double")
    row = predicted.agg(*[F.avg(hit(m)).alias(m) for m in METHODS])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("method_order"), F.lit(m).alias("method"), F.col(m).alias("accuracy"))
        for i, m in enumerate(METHODS)
    ])))


def best_method(compared: DataFrame) -> DataFrame:
    """The most accurate method; the earlier one wins a tie."""
    return compared.orderBy(F.desc("accuracy"), "method_order").limit(1)
