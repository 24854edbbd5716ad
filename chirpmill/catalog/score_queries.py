"""Combining and judging scores.

The scores are four invented members whose class scores are computed from the labelled posts, so the
rules can be checked exactly without a trained model.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import argmax, softmax
from ..operators import ensemble, metrics
from ..sources.posts import labeled
from . import sql as q
from .registry import register

KEYS = ["post_id", "label_id", "split"]


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Long scores of the invented members: ``post_id, label_id, split, model_id, s0..s2, p0..p2``."""
    rows = labeled(spark, folder).select(
        "post_id", "label_id", F.when(F.col("post_id") % 5 == 0, "val").otherwise("test").alias("split"),
        F.explode(F.array(*[F.lit(m) for m in ensemble.MEMBERS])).alias("model_id"),
    )

    def raw(k: int):
        seed = F.col("post_id") * 31 + F.col("model_id") * 101 + k * 53
        return 1 + (seed * seed) % 1009 + F.when(F.col("label_id") == k, F.col("model_id") * 100).otherwise(0)

    drawn = rows.select("*", *[raw(k).alias(f"s{k}") for k in range(3)])
    total = reduce(add, [F.col(f"s{k}") for k in range(3)]).cast("double")
    return drawn.select("*", *[(F.col(f"s{k}").cast("double") / total).alias(f"p{k}") for k in range(3)])


def wide(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.align_scores(scores(spark, folder), KEYS)


def weights(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.ensemble_weights(scores(spark, folder).where("split = 'val'"))


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.with_methods(wide(spark, folder).where("split = 'test'"), weights(spark, folder))


def averaged(spark: SparkSession, folder: str) -> DataFrame:
    """Test posts with the prediction of the mean, for the metrics."""
    test = wide(spark, folder).where("split = 'test'")
    return test.select("post_id", "label_id", argmax(ensemble.combine(test, "Average")).alias("pred"))


_wide_columns = ", ".join(f"round(m{m}_p{k}, 6) as m{m}_p{k}" for m in ensemble.MEMBERS for k in range(3))


@register("align_scores", f"with {q.aligned()} select post_id, label_id, split, {_wide_columns} from wide")
def align_scores(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder).select(*KEYS, *[
        F.round(f"m{m}_p{k}", 6).alias(f"m{m}_p{k}") for m in ensemble.MEMBERS for k in range(3)
    ])


@register("argmax_class", f"""with {q.SCORES}
select post_id, model_id, {q.argmax('p0', 'p1', 'p2')} as pred, round(greatest(p0, p1, p2), 6) as confidence from scores""")
def argmax_class(spark: SparkSession, folder: str) -> DataFrame:
    probs = F.array("p0", "p1", "p2")
    return scores(spark, folder).select(
        "post_id", "model_id", argmax(probs).alias("pred"), F.round(F.array_max(probs), 6).alias("confidence"))


@register("softmax_scores", f"""with {q.SCORES}, scaled as (
  select post_id, model_id, s0 / 1000::double as a, s1 / 1000::double as b, s2 / 1000::double as c from scores),
powers as (select *, exp(a - greatest(a, b, c)) as x, exp(b - greatest(a, b, c)) as y, exp(c - greatest(a, b, c)) as z from scaled)
select post_id, model_id, round(x / (x + y + z), 6) as p0, round(y / (x + y + z), 6) as p1, round(z / (x + y + z), 6) as p2
from powers""")
def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    shares = softmax([F.col(f"s{k}") / F.lit(1000.0) for k in range(3)])
    return scores(spark, folder).select("post_id", "model_id", *[F.round(c, 6).alias(f"p{k}") for k, c in enumerate(shares)])


@register("member_accuracy", f"""with {q.SCORES}
select model_id, split, round(avg(cast(({q.argmax('p0', 'p1', 'p2')}) = label_id as integer)), 6) as accuracy, count(*) as n
from scores group by model_id, split""")
def member_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    found = ensemble.member_accuracy(scores(spark, folder), ["model_id", "split"])
    return found.withColumn("accuracy", F.round("accuracy", 6))


@register("ensemble_weights", f"""with {q.methods()}
select model_id, round(accuracy, 6) as accuracy, round(weight, 6) as weight from weights""")
def ensemble_weights(spark: SparkSession, folder: str) -> DataFrame:
    return weights(spark, folder).select("model_id", F.round("accuracy", 6).alias("accuracy"), F.round("weight", 6).alias("weight"))


def _method(name: str, method: str, letter: str, digits: int | None) -> None:
    shown = [f"round({letter}{k}, {digits}) as score_{k}" if digits else f"cast({letter}{k} as integer) as score_{k}" for k in range(3)]

    @register(name, f"with {q.methods()} select post_id, label_id, {', '.join(shown)}, pred_{letter} as pred from predicted")
    def query(spark: SparkSession, folder: str) -> DataFrame:
        test = wide(spark, folder).where("split = 'test'")
        needed = weights(spark, folder) if method == "Weighted" else None
        combined = test.select("post_id", "label_id", ensemble.combine(test, method, needed).alias("scores"))
        columns = [F.get("scores", F.lit(k)) for k in range(3)]
        return combined.select(
            "post_id", "label_id",
            *[(F.round(c, digits) if digits else c).alias(f"score_{k}") for k, c in enumerate(columns)],
            argmax(F.col("scores")).alias("pred"))


_method("ensemble_average", "Average", "a", 6)
_method("ensemble_weighted", "Weighted", "w", 6)
_method("ensemble_vote", "Voting", "v", None)
_method("ensemble_confidence", "Confidence", "c", 6)

_compared = ", ".join(
    f"({i + 1}, '{m}', (select avg(cast(pred_{m[0].lower()} = label_id as integer)) from predicted))"
    for i, m in enumerate(ensemble.METHODS))
_compared = f"compared as (select * from (values {_compared}) t(method_order, method, accuracy))"


@register("ensemble_compare", f"with {q.methods()}, {_compared} select method_order, method, round(accuracy, 6) as accuracy from compared")
def ensemble_compare(spark: SparkSession, folder: str) -> DataFrame:
    return ensemble.compare_methods(predicted(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@register("best_method", f"""with {q.methods()}, {_compared}
select method_order, method, round(accuracy, 6) as accuracy from compared order by accuracy desc, method_order limit 1""")
def best_method(spark: SparkSession, folder: str) -> DataFrame:
    best = ensemble.best_method(ensemble.compare_methods(predicted(spark, folder)))
    return best.withColumn("accuracy", F.round("accuracy", 6))


@register("accuracy", f"with {q.methods()} select round(avg(cast(pred_a = label_id as integer)), 6) as accuracy, count(*) as n from predicted")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy(averaged(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@register("weighted_prf", f"""with {q.cells()}
select round(sum(precision * support) / sum(support)::double, 6) as precision,
       round(sum(recall * support) / sum(support)::double, 6) as recall,
       round(sum(f1 * support) / sum(support)::double, 6) as f1 from rated""")
def weighted_prf(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.weighted_prf(averaged(spark, folder))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@register("classification_report", f"""with {q.cells()}
select actual as row_order, name, round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1,
       cast(support as bigint) as support from rated
union all select 3, 'accuracy', null, null, round(sum(hits) / sum(support)::double, 4), cast(sum(support) as bigint) from rated
union all select 4, 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4), cast(sum(support) as bigint) from rated
union all select 5, 'weighted avg', round(sum(precision * support) / sum(support)::double, 4),
  round(sum(recall * support) / sum(support)::double, 4), round(sum(f1 * support) / sum(support)::double, 4),
  cast(sum(support) as bigint) from rated""")
def classification_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.classification_report(averaged(spark, folder))


@register("confusion_matrix", f"""with {q.cells()}
select actual as label_id, name as actual, cast(max(case when pred = 0 then n end) as bigint) as pred_negative,
       cast(max(case when pred = 1 then n end) as bigint) as pred_neutral,
       cast(max(case when pred = 2 then n end) as bigint) as pred_positive from cells group by cells.actual, cells.name""")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(averaged(spark, folder)).drop("missed")


@register("per_class_accuracy", f"with {q.cells()} select name as actual, round(hits / nullif(support, 0)::double, 6) as accuracy from rated")
def per_class_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_class_accuracy(averaged(spark, folder)).withColumn("accuracy", F.round("accuracy", 6))


@register("target_gap", f"""with {q.methods()}, a as (select avg(cast(pred_a = label_id as integer)) as accuracy from predicted)
select round(accuracy, 6) as accuracy, cast(0.8928 as double) as previous_best,
       round((accuracy - cast(0.8928 as double)) * 100, 6) as improvement, accuracy >= cast(0.90 as double) as passed,
       round(greatest((cast(0.90 as double) - accuracy) * 100, 0), 6) as gap from a""")
def target_gap(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.target_gap(metrics.accuracy(averaged(spark, folder)))
    return found.select(*[c if c in ("passed", "previous_best") else F.round(c, 6).alias(c) for c in found.columns])
