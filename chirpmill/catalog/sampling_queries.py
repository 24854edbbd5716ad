"""Labels, weights, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import SEED, TEST_SHARE
from ..functions.text import decode_label
from ..operators import labels, sampling
from ..plans import training
from ..session import stage
from ..sources.posts import labeled, posts
from . import sql as q
from .registry import register


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned labelled posts, written once: later passes read keys only."""
    return stage(training.prepare(labeled(spark, folder)), "prepared")


def balanced_keys(spark: SparkSession, folder: str) -> DataFrame:
    return training.training_keys(prepared(spark, folder))


@register("filter_class", f"with {q.LABELED} select post_id, text, label_id from labeled where label_id = 0")
def filter_class(spark: SparkSession, folder: str) -> DataFrame:
    return labeled(spark, folder).where(F.col("label_id") == 0).select("post_id", "text", "label_id")


@register("label_encode", f"""with {q.POSTS}, named as (select distinct sentiment from posts where sentiment is not null)
select post_id, sentiment, cast(label_id as integer) as label_id from posts
join (select sentiment, row_number() over (order by sentiment) - 1 as label_id from named) using (sentiment)""")
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    found = posts(spark, folder).where(F.col("sentiment").isNotNull()).select("post_id", "sentiment")
    return labels.encode_labels(found, labels.fit_labels(found, "sentiment"), "sentiment").select("post_id", "sentiment", "label_id")


@register("label_decode", f"""with {q.LABELED}, moved as (select post_id, label_id + cast(post_id % 2 as integer) as pred from labeled)
select post_id, cast(pred as integer) as pred,
       case pred when 0 then 'Negative' when 1 then 'Neutral' when 2 then 'Positive' else 'Unknown' end as name from moved""")
def label_decode(spark: SparkSession, folder: str) -> DataFrame:
    moved = labeled(spark, folder).select("post_id", (F.col("label_id") + (F.col("post_id") % 2).cast("int")).alias("pred"))
    return moved.select("post_id", "pred", decode_label(F.col("pred")).alias("name"))


@register("class_sizes", f"with {q.LABELED} select label_id, count(*) as n from labeled group by label_id")
def class_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return labels.class_sizes(labeled(spark, folder))


@register("class_weights", f"""with {q.SPLIT3}
select label_id, count(*) as n,
       round((sum(count(*)) over ())::double / (count(*) over () * count(*)), 6) as weight
from assigned where split = 'train' group by label_id""")
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    train = balanced_keys(spark, folder).where("split = 'train'")
    return labels.class_weights(train).select("label_id", "n", F.round("weight", 6).alias("weight"))


@register("attach_class_weight", f"""with {q.SPLIT3}, weights as (
  select label_id, (sum(count(*)) over ())::double / (count(*) over () * count(*)) as weight
  from assigned where split = 'train' group by label_id)
select post_id, draw_no, label_id, round(weight, 6) as weight from assigned join weights using (label_id)""")
def attach_class_weight(spark: SparkSession, folder: str) -> DataFrame:
    keys = balanced_keys(spark, folder)
    weights = labels.class_weights(keys.where("split = 'train'"))
    return labels.attach_class_weight(keys, weights).select("post_id", "draw_no", "label_id", F.round("weight", 6).alias("weight"))


@register("resample_class", f"with {q.RESAMPLED} select post_id, label_id, draw_no from resampled")
def resample_class(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.resample(prepared(spark, folder))


@register("balanced_union", f"with {q.RESAMPLED} select post_id, label_id, draw_no from balanced")
def balanced_union(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.balance(prepared(spark, folder))


@register("shuffle_rank", f"""with {q.RESAMPLED}
select post_id, label_id, draw_no, row_number() over (order by md5('{SEED}:' || post_id || ':' || draw_no)) as shuffle_rank
from balanced""")
def shuffle_rank(spark: SparkSession, folder: str) -> DataFrame:
    balanced = stage(sampling.balance(prepared(spark, folder)), "balanced")
    return sampling.shuffle_rank(balanced, training.ROW_KEYS)


@register("stratified_split", f"""with {q.LABELED}, {q.split('labeled', f"md5('{SEED}:' || post_id)", TEST_SHARE, 0.0)}
select post_id, label_id, split from assigned""")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    keys = labeled(spark, folder).select("post_id", "label_id")
    return sampling.stratified_split(keys, ["post_id"])


@register("split3", f"with {q.SPLIT3} select post_id, draw_no, label_id, split from assigned")
def split3(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_keys(spark, folder)


@register("split_sizes", f"with {q.SPLIT3} select split, count(*) as n from assigned group by split")
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split_sizes(balanced_keys(spark, folder))
