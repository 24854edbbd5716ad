"""The posts table and the views made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a small scan out over all cores before heavy work on each row.

    For plain scans only. A scan with as many splits as cores, as any large one has, is left alone, so what
    is moved never exceeds one split per core.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def documents(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Posts without their labels: no join, for every report that does not ask for sentiment."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("post_id"), "text", "lang", F.col("source").alias("brand"), *extra
    )


def _sentiment() -> Column:
    return (
        F.when(F.col("toxic") == 1, F.lit("negative"))
        .when(F.col("quality") == 1, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def _sentiments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(
        F.col("doc_id").alias("post_id"), _sentiment().alias("sentiment")
    )


def with_sentiment(df: DataFrame, folder: str) -> DataFrame:
    """Add ``sentiment``, NULL where nobody labelled the post."""
    return df.join(_sentiments(df.sparkSession, folder), "post_id", "left")


def posts(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """All posts with their sentiment."""
    return with_sentiment(documents(spark, folder, extra), folder)


def measured(spark: SparkSession, folder: str, measure, extra: tuple[str, ...] = ()) -> DataFrame:
    """All posts with ``measure`` of the text in place of the text: what it gives is all that the join moves."""
    return with_sentiment(documents(spark, folder, extra).withColumn("text", measure("text")), folder)


def labeled(spark: SparkSession, folder: str) -> DataFrame:
    """Posts with a sentiment and its id (alphabetical, from 0)."""
    label_id = F.when(F.col("sentiment") == "negative", 0).when(F.col("sentiment") == "neutral", 1).otherwise(2)
    return (
        spread(documents(spark, folder).select("post_id", "text", "brand"), "post_id")
        .join(_sentiments(spark, folder), "post_id")
        .withColumn("label_id", label_id)
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the posts, web pages and conversations tables under one string key."""
    docs = table(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("text_key"), "text")
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("text_key"), F.col("html").alias("text")
    )
    talks = table(spark, folder, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("text_key"), "text"
    )
    return (
        spread(docs, "text_key").unionByName(spread(pages, "text_key")).unionByName(spread(talks, "text_key"))
    )
