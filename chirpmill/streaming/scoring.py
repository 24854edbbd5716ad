"""Scoring posts as they arrive in a folder."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.scoring import Ensemble, score, score_ensemble


def read_posts(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def score_stream(posts: DataFrame, model: PipelineModel, model_id: int, cleaner: str, keep: list[str],
                 sink: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Score a stream into Parquet, exactly once by the checkpoint.

    The same function as in batch; stateless and append-only, so no watermark is needed. By default
    everything that is there is scored and the query ends.
    """
    return _written(score(posts, model, model_id, cleaner, keep), sink, checkpoint, trigger)


def score_ensemble_stream(posts: DataFrame, found: Ensemble, keep: list[str], sink: str, checkpoint: str,
                          trigger: dict | None = None) -> StreamingQuery:
    """The same with all members and the combination that was chosen for them."""
    return _written(score_ensemble(posts, found, keep), sink, checkpoint, trigger)


def _written(scored: DataFrame, sink: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
