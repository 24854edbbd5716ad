"""Steps of a long run that are done once: each is saved under a key of what went into it, and loaded when it is there.

A run that was stopped finds its finished steps again; one with other rows or settings has other keys and finds none of
them. A step counts as done when its last file, the mark, is written, so a step that was stopped while saving is done anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_if_written

MARK = "name string, key string"


def rows_key(df: DataFrame, *columns: str) -> str:
    """A digest of the values of some columns that does not depend on the order or place of the rows."""
    values = [vector_to_array(c) if df.schema[c].dataType.typeName() == "vectorudt" else F.col(c) for c in columns]
    found = df.agg(F.count("*"), F.bit_xor(F.xxhash64(*values)), F.bit_xor(F.xxhash64(F.lit(1), *values)),
                   F.sum(F.xxhash64(F.lit(2), *values).cast("decimal(20,0)"))).first()
    return text_key([str(v) for v in found])


def text_key(settings) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def _stage_settings(stage) -> list:
    known = {p.name: str(v) for p, v in stage.extractParamMap().items() if not str(v).startswith(stage.uid)}
    fitted = []
    if isinstance(stage, CountVectorizerModel):
        fitted = [text_key(stage.vocabulary)]
    elif isinstance(stage, Word2VecModel):
        fitted = [rows_key(stage.getVectors(), "word", "vector")]
    return [type(stage).__name__, known, fitted]


def pipeline_key(pipeline: Pipeline) -> str:
    """What a pipeline would do: its stages and their settings, and what fitted stages in it hold."""
    return text_key([_stage_settings(s) for s in pipeline.getStages()])


def once(spark: SparkSession, path: str, name: str, key: str, make: Callable[[], PipelineModel]) -> PipelineModel:
    """The saved model of a step, or a new one that is saved now."""
    where = f"{path}/{name}-{key[:24]}"
    mark = read_if_written(spark, f"{where}/done", MARK)
    if mark is not None and (mark.first() or ("", ""))[1] == key:
        return PipelineModel.load(f"{where}/model")
    model = make()
    model.write().overwrite().save(f"{where}/model")
    spark.createDataFrame([(name, key)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{where}/done")
    return model
