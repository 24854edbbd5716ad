"""Raw posts to sentiment names, in batch or, unchanged, on a stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import BLANK_MESSAGE, CLASSES
from ..functions.text import blank_guard, decode_label, is_blank
from ..functions.arrays import argmax
from ..operators.cleaning import with_cleaned
from ..operators.ensemble import combine
from ..operators.members import predict_together, predicted, with_tokens
from .training import Trained


def score(df: DataFrame, model: PipelineModel, model_id: int, cleaner: str, keep: list[str], text: str = "text",
          classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Add ``sentiment``: the named class, or the fixed message for a blank text.

    Stateless and row by row, with the cleaner the model was trained with.
    """
    given = df.withColumn("given", F.coalesce(F.col(text), F.lit("")))
    scored = predicted(model, with_tokens(with_cleaned(given, cleaner, "given"), cleaner=cleaner))
    name = decode_label(F.col(f"prediction_{model_id}").cast("int"), classes)
    return scored.select(*keep, blank_guard(F.col("given"), name).alias("predicted_sentiment"))


@dataclass
class Ensemble:
    """What it takes to score with all members: fitted pipelines, their weights, the combination and the cleaner."""

    models: dict[int, PipelineModel]
    weights: dict[int, float]
    method: str
    cleaner: str
    classes: tuple[str, ...] = CLASSES


def ensemble_of(run: Trained) -> Ensemble:
    """The members of a run with the combination it chose."""
    return Ensemble(run.models, run.weights, run.best.first()["method"], run.cleaner, run.classes)


def save_ensemble(found: Ensemble, spark: SparkSession, path: str) -> None:
    for m, model in found.models.items():
        model.write().overwrite().save(f"{path}/member_{m}")
    spark.createDataFrame([(m, found.weights[m], found.method, found.cleaner, list(found.classes)) for m in found.models],
                          "model_id int, weight double, method string, cleaner string, classes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_ensemble(spark: SparkSession, path: str) -> Ensemble:
    rows = spark.read.parquet(f"{path}/settings").orderBy("model_id").collect()
    return Ensemble({r["model_id"]: PipelineModel.load(f"{path}/member_{r['model_id']}") for r in rows},
                    {r["model_id"]: r["weight"] for r in rows}, rows[0]["method"], rows[0]["cleaner"], tuple(rows[0]["classes"]))


def ready(df: DataFrame, cleaner: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``cleaned_text`` and whether the text is ``blank``: all that scoring reads of a text."""
    given = df.withColumn("given", F.coalesce(F.col(text), F.lit("")))
    return with_cleaned(given, cleaner, "given").select(*keep, is_blank(F.col("given")).alias("blank"), "cleaned_text")


def score_ensemble(df: DataFrame, found: Ensemble, keep: list[str], text: str = "text", is_ready: bool = False) -> DataFrame:
    """Add ``sentiment`` as ``score`` does, by the combination of all members; row by row, so for a stream as well.

    Texts that are scored more than once may be made ``ready`` before, with the cleaner of the ensemble: ``is_ready`` says so.
    """
    texts = df if is_ready else ready(df, found.cleaner, keep, text)
    wide = predict_together(with_tokens(texts, cleaner=found.cleaner), found.models, [*keep, "blank"])
    scores = combine(wide, found.method, found.weights, tuple(found.models), len(found.classes))
    name = decode_label(argmax(scores), found.classes)
    return wide.select(*keep, F.when(F.col("blank"), F.lit(BLANK_MESSAGE)).otherwise(name).alias("predicted_sentiment"))
