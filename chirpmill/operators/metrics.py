"""Quality of predictions. Rows are counted once into k x k cells; everything else reads those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.patterns import CLASSES, PREVIOUS_BEST, TARGET


def accuracy(df: DataFrame, label: str = "label_id", pred: str = "pred") -> DataFrame:
    """Share of rows that are right; a row without a prediction is a miss."""
    hit = F.coalesce(F.col(pred) == F.col(label), F.lit(False))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"))


def _or_zero(top: Column, bottom: Column) -> Column:
    """A ratio, 0 where it is undefined."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def confusion_matrix(df: DataFrame, label: str = "label_id", pred: str = "pred", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Rows actual, columns ``pred_<class>``; classes nobody has stay as zeros.

    A row whose prediction is missing or in no class is a miss: it counts in ``missed`` only. A label that is in
    no class is an error.
    """
    known = F.coalesce(F.col(label).isin(*range(len(classes))), F.lit(False))
    wrong = F.concat(F.lit("label in no class: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL")))
    counted = df.groupBy(F.when(known, F.col(label)).otherwise(F.raise_error(wrong)).alias("label_id")).agg(*[
        F.count(F.when(F.col(pred) == k, 1)).alias(f"pred_{name}") for k, name in enumerate(classes)
    ], F.count_if(~F.coalesce(F.col(pred).isin(*range(len(classes))), F.lit(False))).alias("missed"))
    every = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(name) for name in classes])).alias("label_id", "actual")
    )
    # the class list has one row per class
    joined = every.join(counted, "label_id", "left")
    return joined.select("label_id", "actual", *[
        F.coalesce(n, F.lit(0)).alias(n) for n in (*[f"pred_{n}" for n in classes], "missed")])


def per_class(matrix: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Precision, recall, F1 and support of each class from the confusion matrix (k rows)."""
    every = Window.partitionBy()
    columns = [F.col(f"pred_{n}") for n in classes]
    totals = [F.sum(c).over(every) for c in columns]

    def own(values: list[Column]) -> Column:
        return F.get(F.array(*values), F.col("label_id"))

    counted = matrix.select(
        "label_id", "actual", own(columns).alias("hits"), own(totals).alias("predicted"),
        sum(columns, F.col("missed")).alias("support"),
    )
    rated = counted.withColumns({
        "precision": _or_zero(F.col("hits"), F.col("predicted")),
        "recall": _or_zero(F.col("hits"), F.col("support")),
    })
    return rated.withColumn("f1", _or_zero(F.col("precision") * F.col("recall") * 2.0, F.col("precision") + F.col("recall")))


def _averages(rated: DataFrame) -> DataFrame:
    total = F.sum("support")
    scores = ("precision", "recall", "f1")
    return rated.agg(
        F.sum("hits").alias("hits"), total.alias("support"),
        *[(F.sum(F.col(s) * F.col("support")) / total).alias(f"weighted_{s}") for s in scores],
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
    )


def weighted_prf(df: DataFrame, label: str = "label_id", pred: str = "pred", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    return _averages(per_class(confusion_matrix(df, label, pred, classes), classes)).select(
        F.col("weighted_precision").alias("precision"), F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1")
    )


def classification_report(df: DataFrame, label: str = "label_id", pred: str = "pred",
                          classes: tuple[str, ...] = CLASSES, digits: int = 4) -> DataFrame:
    """A row per class, then accuracy, macro and weighted means."""
    rated = per_class(confusion_matrix(df, label, pred, classes), classes)
    totals = _averages(rated)
    none = F.lit(None).cast("double")
    summary = totals.select("support", F.inline(F.array(
        F.struct(F.lit(len(classes)).alias("row_order"), F.lit("accuracy").alias("name"), none.alias("precision"),
                 none.alias("recall"), (F.col("hits") / F.col("support")).alias("f1")),
        *[F.struct(F.lit(len(classes) + i).alias("row_order"), F.lit(f"{kind} avg").alias("name"),
                   F.col(f"{kind}_precision").alias("precision"), F.col(f"{kind}_recall").alias("recall"),
                   F.col(f"{kind}_f1").alias("f1")) for i, kind in ((1, "macro"), (2, "weighted"))],
    )))
    rows = rated.select(F.col("label_id").alias("row_order"), F.col("actual").alias("name"), "precision", "recall", "f1", "support")
    return rows.unionByName(summary).select(
        "row_order", "name", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def per_class_accuracy(df: DataFrame, label: str = "label_id", pred: str = "pred", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Diagonal over row sum; NULL where a class has no rows."""
    rated = per_class(confusion_matrix(df, label, pred, classes), classes)
    return rated.select("actual", (F.col("hits") / F.nullif(F.col("support"), F.lit(0))).alias("accuracy"))


def target_gap(result: DataFrame, previous: float = PREVIOUS_BEST, target: float = TARGET) -> DataFrame:
    """Compare an accuracy with an earlier best and a target, in percent points."""
    gap = F.greatest((F.lit(target) - F.col("accuracy")) * 100.0, F.lit(0.0))
    return result.select(
        "accuracy", F.lit(previous).alias("previous_best"),
        ((F.col("accuracy") - F.lit(previous)) * 100.0).alias("improvement"),
        (F.col("accuracy") >= F.lit(target)).alias("passed"), gap.alias("gap"),
    )
