"""Training by epochs: stop when validation no longer improves, go back to the best epoch, go on after a break.

The perceptron learns ``STEPS`` optimiser steps an epoch and starts each from the weights of the one before. After every
epoch the model is saved below ``path`` and its accuracy and mean log loss on the validation rows are added to the history
there, so a run that is started again with the same path goes on behind the last saved epoch; ``path`` should lie in the
shared folder. Runs of other settings or rows are told apart by a key, and a folder that holds another run is an error.

Accuracy decides: the best epoch is the first that reaches the highest one, and training ends ``patience`` epochs after it.
With the solver ``gd`` the step size halves whenever the loss has not fallen for ``plateau`` epochs.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SEED
from ..session import read_if_written
from .manifest import rows_key, text_key

# --- Fixed values: must equal the rules being matched ---
EPOCHS = 50
PATIENCE = 10
PLATEAU, FACTOR, LEAST_STEP = 3, 0.5, 1e-7
# ---
STEPS = 5
LEAST_LOSS = 1e-15
HISTORY = "epoch int, val_accuracy double, val_loss double, step_size double"


@dataclass(frozen=True)
class Epochs:
    """How long to train and when to stop."""

    layers: tuple[int, ...]
    epochs: int = EPOCHS
    patience: int = PATIENCE
    steps: int = STEPS
    plateau: int = PLATEAU
    solver: str = "l-bfgs"
    step_size: float = 0.03
    block_size: int = 128
    seed: int = SEED


@dataclass
class EpochRun:
    """The model of the best epoch, and a row for each epoch with ``chosen`` on that one."""

    model: MultilayerPerceptronClassificationModel
    history: DataFrame


def _evaluated(model: MultilayerPerceptronClassificationModel, val: DataFrame, label: str) -> tuple[float, float]:
    probs = vector_to_array(model.getProbabilityCol())
    likely = F.get(probs, F.col(label).cast("int"))
    hit = F.coalesce((F.col(model.getPredictionCol()) == F.col(label)).cast("double"), F.lit(0.0))
    found = model.transform(val).agg(
        F.avg(hit), F.avg(-F.log(F.greatest(F.coalesce(likely, F.lit(0.0)), F.lit(LEAST_LOSS))))).first()
    return found[0] or 0.0, found[1] if found[1] is not None else float("inf")


def _best(history: list[tuple]) -> tuple:
    return max(history, key=lambda e: (e[1], -e[0]))


def _next_step(history: list[tuple], plan: Epochs) -> float:
    """The step size of the next epoch: halved after each ``plateau`` epochs without a lower loss."""
    step, least, waited = plan.step_size, float("inf"), 0
    for _, _, loss, _ in history:
        if loss < least:
            least, waited = loss, 0
        else:
            waited += 1
            if waited >= plan.plateau:
                step, waited = max(step * FACTOR, LEAST_STEP), 0
    return step


def _read_history(spark, path: str, key: str) -> list[tuple]:
    """Epochs saved by an earlier run; an epoch counts once its row is written, which comes after its model."""
    written = read_if_written(spark, f"{path}/run", "key string")
    said = written.first() if written is not None else None
    if said is None:
        spark.createDataFrame([], HISTORY).write.mode("overwrite").parquet(f"{path}/history")
        spark.createDataFrame([(key,)], "key string").coalesce(1).write.mode("overwrite").parquet(f"{path}/run")
        return []
    if said["key"] != key:
        raise ValueError(f"{path} holds the run of other rows or settings")
    return sorted(tuple(r) for r in spark.read.schema(HISTORY).parquet(f"{path}/history").collect())


def fit_epochs(train: DataFrame, val: DataFrame, plan: Epochs, path: str, features: str = "features", label: str = "label_id",
               outputs: dict[str, str] | None = None) -> EpochRun:
    """Train until validation has not improved for ``plan.patience`` epochs, and restore the best epoch.

    ``train`` and ``val`` are read every epoch and should be written tables with the feature vectors ready.
    """
    spark = train.sparkSession
    settings = {k: v for k, v in asdict(plan).items() if k not in ("epochs", "patience")}
    key = text_key([settings, features, label, outputs, rows_key(train, features, label), rows_key(val, features, label)])
    history = _read_history(spark, path, key)
    where = lambda epoch: f"{path}/epoch-{epoch}"
    load = MultilayerPerceptronClassificationModel.load
    last = load(where(history[-1][0])) if history else None
    while len(history) < plan.epochs and (not history or history[-1][0] - _best(history)[0] < plan.patience):
        epoch, step = len(history) + 1, _next_step(history, plan)
        learner = MultilayerPerceptronClassifier(
            featuresCol=features, labelCol=label, layers=list(plan.layers), maxIter=plan.steps, tol=0.0, seed=plan.seed,
            blockSize=plan.block_size, solver=plan.solver, stepSize=step, **(outputs or {}))
        if last is not None:
            learner = learner.setInitialWeights(last.weights)
        last = learner.fit(train)
        last.write().overwrite().save(where(epoch))
        row = (epoch, *(float(v) for v in _evaluated(last, val, label)), float(step))
        spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("append").parquet(f"{path}/history")
        history.append(row)
    if not history:
        raise ValueError("no epoch was asked for")
    best = _best(history)[0]
    return EpochRun(load(where(best)), spark.createDataFrame(
        [(*e, e[0] == best) for e in history], f"{HISTORY}, chosen boolean"))
