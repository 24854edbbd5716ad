"""Epochs stop, restore, and go on."""

import math
import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from chirpmill.operators import epochs
from chirpmill.operators.epochs import Epochs, fit_epochs

PLAN = Epochs((2, 3, 2), epochs=8, patience=3, steps=2)


def table(spark, n, noise, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        x, y = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append(([x, y], int((x * y > 0) != (rng.random() < noise))))
    return spark.createDataFrame(rows, "v array<double>, label_id int").select(array_to_vector("v").alias("features"), "label_id").coalesce(1).cache()


@pytest.fixture(scope="module")
def sets(spark):
    return table(spark, 200, .3, 1), table(spark, 60, .3, 2)


def weights(run):
    return [round(w, 9) for w in run.model.weights]


def test_a_stopped_run_goes_on_to_the_same_winner(spark, sets, tmp_path, monkeypatch):
    whole = fit_epochs(*sets, PLAN, str(tmp_path / "whole"))
    real = epochs._evaluated

    class Stop(Exception):
        pass

    for lost in (2, 2):  # the machine stops after an epoch was fitted and saved but before it was judged
        def dying(model, val, label, seen=[]):
            seen.append(1)
            if len(seen) == lost:
                raise Stop
            return real(model, val, label)

        monkeypatch.setattr(epochs, "_evaluated", dying)
        with pytest.raises(Stop):
            fit_epochs(*sets, PLAN, str(tmp_path / "parts"))
    monkeypatch.setattr(epochs, "_evaluated", real)
    again = fit_epochs(*sets, PLAN, str(tmp_path / "parts"))
    close = lambda run: [(r.epoch, round(r.val_accuracy, 9), round(r.val_loss, 6), r.chosen) for r in run.history.collect()]
    assert close(again) == close(whole) and weights(again) == weights(whole)
    # a finished run is only read again
    monkeypatch.setattr(epochs, "MultilayerPerceptronClassifier", None)
    assert weights(fit_epochs(*sets, PLAN, str(tmp_path / "parts"))) == weights(whole)


def test_the_best_epoch_is_restored_and_patience_ends_the_run(spark, sets, tmp_path, monkeypatch):
    said = iter([(.5, 1.0), (.8, .9), (.7, .8), (.8, .7), (.6, .7)])
    monkeypatch.setattr(epochs, "_evaluated", lambda *_: next(said))
    run = fit_epochs(*sets, PLAN, str(tmp_path / "run"))
    assert [(r.epoch, r.chosen) for r in run.history.collect()] == [(1, False), (2, True), (3, False), (4, False), (5, False)]
    second = fit_epochs(*sets, Epochs((2, 3, 2), epochs=2, patience=3, steps=2), str(tmp_path / "run"))
    assert weights(second) == weights(run)
    last = epochs.MultilayerPerceptronClassificationModel.load(str(tmp_path / "run" / "epoch-5"))
    assert [round(w, 9) for w in last.weights] != weights(run)


def test_each_epoch_goes_on_from_the_one_before(spark, sets, tmp_path):
    one = fit_epochs(*sets, Epochs((2, 3, 2), epochs=1, steps=3), str(tmp_path / "one"))
    two = fit_epochs(*sets, Epochs((2, 3, 2), epochs=2, steps=3), str(tmp_path / "one"))
    learner = epochs.MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label_id", layers=[2, 3, 2], maxIter=3, tol=0.0, seed=42).setInitialWeights(one.model.weights)
    expected = learner.fit(sets[0])
    saved = epochs.MultilayerPerceptronClassificationModel.load(str(tmp_path / "one" / "epoch-2"))
    assert [round(w, 9) for w in saved.weights] == [round(w, 9) for w in expected.weights]
    assert two.history.count() == 2


def test_judged_by_accuracy_and_loss_in_one_pass(spark, sets, tmp_path):
    run = fit_epochs(*sets, Epochs((2, 3, 2), epochs=1), str(tmp_path / "run"))
    rows = run.model.transform(sets[1]).select("label_id", "prediction", vector_to_array("probability").alias("p")).collect()
    row = run.history.first()
    assert row.val_accuracy == pytest.approx(sum(r.label_id == r.prediction for r in rows) / len(rows))
    assert row.val_loss == pytest.approx(sum(-math.log(r.p[r.label_id]) for r in rows) / len(rows))


def test_the_step_halves_on_a_plateau():
    plan = Epochs((2, 2), solver="gd", step_size=.8, plateau=3)
    losses = [1.0, .9, .9, .95, .9, .5, .6, .6, .6]
    history = [(i + 1, .5, v, 0.0) for i, v in enumerate(losses)]
    assert [epochs._next_step(history[:i], plan) for i in range(10)] == [.8] * 5 + [.4] * 4 + [.2]


def test_another_run_in_the_folder_is_an_error(spark, sets, tmp_path):
    fit_epochs(*sets, Epochs((2, 3, 2), epochs=1), str(tmp_path / "run"))
    with pytest.raises(ValueError, match="other rows or settings"):
        fit_epochs(sets[0].limit(100), sets[1], Epochs((2, 3, 2), epochs=1), str(tmp_path / "run"))
    with pytest.raises(ValueError, match="other rows or settings"):
        fit_epochs(*sets, Epochs((2, 4, 2), epochs=1), str(tmp_path / "run"))


def test_rows_key_sees_values_and_not_places(spark, sets):
    key = epochs.rows_key(sets[0], "features", "label_id")
    assert key == epochs.rows_key(sets[0].repartition(7), "features", "label_id")
    assert key != epochs.rows_key(sets[0].withColumn("label_id", 1 - F.col("label_id")), "features", "label_id")
    assert key != epochs.rows_key(sets[0].unionByName(sets[0].limit(1)).unionByName(sets[0].limit(1)), "features", "label_id")
