"""Whole runs: any number of classes, stopped runs, early stop."""

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from chirpmill.operators import ensemble, manifest, members, metrics
from chirpmill.plans import scoring, training

WORDS = ["sad grey", "plain dull", "glad bright", "odd blue"]


def labelled(spark, k, n=120):
    rows = [(i, f"{WORDS[i % k]} day number w{i % 7} {WORDS[i % k]}", i % k) for i in range(n)]
    return spark.createDataFrame(rows, "post_id long, text string, label_id int")


@pytest.mark.parametrize("k", [2, 4])
def test_tables_of_two_and_of_four_classes_train_score_and_report(spark, tmp_path, k):
    run = training.fit(labelled(spark, k), ratios={1: .7})
    assert run.classes == tuple(f"class {i}" for i in range(k))
    assert all(model.stages[-1].numClasses == k for model in run.models.values())
    total = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0"))
    assert run.scores.where(F.abs(total - 1) > 1e-6).count() == 0 and f"p{k}" not in run.scores.columns
    report = {r["name"]: r for r in training.final_report(run).collect()}
    assert {f"class {i}" for i in range(k)} < set(report)
    found = scoring.ensemble_of(run)
    scoring.save_ensemble(found, spark, str(tmp_path / "e"))
    texts = spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(WORDS[:k])], "post_id long, text string")
    named = scoring.score_ensemble(texts, scoring.load_ensemble(spark, str(tmp_path / "e")), ["post_id"])
    assert {r.predicted_sentiment for r in named.collect()} <= {f"Class {i}" for i in range(k)}


def test_names_of_classes(spark):
    rows = labelled(spark, 2).withColumn("sentiment", F.when(F.col("label_id") == 0, "no").otherwise("yes"))
    assert training.class_names(rows) == ("no", "yes")
    assert training.class_names(rows.drop("sentiment"), ("a", "b", "c")) == ("a", "b", "c")
    assert training.class_names(rows.withColumn("sentiment", F.lit("neutral"))) == ("negative", "neutral", "positive")
    with pytest.raises(ValueError, match="4 classes"):
        training.class_names(labelled(spark, 4), ("a", "b"))


@pytest.fixture(scope="module")
def train(spark):
    rows = labelled(spark, 3).withColumnRenamed("text", "cleaned_text").withColumn("draw_no", F.lit(0)).withColumn("weight", F.lit(1.0))
    return members.with_tokens(rows).coalesce(1).cache()


def test_a_run_killed_after_two_members_fits_the_other_two_only(spark, train, tmp_path, monkeypatch):
    words = members.fitted_words(train)
    grams = members.fitted_grams(train, words)
    fits, dead = [], {3, 4}
    real = Pipeline.fit

    def fit(self, rows, *params):
        m = {"LogisticRegression": 1, "NaiveBayes": 2, "RandomForestClassifier": 3, "MultilayerPerceptronClassifier": 4}[
            type(self.getStages()[-1]).__name__]
        if m in dead:
            raise RuntimeError("killed")
        fits.append(m)
        return real(self, rows, *params)

    monkeypatch.setattr(Pipeline, "fit", fit)

    def run(reg=0.01):
        pipelines = members.member_pipelines(words, members.fit_word_vectors(train, words, size=4), grams)
        return members.fit_members(train, pipelines | {1: members.logistic_member(words, reg=reg)}, str(tmp_path / "kept"))

    with pytest.raises(RuntimeError, match="killed"):
        run()
    assert sorted(fits) == [1, 2]
    dead.clear()
    fits.clear()
    models = run()
    assert sorted(fits) == [3, 4] and sorted(models) == [1, 2, 3, 4]
    fits.clear()
    again = run()
    assert fits == []
    keep = ["post_id"]
    assert members.predict_proba(train, models, keep).collect() == members.predict_proba(train, again, keep).collect()
    run(reg=0.02)  # another setting of one member
    assert fits == [1]
    fits.clear()
    changed = train.withColumn("weight", F.col("weight") * 2)
    members.fit_members(changed, {2: members.ngram_bayes_member(words, grams)}, str(tmp_path / "kept"))
    assert fits == [2]


def test_a_step_that_was_stopped_while_it_saved_is_done_anew(spark, train, tmp_path):
    words = members.fitted_words(train)
    made = []

    def make():
        made.append(1)
        return members.ngram_bayes_member(words, {}).fit(train)

    model = manifest.once(spark, str(tmp_path), "m", "k" * 64, make)
    manifest.once(spark, str(tmp_path), "m", "k" * 64, make)
    assert made == [1]
    where = tmp_path / ("m-" + "k" * 24)
    (where / "done").rename(where / "lost")
    manifest.once(spark, str(tmp_path), "m", "k" * 64, make)
    assert made == [1, 1] and model.stages


def test_a_run_with_an_early_stop(spark, tmp_path):
    run = training.fit(labelled(spark, 3), epochs_in=str(tmp_path / "epochs"))
    history = run.history.orderBy("epoch").collect()
    best = next(r for r in history if r.chosen)
    assert best.val_accuracy == max(r.val_accuracy for r in history)
    assert best.epoch == min(r.epoch for r in history if r.val_accuracy == best.val_accuracy)
    assert len(history) == min(50, best.epoch + 10) and sorted(run.models) == [1, 2, 3, 4]


def test_rows_without_prediction_or_label_are_misses_everywhere(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 1.0, 0.0), (1, None, 1.0, 0.0), (1, 1, None, None)],
                                 "model_id int, label_id int, p0 double, p1 double")
    own = ensemble.member_prediction(rows, 2)
    assert ensemble.member_accuracy(rows, ["model_id"], n_classes=2).first()["accuracy"] == .25
    assert metrics.accuracy(own).first()["accuracy"] == .25
    wide = own.select("label_id", *[F.col("pred").alias(f"pred_{m}") for m in ensemble.METHODS])
    assert {r["accuracy"] for r in ensemble.compare_methods(wide).collect()} == {.25}
