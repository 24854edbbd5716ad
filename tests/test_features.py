"""What members read from texts in one step is what their opening stages give."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.sql import functions as F

from chirpmill.functions import text as t
from chirpmill.operators import features, members
from chirpmill.plans import scoring

WORDS = ["good", "bad", "day", "it's", "日本", "a\\b"]
GRAMS = {2: ["good day", "bad day", "day bad", "day day"], 3: ["good day bad", " ".join([members.UNKNOWN] * 3)],
         5: ["good day bad day good", "day day day day day"]}
SAID = ["good day", "bad day out", "good good day 日本 it's it's", "", "bad luck, bad day", "so so so so so", "day " * 40000,
        "never seen good day bad day good", "a\\b bad"]
MADE = {1: ["tf_1"], 2: [f"counts_{n}" for n in (2, 3, 4, 5)], 3: ["vector_3"], 4: ["vector_4"]}


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, 0, s, s, i % 2, 1.0 + i / 2) for i, s in enumerate(SAID)]
    df = spark.createDataFrame(made, "post_id long, draw_no long, text string, cleaned_text string, label_id int, weight double")
    return members.with_tokens(df).coalesce(2)


@pytest.fixture(scope="module")
def pipelines(rows):
    vectors = members.fit_word_vectors(rows, WORDS, size=5)
    return {1: members.logistic_member(WORDS, max_iter=5), 2: members.ngram_bayes_member(WORDS, GRAMS), 3: members.forest_member(vectors, trees=3),
            4: members.perceptron_member(vectors, 5, hidden=3, max_iter=5, n_classes=2)}


@pytest.fixture(scope="module")
def models(rows, pipelines):
    return members.fit_members(rows, pipelines)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("at_once", [features.PLACES, 3])
def test_one_step_gives_what_the_stages_give(rows, models, monkeypatch, at_once):
    monkeypatch.setattr(features, "PLACES", at_once)
    monkeypatch.setattr(features, "LONG", min(features.LONG, at_once * 100))
    ready, left = members.opened(rows, {m: model.stages for m, model in models.items()})
    assert [type(s[0]).__name__ for s in left.values()] == ["IDFModel", "VectorAssembler", "RandomForestClassificationModel",
                                                            "MultilayerPerceptronClassificationModel"]
    got = {r.post_id: r for r in ready.collect()}
    for m, model in models.items():
        for r in model.transform(rows).collect():
            for c in MADE[m]:
                assert got[r.post_id][c] == r[c] and type(got[r.post_id][c]) is type(r[c])


def test_missing_and_odd_words(spark, models):
    odd = spark.createDataFrame([(["day", None, "day", "", "a b", "日本"],), ([],)], "tokens array<string>").coalesce(1)
    ready, _ = members.opened(odd, {m: model.stages for m, model in models.items()})
    for m, model in models.items():
        assert [[r[c] for c in MADE[m]] for r in ready.collect()] == [[r[c] for c in MADE[m]] for r in model.transform(odd).collect()]
    missing = spark.createDataFrame([(None,), (["day"],)], "tokens array<string>").coalesce(1)
    ready, _ = members.opened(missing, {m: model.stages for m, model in models.items()})
    one, two = ready.collect()
    assert all(one[c] is None and two[c] is not None for made in MADE.values() for c in made)
    assert members.opened(missing.where("false"), {1: models[1].stages})[0].collect() == []


def test_all_members_score_by_one_look_up(spark, rows, models, tmp_path):
    found = scoring.Ensemble(models, {m: .25 for m in models}, "Weighted", "basic", ("a", "b"))
    scoring.save_ensemble(found, spark, str(tmp_path / "e"))
    want = sorted(members.predict_proba(rows, models, ["post_id"]).collect())
    for each in (found, scoring.load_ensemble(spark, str(tmp_path / "e"))):
        assert sorted(members.predict_together(rows, each.models, ["post_id"]).collect()) == want
        said = plan(scoring.score_ensemble(rows.select("post_id", "text"), each, ["post_id"]))
        assert said.count("ArrowEvalPython") == 1 and "crc32(" not in said


def test_fits_are_the_same_fits(rows, pipelines, models):
    for m, pipeline in pipelines.items():
        train = members.drawn_by_weight(rows) if m == 4 else rows
        by_stages = Pipeline(stages=pipeline.getStages()).fit(train)
        assert [type(s) for s in by_stages.stages] == [type(s) for s in models[m].stages]
        a, b = (members.predict_proba(rows, {m: model}, ["post_id"]).collect() for model in (by_stages, models[m]))
        assert sorted(a) == sorted(b)


def test_words_are_read_back_from_a_look_up():
    for words in (WORDS, WORDS[::-1], [], ["'", "\\", "\\'", "x\\n", "1"]):
        assert members.words_known(members.known_words(words)) == words
    assert members.words_known(NGram()) is None


def test_members_that_open_otherwise_keep_their_stages(spark, rows, models):
    look, word_runs, counter = models[2].stages[:3]
    last = models[2].stages[-1]
    made = lambda **more: CountVectorizerModel.from_vocabulary(GRAMS[2], inputCol=word_runs.getOutputCol(), outputCol="counts_2", **more)
    others = [[look], [look, last], [look, word_runs], [look, word_runs, made(binary=True)], [look, word_runs, made(minTF=2.0)],
              [look, word_runs, CountVectorizerModel.from_vocabulary(["good luck"], inputCol=word_runs.getOutputCol(), outputCol="counts_2")],
              [look, word_runs, counter, NGram(n=2, inputCol="known", outputCol="again")],
              [members.known_words([members.UNKNOWN]), word_runs, counter], [counter]]
    for stages in others:
        df, left = members.opened(rows, {2: stages})
        assert df is rows and left == {2: stages}
    other = members.fit_members(rows, {3: members.ngram_bayes_member(WORDS[:2], GRAMS | {2: ["good bad"], 3: ["bad good bad"], 5: []})})
    other[3].stages[-1].setProbabilityCol("probability_3").setPredictionCol("prediction_3").setRawPredictionCol("raw_3")
    both = {1: models[1], 3: other[3]}  # two look-ups, two steps
    a, b = members.predict_together(rows, both, ["post_id"]), members.predict_proba(rows, both, ["post_id"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_texts_made_ready_once_are_scored_alike(spark, models):
    found = scoring.Ensemble(models, {m: .25 for m in models}, "Average", "enhanced", ("a", "b"))
    said = [*SAID, " ", "\x1c", None, "Good-DAY bad\tday!", "good good 1", "http://x.y", "\u2003bad\u00a0day"]
    texts = spark.createDataFrame(list(enumerate(said)), "post_id long, text string").coalesce(2)
    want = sorted(scoring.score_ensemble(texts, found, ["post_id"]).collect())
    ready = scoring.ready(texts, found.cleaner, ["post_id"])
    assert sorted(scoring.score_ensemble(ready, found, ["post_id"], is_ready=True).collect()) == want
    assert {r.post_id for r in want if r.predicted_sentiment == "Please enter a tweet!"} == {3, 9, 10, 11}
    with_words = ready.select(t.tokens(F.col("cleaned_text")).alias("a"), t.tokens(F.col("cleaned_text"), found.cleaner).alias("b")).collect()
    assert len(with_words) == len(said) and all(r.a == r.b for r in with_words)


def test_no_job_runs_before_texts_are_scored(spark, rows, models, tmp_path):
    found = scoring.Ensemble(models, {m: .25 for m in models}, "Average", "basic", ("a", "b"))
    texts = rows.select("post_id", "text")
    scoring.ready(texts, "basic", ["post_id"]).write.parquet(str(tmp_path / "in"))
    posts = spark.readStream.schema("post_id long, blank boolean, cleaned_text string").parquet(str(tmp_path / "in"))
    # a stream has no first row to look at
    scored = scoring.score_ensemble(posts, found, ["post_id"], is_ready=True)
    scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "kept")).trigger(
        availableNow=True).start().awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(scoring.score_ensemble(texts, found, ["post_id"]).collect())
