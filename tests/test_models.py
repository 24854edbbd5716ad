"""Members learn, save, load, and score the same in batch and on a stream."""

import pytest
from pyspark.sql import functions as F

from chirpmill.catalog.text_queries import all_texts
from chirpmill.operators import members, metrics
from chirpmill.plans import training
from chirpmill.plans.scoring import score
from chirpmill.sources.posts import labeled, table
from chirpmill.streaming import scoring as streaming

KEYS = ["post_id", "draw_no"]


@pytest.fixture(scope="module")
def trained(spark, folder):
    return training.fit(labeled(spark, "/root/testdata/sf0.01"))


def test_probabilities_sum_to_one(trained):
    total = F.col("p0") + F.col("p1") + F.col("p2")
    assert trained.scores.where(F.abs(total - 1) > 1e-6).count() == 0
    assert trained.scores.select("model_id").distinct().count() == 4


def test_each_held_out_row_has_a_score_of_each_member(trained):
    per_row = trained.scores.groupBy(*KEYS).count()
    assert per_row.where("count <> 4").count() == 0
    assert per_row.count() == 28


def test_best_combination_is_reported(trained):
    accuracies = [r["accuracy"] for r in trained.compared.collect()]
    assert trained.best.first()["accuracy"] == max(accuracies)
    report = training.final_report(trained)
    assert report.count() == 6


def test_members_beat_the_largest_class_on_train(spark):
    rows = spark.createDataFrame(
        [(i, 0, i % 3, "train", f"{['sad grey', 'plain dull', 'glad bright'][i % 3]} day number w{i % 7}") for i in range(90)],
        "post_id bigint, draw_no bigint, label_id int, split string, cleaned_text string")
    rows = members.with_tokens(rows.withColumn("weight", F.lit(1.0)))
    words = members.fitted_words(rows)
    vectors = members.fit_word_vectors(rows, words, size=16)
    models = members.fit_members(rows, members.member_pipelines(words, vectors, members.fitted_grams(rows, words)))
    for m, model in models.items():
        found = model.transform(rows).select("label_id", F.col(f"prediction_{m}").cast("int").alias("pred"))
        assert metrics.accuracy(found).first()["accuracy"] > 0.5, members.NAMES[m]


def test_the_cap_keeps_as_many_words_as_it_says(spark):
    texts = spark.createDataFrame([(i, 0, f"w{i} it's") for i in range(1001)], "post_id bigint, draw_no int, cleaned_text string")
    rows = members.with_tokens(texts)
    words = members.fitted_words(rows, max_words=500)
    assert len(words) == 498 and words[0] == "it's" and words[1:] == [f"w{i}" for i in range(497)]
    vectors = members.fit_word_vectors(rows, words, size=4).stages[-1].getVectors()
    assert {r["word"] for r in vectors.collect()} == {*words, members.UNKNOWN}
    counted = members.logistic_member(words).getStages()[1].transform(members.known_words(words).transform(rows))
    assert counted.where("post_id = 1000").first()["tf_1"].toArray()[-1] == 1.0


def test_rows_drawn_by_weight(spark):
    rows = spark.createDataFrame([(i, 0, 0.25 if i % 2 else 2.5) for i in range(2000)], "post_id bigint, draw_no int, weight double")
    n = {r["weight"]: r["count"] for r in members.drawn_by_weight(rows).groupBy("weight").count().collect()}
    assert abs(n[0.25] - 250) < 60 and abs(n[2.5] - 2500) < 100


def test_saved_model_scores_the_same(spark, trained, folder, tmp_path):
    members.save_model(trained.models[1], "enhanced", str(tmp_path / "m"))
    loaded, cleaner = members.load_model(spark, str(tmp_path / "m"))
    assert cleaner == "enhanced"
    texts = all_texts(spark, folder)
    a = score(texts, trained.models[1], 1, cleaner, ["text_key"]).collect()
    b = score(texts, loaded, 1, cleaner, ["text_key"]).collect()
    assert sorted(a) == sorted(b) and len(a) == texts.count()


def test_blank_texts_get_the_message(spark, trained):
    df = spark.createDataFrame([(1, "  \xa0"), (2, None), (3, "great day")], "post_id bigint, text string")
    found = {r[0]: r[1] for r in score(df, trained.models[1], 1, "enhanced", ["post_id"]).collect()}
    assert found[1] == found[2] == "Please enter a tweet!"
    assert found[3] in {"Negative", "Neutral", "Positive"}


def test_stream_equals_batch(spark, trained, folder, tmp_path):
    docs = table(spark, folder, "documents")
    incoming = streaming.read_posts(spark, folder, docs.schema, glob="documents.parquet")
    query = streaming.score_stream(incoming, trained.models[2], 2, "enhanced", ["doc_id"], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    batch = score(docs, trained.models[2], 2, "enhanced", ["doc_id"])
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_first_best_candidate_is_kept(spark, trained):
    rows = spark.createDataFrame([(i, i % 3, f"w{i % 3} x") for i in range(60)], "post_id bigint, label_id int, cleaned_text string")
    rows = members.with_tokens(rows.withColumn("weight", F.lit(1.0)))
    words = members.fitted_words(rows)
    grid = [("a", members.logistic_member(words, reg=0.01)), ("b", members.logistic_member(words, reg=0.02))]
    _, tried = members.select_on_validation(rows, rows, grid, 1)
    assert [(r["candidate"], r["chosen"]) for r in tried.collect()] == [("a", True), ("b", False)]


def test_members_look_words_up_once(spark):
    said = ["good day", "bad day out", "good good day", "", "bad luck day", "so good"]
    rows = members.with_tokens(spark.createDataFrame(
        [(i, 0, t, i % 2, 1.0) for i, t in enumerate(said)], "post_id long, draw_no long, cleaned_text string, label_id int, weight double"))
    words, grams = ["good", "bad", "day"], {2: ["good day", "bad day"]}
    found = members.fit_members(rows, {1: members.logistic_member(words, max_iter=3), 2: members.ngram_bayes_member(words, grams)})
    other = members.fit_members(rows, {3: members.ngram_bayes_member(words[:2], grams)})
    other[3].stages[-1].setProbabilityCol("probability_3").setPredictionCol("prediction_3").setRawPredictionCol("raw_3")
    for models, looked_up in ((found, 1), ({2: found[2]}, 1), ({1: found[1], 3: other[3]}, 2)):
        wide = members.predict_proba(rows, models, ["post_id"])
        assert wide._jdf.queryExecution().executedPlan().toString().count("crc32(") == looked_up
        got = {r["post_id"]: r for r in wide.collect()}
        for m, model in models.items():
            for r in model.transform(rows).collect():
                assert [got[r["post_id"]][f"m{m}_p{k}"] for k in range(2)] == list(r[f"probability_{m}"])
