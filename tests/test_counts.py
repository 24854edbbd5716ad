import re

from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from chirpmill.functions import text as t
from chirpmill.operators import members
from chirpmill.operators.dictionary import Dictionary
from chirpmill.plans.scoring import score

WORDS = ["good", "bad", "day", "it's", "日本"]
SAID = ["good day", "bad day out", "good good day 日本 it's it's", "", "bad luck, bad day", "so so so", "day " * 5000, "never seen"]


def rows(spark):
    made = [(i, 0, s, s, i % 2, 1.0 + i) for i, s in enumerate(SAID)]
    df = spark.createDataFrame(made, "post_id long, draw_no long, text string, cleaned_text string, label_id int, weight double")
    return members.with_tokens(df).coalesce(2)


def by_stages(df, words):
    counter = CountVectorizerModel.from_vocabulary([*words, members.UNKNOWN], inputCol="known", outputCol="tf")
    return counter.transform(members.known_words(words).transform(df))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_are_those_of_the_stages(spark):
    odd = spark.createDataFrame([(["day", None, "day", "", "a b", "日本"],), ([],), (["none", "of", "these", "none"],)], "tokens array<string>")
    for words in (WORDS, WORDS[::-1], []):
        known = Dictionary({w: i for i, w in enumerate(words)})
        for df in (rows(spark).select("tokens"), odd.coalesce(1), odd.where("size(tokens) = 0")):
            found = by_stages(df, words).withColumn("counts", known.counts_of(F.col("tokens"), len(words)))
            got = found.select("tf", "counts").collect()
            assert got and all(r.tf == r.counts and type(r.tf) is type(r.counts) for r in got)
    missing = spark.createDataFrame([(None,), (["day"],)], "tokens array<string>").coalesce(1)
    got = missing.select(Dictionary({"day": 0}).counts_of(F.col("tokens"), 1).alias("n")).collect()
    assert got[0].n is None and list(got[1].n.toArray()) == [1.0, 0.0]


def test_scoring_counts_words_in_one_step_and_names_the_same_classes(spark, tmp_path):
    train = rows(spark)
    pipeline = members.logistic_member(WORDS, max_iter=5)
    members.save_model(members.fitted(pipeline, train), "basic", str(tmp_path / "m"))
    model, cleaner = members.load_model(spark, str(tmp_path / "m"))
    scored = score(train.select("post_id", "text"), model, 1, cleaner, ["post_id"])
    assert "crc32(" not in plan(scored) and "ArrowEvalPython" in plan(scored)
    raw = rows(spark).drop("tokens", "cleaned_text").withColumn("cleaned_text", t.CLEANERS[cleaner](F.col("text")))
    want = {r.post_id: r.prediction_1 for r in model.transform(members.with_tokens(raw)).collect()}
    assert len(want) == len(SAID)
    for r in scored.collect():
        assert r.predicted_sentiment == ("Please enter a tweet!" if r.post_id == 3 else ["Negative", "Neutral"][int(want[r.post_id])])


def test_a_fit_that_counts_in_one_step_is_the_same_fit(spark):
    train = rows(spark)
    a = members.logistic_member(WORDS, max_iter=20).fit(train)
    b = members.fitted(members.logistic_member(WORDS, max_iter=20), train)
    assert [type(s) for s in a.stages] == [type(s) for s in b.stages]
    assert a.stages[2].idf == b.stages[2].idf
    assert a.stages[-1].coefficientMatrix == b.stages[-1].coefficientMatrix
    assert a.stages[-1].interceptVector == b.stages[-1].interceptVector
    each = [{r.post_id: list(r.probability_1) for r in m.transform(train).collect()} for m in (a, b)]
    assert each[0] == each[1]


def test_other_openings_keep_their_stages(spark):
    look, count = members.logistic_member(WORDS).getStages()[:2]
    make = lambda words, **more: CountVectorizerModel.from_vocabulary(words, inputCol="known", outputCol="tf_1", **more)
    named = [*WORDS, members.UNKNOWN]
    others = [
        [look], [count], [look, make(named, binary=True)], [look, make(named, minTF=2.0)], [look, make(WORDS)], [look, make(named[1:])],
        [look, make([*WORDS[::-1], members.UNKNOWN])], [look, count.copy().setInputCol("tokens")],
        [members.known_words([members.UNKNOWN]), make([members.UNKNOWN, members.UNKNOWN])],
        members.ngram_bayes_member(WORDS, {}).getStages(),
    ]
    train = rows(spark)
    for stages in others:
        df, left = members.with_counts(train, stages)
        assert df is train and left == stages
    df, left = members.with_counts(train, [look, count])
    assert left == [] and "tf_1" in df.columns
    bayes = members.ngram_bayes_member(WORDS, {2: ["good day"]})
    a, b = Pipeline(stages=bayes.getStages()).fit(train), members.fitted(bayes, train)
    assert a.stages[-1].theta == b.stages[-1].theta


def test_contractions_and_lexicons_as_written(spark):
    said = ["can't", "won't go", "it isn't", "n't", "'t", "CAN'T won'tcan't don't", "nothing", "", None, "t' can 't"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    for r in df.select("s", t.normalised(F.col("s")).alias("x")).collect():
        want = r.s and r.s.lower().replace("can't", "cannot").replace("won't", "will not").replace("n't", " not")
        assert r.x == want
    every = t.p.POSITIVE_WORDS + t.p.NEGATIVE_WORDS
    tried = [*every, *[w + "s" for w in every], *[w[:-1] for w in every], *[f"{w},x" for w in every], "thank thanks thankss late lately", "x", ""]
    df = spark.createDataFrame([(f"{w} {w}\x1c{w} {w}", w) for w in tried], "s string, w string")
    pos, neg = t.lexicon_counts(F.col("s"))
    for r in df.select("s", pos.alias("pos"), neg.alias("neg")).collect():
        found = re.split(r"\s+", r.s)
        assert r.pos == sum(w in t.p.POSITIVE_WORDS for w in found) and r.neg == sum(w in t.p.NEGATIVE_WORDS for w in found)
