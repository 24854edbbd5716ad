"""Words are looked up inside the row."""

import random

import pytest
from pyspark.sql import functions as F

from chirpmill.operators import members, tokens
from chirpmill.operators.dictionary import Dictionary

ODD = ["it's", "back\\slash", "é", "日本", "a", "aa", "b'", '"', "%", "a.b", "1", "x" * 5000, "\U0001f600z"]


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ODD + list({"".join(rng.choice("abcdé0'") for _ in range(rng.randint(3, 9))) for _ in range(3000)})


def test_every_word_has_its_id_and_no_other_word_has_one(spark, words):
    known = Dictionary({w: i + 2 for i, w in enumerate(words[::2])})
    texts = spark.createDataFrame([(0, words), (1, []), (2, None), (3, ["", "a\tb", "2", "a 2", " "])], "k int, words array<string>")
    got = {r.k: r.ids for r in texts.select("k", known.ids_of(F.col("words")).alias("ids")).collect()}
    assert got[0] == [i // 2 + 2 if i % 2 == 0 else 1 for i in range(len(words))]
    assert got[1] == [] and got[2] is None and got[3] == [1] * 5


def test_sequences_are_made_without_an_exchange(spark, words):
    vocabulary = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, idx int")
    rows = spark.createDataFrame([(1, "a it's zz a"), (2, ""), (3, None)], "post_id long, cleaned_text string")
    found = tokens.text_to_sequence(rows, vocabulary)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "get(split" not in plan and "[ " in plan  # the buckets are a constant
    a, its = words.index("a") + 2, words.index("it's") + 2
    assert {r.post_id: r.sequence for r in found.collect()} == {1: [a, its, 1, a], 2: [], 3: []}


def test_the_words_of_the_members_are_the_same_dictionary(spark, words):
    rows = spark.createDataFrame([(["a", "no\\pe", "back\\slash", "it's", "日本"],)], "tokens array<string>")
    assert members.known_words(words).transform(rows).first()["known"] == ["a", members.UNKNOWN, "back\\slash", "it's", "日本"]
    assert members.known_words([]).transform(rows).first()["known"] == [members.UNKNOWN] * 5


def test_size_and_words_are_checked(spark):
    with pytest.raises(ValueError, match="more than 2"):
        Dictionary.of(spark.range(9).selectExpr("cast(id as string) word", "cast(id as int) idx"), limit=2)
    for odd in ("", "a b", "a\nb"):
        with pytest.raises(ValueError, match="not one word"):
            Dictionary({odd: 1})


def test_numbers_are_the_ids_in_fewer_steps(spark, words):
    known = Dictionary({w: i + 2 for i, w in enumerate(words[::2])})
    texts = spark.createDataFrame([(words,), ([],), (None,), (["", "a\tb", None, "a"],), (words[::-1],)], "words array<string>").coalesce(1)
    for unknown in (0, 1):
        both = texts.select(known.ids_of(F.col("words"), unknown).alias("x"), known.numbers_of(F.col("words"), unknown).alias("y")).collect()
        assert len(both) == 5 and all(r.x == r.y for r in both)
    assert texts.select(Dictionary({}).numbers_of(F.col("words")).alias("y")).collect()[3].y == [1] * 4
