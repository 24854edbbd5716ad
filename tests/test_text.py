"""Text rules on awkward strings against expected values and plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chirpmill.catalog.literals import LITERAL_POSTS
from chirpmill.functions import patterns as p
from chirpmill.functions import text as t

# cleaned texts and lexicon counts of the hand-written posts, worked out from the rules by hand
BASIC = {
    -1: "i cant\xa0wait  great love  great great thanks", -2: "never late lost late shant wont",
    -3: "café ² ٣ naïve_x tag", -4: "", -5: "http", -6: "good bad good bad", -7: "great flight",
    -9: "he said thanks thank you\nbest", -10: "na", -8: None,
}
ENHANCED = {
    -1: "i cannot wait great love great great thanks positive",
    -2: "never late lost late sha not will not negative", -3: "caf na ve x tag", -4: "", -5: "http",
    -6: "good bad good bad", -7: "great flight", -9: "he said thanks thank you best positive", -10: "na", -8: None,
}
COUNTS = {-1: (3, 0), -2: (0, 3), -3: (0, 0), -4: (0, 0), -5: (0, 0), -6: (2, 2), -7: (1, 0), -9: (2, 0), -10: (0, 0),
          -8: (None, None)}

AWKWARD = [
    "", " ", "\x1c\x1d", "a\x85b c　", "@", "#", "@#a", "#@a b@c#d", "@@a @é_1-x", "http", "https://x www. wwwx",
    "xhttp://y\xa0z", "can't won't shouldn't CAN'T ain't", "great great\tgreat\nbad", "late, late lost,lost never",
    "thanks thank thankss", "²³ ½ ٣ _x_ é́ ＡＢ", "!!?? @a! #? http://x?!", "ΟΔΟΣ İstanbul ß", "日本語 text", "a  b   c",
    "goodbad good good", "😀 great 😀 love", "tab\x0bvt\x0cff", "​zero﻿width", "it's 100% 'quoted' \"x\"",
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame([(r[0], r[1]) for r in LITERAL_POSTS], "post_id bigint, text string")


def _by_id(df):
    return {r[0]: r[1] for r in df.collect()}


def test_clean_basic_of_the_written_posts(posts):
    assert _by_id(posts.select("post_id", t.clean_basic(F.col("text")))) == BASIC


def test_clean_enhanced_of_the_written_posts(posts):
    assert _by_id(posts.select("post_id", t.clean_enhanced(F.col("text")))) == ENHANCED


def test_lexicon_counts_of_the_written_posts(posts):
    pos, neg = t.lexicon_counts(t.normalised(F.col("text")))
    assert {r[0]: (r[1], r[2]) for r in posts.select("post_id", pos, neg).collect()} == COUNTS


def _apply(spark, rule, texts=AWKWARD):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r[0]: r[1] for r in df.select("i", rule(F.col("text"))).collect()}
    return [found[i] for i in range(len(texts))]


def test_whitespace_rules_follow_python(spark):
    assert _apply(spark, t.strip) == [s.strip() for s in AWKWARD]
    assert _apply(spark, t.word_count) == [len(s.split()) for s in AWKWARD]
    assert _apply(spark, t.tokens) == [s.split() for s in AWKWARD]
    assert _apply(spark, t.text_length) == [len(s) for s in AWKWARD]
    assert _apply(spark, t.is_blank) == [not s.strip() for s in AWKWARD]


def test_single_steps_follow_python(spark):
    assert _apply(spark, t.strip_urls) == [re.sub(r"(?:http|www)\S+", "", s) for s in AWKWARD]
    assert _apply(spark, t.strip_mentions) == [re.sub(r"@\w+", "", s) for s in AWKWARD]
    assert _apply(spark, t.strip_hashes) == [s.replace("#", "") for s in AWKWARD]
    assert _apply(spark, t.strip_punct) == ["".join(c for c in s if c.isalnum() or c == "_" or c.isspace()) for s in AWKWARD]
    assert _apply(spark, t.letters_only) == [" ".join(re.findall("[A-Za-z]+", s)) for s in AWKWARD]
    assert _apply(spark, t.normalised) == [
        s.lower().replace("can't", "cannot").replace("won't", "will not").replace("n't", " not") for s in AWKWARD]


def test_one_pass_lexicon_counts_follow_token_counts(spark):
    def counted(words):
        found = []
        for s in AWKWARD:
            seen = Counter(s.lower().split())
            found.append(sum(seen[w] for w in words))
        return found

    pos, neg = t.lexicon_counts(F.lower(F.col("text")))
    assert _apply(spark, lambda c: pos) == counted(p.POSITIVE_WORDS)
    assert _apply(spark, lambda c: neg) == counted(p.NEGATIVE_WORDS)


def test_whitespace_class_is_python_whitespace(spark):
    every = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert every == p.WHITESPACE_CHARS
    odd = [c + "x" + c for c in every] + ["x​x", "x᠎x", "x﻿x"]
    assert _apply(spark, t.word_count, odd) == [len(s.split()) for s in odd]


def test_missing_text_counts_as_nan_or_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    c = F.col("text")
    row = df.select(t.text_length(c), t.word_count(c), t.text_length(c, None), t.clean_basic(c), t.clean_enhanced(c)).first()
    assert tuple(row) == (3, 1, None, None, None)


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (-1,), (None,)], "k int")
    assert [r[0] for r in df.select(t.decode_label(F.col("k"))).collect()] == [
        "Negative", "Neutral", "Positive", "Unknown", "Unknown", "Unknown"]
