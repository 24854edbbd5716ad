"""Vocabulary, integer sequences, padding and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import attention_mask, pad_left, pad_right
from ..functions.patterns import MASKED_LENGTH, MAX_LENGTH, MAX_WORDS, OOV_ID
from ..functions.text import tokens
from .cleaning import with_cleaned
from .dictionary import Dictionary

# room for the word position behind the post key in one ordered number
POSITION_SPAN = 10 ** 10


def word_counts(df: DataFrame, text: str, key: str, weight: str | None = None) -> DataFrame:
    """``(word, n, first_seen)`` over all texts; ``weight`` says how often a row counts.

    ``first_seen`` orders by (key, position). It is one decimal, not a struct, so that the whole
    aggregation stays a hash aggregation: hot words shrink to one row per task before the shuffle.
    """
    times = F.col(weight) if weight else F.lit(1)
    words = df.select(F.col(key).alias("k"), times.cast("long").alias("times"), F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    seen = F.col("k").cast("decimal(20,0)") * F.lit(POSITION_SPAN).cast("decimal(11,0)") + F.col("pos")
    return words.groupBy("word").agg(F.sum("times").alias("n"), F.min(seen).alias("first_seen"))


def fit_vocabulary(df: DataFrame, text: str = "cleaned_text", key: str = "post_id",
                   weight: str | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """``(word, idx, n)``: most frequent words first, ties by first appearance, ids from 2.

    Id 1 is the unknown word and ids from ``max_words`` on act as unknown, so ``max_words - 2`` words
    are kept. The ids are numbered after that limit.
    """
    kept = word_counts(df, text, key, weight).orderBy(F.desc("n"), "first_seen").limit(max_words - 2)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first_seen"))
    return kept.select("word", (rank + OOV_ID).cast("int").alias("idx"), "n")


def vocabulary_size(df: DataFrame, text: str = "cleaned_text", max_words: int = MAX_WORDS) -> DataFrame:
    """Words known with the unknown word, and rows a lookup table needs after the cap."""
    words = df.select(F.explode(tokens(F.col(text))).alias("word"))
    return words.agg((F.count_distinct("word") + 1).alias("vocabulary")).select(
        "vocabulary", F.least(F.col("vocabulary") + 1, F.lit(max_words).cast("long")).alias("vector_rows")
    )


def text_to_sequence(df: DataFrame, vocabulary: DataFrame, text: str = "cleaned_text",
                     keys: tuple[str, ...] = ("post_id",), name: str = "sequence",
                     last: int | None = None, first: int | None = None) -> DataFrame:
    """``(*keys, sequence)``: word ids in text order, unknown words as 1.

    The vocabulary, capped when it is fitted, becomes a constant of the plan (``Dictionary``) that each row looks its words
    up in: nothing is shuffled, joined or put together again. A missing text has no words. ``last`` or ``first`` is for a
    caller that will pad to that length anyway: words it would cut off are not looked up.
    """
    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    if last is not None:
        words = F.slice(words, F.greatest(F.size(words) - last, F.lit(0)) + 1, F.lit(last))
    elif first is not None:
        words = F.slice(words, 1, first)
    return df.select(*keys, Dictionary.of(vocabulary).ids_of(words).alias(name))


def with_padding(df: DataFrame, sequence: str = "sequence", length: int = MAX_LENGTH) -> DataFrame:
    return df.withColumn("padded", pad_left(F.col(sequence), length))


def with_mask(df: DataFrame, sequence: str = "sequence", length: int = MASKED_LENGTH) -> DataFrame:
    return df.withColumns({
        "input_ids": pad_right(F.col(sequence), length),
        "attention_mask": attention_mask(F.col(sequence), length),
    })


def encode(df: DataFrame, vocabulary: DataFrame, cleaner: str = "enhanced", text: str = "text", keys: tuple[str, ...] = ("post_id",),
           length: int = MASKED_LENGTH) -> DataFrame:
    """``(*keys, input_ids, attention_mask)`` of any text that is to be scored, labelled or not.

    Cleaned, cut to the first ``length`` words, looked up and padded on the right, row by row and without a shuffle; a
    missing text or one of which nothing is left is all padding.
    """
    cleaned = with_cleaned(df.select(*keys, text), cleaner, text)
    ids = text_to_sequence(cleaned, vocabulary, keys=keys, first=length)
    return with_mask(ids, length=length).select(*keys, "input_ids", "attention_mask")
