"""Vocabulary, sequences, padding and pooling.

Arrays are shown as text or as one row per place, so that engines compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import MASKED_LENGTH, MAX_LENGTH, MAX_WORDS, OOV_ID, TOKEN
from ..operators import pooling, tokens
from ..plans import training
from ..session import stage
from ..sources.posts import table
from . import sql as q
from .registry import register
from .sampling_queries import prepared
from .text_queries import all_texts



def _shown(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), " ").alias(array)


def _sequences(spark: SparkSession, folder: str, **trim: int) -> DataFrame:
    rows = prepared(spark, folder)
    keys = training.training_keys(rows)
    vocabulary = stage(training.vocabulary(rows, keys, MAX_WORDS), "vocabulary")
    return tokens.text_to_sequence(rows, vocabulary, **trim)


@register("vocab_fit", f"with {q.vocabulary(MAX_WORDS)} select word, idx, n from vocabulary")
def vocab_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    return training.vocabulary(rows, training.training_keys(rows), MAX_WORDS)


@register("vocab_size", f"""with {q.vocabulary(MAX_WORDS)}
select count(*) + 1 as vocabulary, least(count(*) + 2, 25000) as vector_rows from counted""")
def vocab_size(spark: SparkSession, folder: str) -> DataFrame:
    rows = prepared(spark, folder)
    return tokens.vocabulary_size(training.train_texts(rows, training.training_keys(rows)))


@register("text_to_sequence", f"with {q.sequences(MAX_WORDS)} select post_id, {q.joined('sequence')} as sequence from sequences")
def text_to_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return _sequences(spark, folder).select("post_id", _shown("sequence"))


_size = "len(sequence)"
_left = (f"list_concat(list_resize([]::integer[], greatest(0, {MAX_LENGTH} - {_size}), 0), "
         f"sequence[greatest(0, {_size} - {MAX_LENGTH}) + 1:])")
_right = f"list_resize(sequence[:{MASKED_LENGTH}], {MASKED_LENGTH}, 0)"
_mask = (f"list_resize(list_resize([]::integer[], least({_size}, {MASKED_LENGTH}), 1), {MASKED_LENGTH}, 0)")


@register("pad_left", f"with {q.sequences(MAX_WORDS)} select post_id, {q.joined(_left)} as padded from sequences")
def pad_left(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_padding(_sequences(spark, folder, last=MAX_LENGTH)).select("post_id", _shown("padded"))


@register("pad_right_mask", f"""with {q.sequences(MAX_WORDS)}
select post_id, {q.joined(_right)} as input_ids, {q.joined(_mask)} as attention_mask from sequences""")
def pad_right_mask(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_mask(_sequences(spark, folder, first=MASKED_LENGTH)).select("post_id", _shown("input_ids"), _shown("attention_mask"))


_any_ids = f"list_resize(ids[:{MASKED_LENGTH}], {MASKED_LENGTH}, 0)"
_any_mask = f"list_resize(list_resize([]::integer[], least(len(ids), {MASKED_LENGTH}), 1), {MASKED_LENGTH}, 0)"


@register("encode_any_text", f"""with {q.vocabulary(MAX_WORDS)}, {q.TEXTS},
said as (select text_key, regexp_extract_all(coalesce({q.clean_enhanced('text')}, ''), {q.quoted(TOKEN)}) as words from texts),
pieces as (select text_key, unnest(words) as word, generate_subscripts(words, 1) as pos from said),
found as (
  select text_key, list(coalesce(idx, {OOV_ID}) order by pos) as ids from pieces left join vocabulary using (word) group by text_key),
every as (select text_key, coalesce(ids, []::integer[]) as ids from said left join found using (text_key))
select text_key, {q.joined(_any_ids)} as input_ids, {q.joined(_any_mask)} as attention_mask from every""")
def encode_any_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every post, page and conversation, labelled or not, as ids and mask."""
    rows = prepared(spark, folder)
    vocabulary = stage(training.vocabulary(rows, training.training_keys(rows), MAX_WORDS), "vocabulary")
    found = tokens.encode(all_texts(spark, folder), vocabulary, keys=("text_key",))
    return found.select("text_key", _shown("input_ids"), _shown("attention_mask"))


def _by_place(df: DataFrame, key: str, array: str) -> DataFrame:
    return df.select(key, F.posexplode(array).alias("place", "value")).select(key, "place", F.round("value", 6).alias("value"))


_places = """places as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as place
from embeddings)"""


@register("vector_mean_pool", f"with {_places} select label, cast(place as integer) as place, round(avg(v), 6) as value from places group by label, place")
def vector_mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _by_place(pooling.mean_pool(table(spark, folder, "embeddings"), "label", "embedding"), "label", "embedding")


@register("vector_max_pool", f"with {_places} select label, cast(place as integer) as place, round(max(v), 6) as value from places group by label, place")
def vector_max_pool(spark: SparkSession, folder: str) -> DataFrame:
    return _by_place(pooling.max_pool(table(spark, folder, "embeddings"), "label", "embedding"), "label", "embedding")


@register("vector_concat", f"""with {_places}
select label, cast(place as integer) as place, round(avg(v), 6) as value from places group by label, place
union all select label, cast(place + (select max(len(embedding)) from embeddings) as integer), round(max(v), 6) from places group by label, place""")
def vector_concat(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    both = pooling.pool_both(vectors, "label", "embedding")
    joined = both.select("label", pooling.concat_vectors(F.col("mean"), F.col("max")).alias("both"))
    return _by_place(joined, "label", "both")
