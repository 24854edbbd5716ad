"""Text rules over every given text and the hand-written posts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as p
from ..functions import text as t
from ..plans.training import prepare
from ..sources.posts import texts
from . import sql as q
from .literals import literal_posts
from .registry import register


def all_texts(spark: SparkSession, folder: str) -> DataFrame:
    extra = literal_posts(spark).select(F.concat(F.lit("l"), "post_id").alias("text_key"), "text")
    return texts(spark, folder).unionByName(extra)


def _rule(name: str, rule: Callable[[Column], Column], sql: str) -> None:
    @register(name, f"with {q.TEXTS} select text_key, {sql} as result from texts")
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return all_texts(spark, folder).select("text_key", rule(F.col("text")).alias("result"))


_rule("strip_urls", t.strip_urls, q.strip_urls("text"))
_rule("strip_mentions", t.strip_mentions, q.strip_mentions("text"))
_rule("strip_hashes", t.strip_hashes, q.strip_hashes("text"))
_rule("strip_punct", t.strip_punct, q.strip_punct("text"))
_rule("letters_only", t.letters_only, q.letters_only("text"))
_rule("expand_contractions", t.normalised, q.normalised("text"))
_rule("clean_basic", t.clean_basic, q.clean_basic("text"))
_rule("clean_enhanced", t.clean_enhanced, q.clean_enhanced("text"))
_present = "coalesce(text, 'nan')"
_rule("text_length", t.text_length, f"cast(length({_present}) as integer)")
_rule("word_count", t.word_count, f"cast({q.word_count(_present)} as integer)")
_rule("blank_guard", lambda c: t.blank_guard(c, t.clean_basic(c)),
      f"case when {q.strip('text')} = '' then {q.quoted(p.BLANK_MESSAGE)} else {q.clean_basic('text')} end")

_bare = q.strip_hashes(q.strip_mentions(q.strip_urls(q.normalised("text"))))


@register("punct_counts", f"""with {q.TEXTS}, bare as (select text_key, {_bare} as b from texts)
select text_key, cast(length(b) - length(replace(b, '!', '')) as integer) as exclamations,
       cast(length(b) - length(replace(b, '?', '')) as integer) as questions from bare""")
def punct_counts(spark: SparkSession, folder: str) -> DataFrame:
    exclamations, questions = t.exclamations_and_questions(F.col("text"))
    return all_texts(spark, folder).select("text_key", exclamations.alias("exclamations"), questions.alias("questions"))


_counts = (f"cast({q.lexicon_count('base', p.POSITIVE_WORDS)} as integer) as pos_count, "
           f"cast({q.lexicon_count('base', p.NEGATIVE_WORDS)} as integer) as neg_count")
_base = f"based as (select text_key, {q.normalised('text')} as base from texts)"


@register("lexicon_counts", f"with {q.TEXTS}, {_base} select text_key, {_counts} from based")
def lexicon_counts(spark: SparkSession, folder: str) -> DataFrame:
    base = t.normalised(F.col("text"))
    pos, neg = t.lexicon_counts(base)
    return all_texts(spark, folder).select("text_key", pos.alias("pos_count"), neg.alias("neg_count"))


@register("lexicon_tag", f"""with {q.TEXTS}, {_base}, counted as (select text_key, {_counts} from based)
select text_key, trim({q.lexicon_suffix('pos_count', 'neg_count')}) as tag from counted""")
def lexicon_tag(spark: SparkSession, folder: str) -> DataFrame:
    base = t.normalised(F.col("text"))
    suffix = t.lexicon_suffix(*t.lexicon_counts(base))
    return all_texts(spark, folder).select("text_key", F.trim(suffix).alias("tag"))


@register("drop_empty_text", f"""with {q.TEXTS}, cleaned as (select text_key, {q.clean_enhanced('text')} as cleaned_text from texts)
select text_key, cleaned_text from cleaned where length(cleaned_text) > 0""")
def drop_empty_text(spark: SparkSession, folder: str) -> DataFrame:
    return prepare(all_texts(spark, folder))
