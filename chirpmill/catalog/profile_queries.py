"""Scans, reports and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CLASSES, CSV_MISSING, LENGTH_BINS, WORD_BINS
from ..functions.text import text_length, word_count
from ..operators import profile
from ..session import work_path
from ..sources import files
from ..sources.posts import documents, measured, posts, spread, table, with_sentiment
from . import sql as q
from .literals import literal_posts
from .registry import register


def _csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["post_id", "text", "brand", "sentiment"]
    return posts(spark, folder).select(*columns).unionByName(literal_posts(spark))


_missing = ", ".join(q.quoted(v) for v in CSV_MISSING)


@register("scan_csv", f"""with {q.POSTS}, {q.LITERALS},
rows as (select post_id, text, brand, sentiment from posts union all select * from literals)
select post_id, case when text not in ({_missing}) then text end as text, brand, sentiment from rows""")
def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    rows = _csv_rows(spark, folder)
    path = work_path(spark, "csv")
    files.write_csv(rows, path)
    return files.scan_csv(spark, path, rows.schema)


@register("file_inventory")
def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return files.file_inventory(spark, folder)


@register("write_report", f"with {q.POSTS} select brand, count(*) as n from posts where brand is not null group by brand")
def write_report(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "report")
    files.write_report(profile.frequencies(documents(spark, folder), "brand"), path)
    return files.read_report(spark, path)


@register("profile_basic", f"""with {q.POSTS}
select count(*) as n_rows, cast(5 as integer) as n_columns,
       round(sum(8 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(brand), 0)
                 + coalesce(strlen(sentiment), 0)) / (1024.0::double * 1024.0::double), 6) as size_mb from posts""")
def profile_basic(spark: SparkSession, folder: str) -> DataFrame:
    return profile.basic(measured(spark, folder, F.octet_length), ("text",))


@register("profile_schema", """select cast(0 as integer) as position, 'doc_id' as column_name, 'bigint' as data_type, count(doc_id) as n_present from documents
union all select 1, 'text', 'string', count(text) from documents
union all select 2, 'lang', 'string', count(lang) from documents
union all select 3, 'source', 'string', count(source) from documents
union all select 4, 'n_chars', 'bigint', count(n_chars) from documents""")
def profile_schema(spark: SparkSession, folder: str) -> DataFrame:
    return profile.schema_report(table(spark, folder, "documents"))


@register("profile_missing", f"""with {q.POSTS}, counted as (
  select 'post_id' as column_name, count(*) - count(post_id) as missing_count, count(*) as n_rows from posts
  union all select 'text', count(*) - count(text), count(*) from posts
  union all select 'lang', count(*) - count(lang), count(*) from posts
  union all select 'brand', count(*) - count(brand), count(*) from posts
  union all select 'sentiment', count(*) - count(sentiment), count(*) from posts)
select column_name, missing_count, round(missing_count / n_rows::double * 100, 6) as percentage
from counted where missing_count > 0""")
def profile_missing(spark: SparkSession, folder: str) -> DataFrame:
    return profile.missing(measured(spark, folder, F.octet_length))


def _describe_number(c: str) -> str:
    quartile = lambda f: f"round(quantile_cont({c}::double, {f}), 6)"
    return f"""select '{c}' as column_name, count({c}) as count, cast(null as bigint) as "unique", cast(null as varchar) as top,
  cast(null as bigint) as freq, round(avg({c}::double), 6) as mean, round(stddev_samp({c}::double), 6) as std,
  round(min({c})::double, 6) as min, {quartile(0.25)} as p25, {quartile(0.5)} as p50, {quartile(0.75)} as p75,
  round(max({c})::double, 6) as max from wide"""


def _describe_string(c: str) -> str:
    return f"""select '{c}', (select count({c}) from wide), (select count(distinct {c}) from wide),
  (select {c} from wide where {c} is not null group by {c} order by count(*) desc, min(post_id) limit 1),
  (select max(n) from (select count(*) as n from wide where {c} is not null group by {c})),
  null, null, null, null, null, null, null"""


@register("profile_describe", f"""with {q.POSTS},
wide as (select p.*, d.n_chars from posts p join documents d on p.post_id = d.doc_id)
""" + " union all ".join([_describe_number("post_id"), _describe_number("n_chars")]
                         + [_describe_string(c) for c in ("text", "lang", "brand", "sentiment")]))
def profile_describe(spark: SparkSession, folder: str) -> DataFrame:
    digests = measured(spark, folder, lambda c: F.sha2(c, 256), ("n_chars",))
    return profile.describe(digests, "post_id", documents(spark, folder).select("post_id", "text"))


@register("sentiment_counts", f"with {q.POSTS} select sentiment, count(*) as n from posts where sentiment is not null group by sentiment")
def sentiment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(posts(spark, folder), "sentiment")


@register("brand_counts", f"with {q.POSTS} select brand, count(*) as n from posts where brand is not null group by brand")
def brand_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.frequencies(documents(spark, folder), "brand")


@register("sentiment_share", f"""with {q.POSTS}
select sentiment, round(count(*) / (sum(count(*)) over ())::double * 100, 6) as percentage
from posts where sentiment is not null group by sentiment""")
def sentiment_share(spark: SparkSession, folder: str) -> DataFrame:
    return profile.shares(posts(spark, folder), "sentiment")


@register("text_length_stats", f"""select round(avg(length(text)), 6) as avg_text_length,
round(avg({q.word_count('text')}), 6) as avg_word_count, cast(max(length(text)) as integer) as max_text_length,
cast(min(length(text)) as integer) as min_text_length from documents""")
def text_length_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.text_length_stats(spread(documents(spark, folder), "post_id"))


@register("brand_sentiment_crosstab", f"""with {q.POSTS} select brand,
count(*) filter (where sentiment = 'negative') as negative, count(*) filter (where sentiment = 'neutral') as neutral,
count(*) filter (where sentiment = 'positive') as positive
from posts where brand is not null and sentiment is not null group by brand""")
def brand_sentiment_crosstab(spark: SparkSession, folder: str) -> DataFrame:
    return profile.crosstab(posts(spark, folder), "brand", "sentiment", CLASSES)


def _histogram_sql(measure: str, bins: int) -> str:
    return f"""with v as (select {measure} as v from documents),
r0 as (select min(v)::double as a, max(v)::double as b from v),
r as (select case when a = b then a - 0.5 else a end as lo, case when a = b then b + 0.5 else b end as hi from r0),
w as (select lo, (hi - lo) / {float(bins)}::double as width from r),
placed as (select least({bins - 1}, cast(floor((v - lo) / width) as integer)) as bin from v, w),
counted as (select bin, count(*) as n from placed group by bin)
select cast(b.bin as integer) as bin, round(lo + b.bin * width, 6) as bin_start,
       round(lo + (b.bin + 1) * width, 6) as bin_end, coalesce(c.n, 0) as n
from (select unnest(generate_series(0, {bins - 1})) as bin) b left join counted c on b.bin = c.bin, w"""


@register("text_length_hist", _histogram_sql("length(text)", LENGTH_BINS))
def text_length_hist(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(documents(spark, folder), text_length(F.col("text")), LENGTH_BINS)


@register("word_count_hist", _histogram_sql(q.word_count("text"), WORD_BINS))
def word_count_hist(spark: SparkSession, folder: str) -> DataFrame:
    return profile.histogram(spread(documents(spark, folder), "post_id"), word_count(F.col("text")), WORD_BINS)


@register("distinct_labels", f"""with {q.POSTS}
select distinct sentiment, (select count(distinct sentiment) from posts) as n_classes from posts""")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return profile.distinct_values(posts(spark, folder), "sentiment")


@register("preview_head", f"with {q.POSTS} select * from posts order by post_id limit 5")
def preview_head(spark: SparkSession, folder: str) -> DataFrame:
    # the first posts are picked before the join, and again after it
    first = profile.preview(documents(spark, folder), "post_id")
    return profile.preview(with_sentiment(first, folder), "post_id")


@register("sample_per_class", f"""with {q.POSTS}, ranked as (
  select *, row_number() over (partition by sentiment order by post_id) as rank from posts where sentiment is not null)
select upper(sentiment) as sentiment, cast(rank as integer) as rank, post_id, substring(text, 1, 100) || '...' as sample
from ranked where rank <= 2""")
def sample_per_class(spark: SparkSession, folder: str) -> DataFrame:
    return profile.samples_per_class(posts(spark, folder), "sentiment", "text", "post_id", texts=documents(spark, folder))


@register("project_text_label", f"with {q.POSTS} select text, sentiment from posts")
def project_text_label(spark: SparkSession, folder: str) -> DataFrame:
    return posts(spark, folder).select("text", "sentiment")
