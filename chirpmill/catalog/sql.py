"""SQL pieces the oracle texts are put together from; patterns come from the shared constants."""

from __future__ import annotations

from ..functions import patterns as p
from .literals import literal_values


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- scalar expressions -------------------------------------------------------------------------
def strip(c: str) -> str:
    return f"trim({c}, {quoted(p.WHITESPACE_CHARS)})"


def delete(c: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({c}, {quoted(pattern)}, {quoted(by)}, 'g')"


def strip_urls(c: str) -> str:
    return delete(c, p.URL)


def strip_mentions(c: str) -> str:
    return delete(c, p.MENTION)


def strip_hashes(c: str) -> str:
    return f"replace({c}, '#', '')"


def strip_punct(c: str) -> str:
    return delete(c, p.PUNCT)


def letters_only(c: str) -> str:
    return f"trim({delete(c, p.NOT_LETTERS, ' ')})"


def expand_contractions(c: str) -> str:
    for short, long in p.CONTRACTIONS:
        c = f"replace({c}, {quoted(short)}, {quoted(long)})"
    return c


def normalised(c: str) -> str:
    return expand_contractions(f"lower({c})")


def lexicon_count(c: str, words: tuple[str, ...]) -> str:
    known = ", ".join(quoted(w) for w in words)
    return f"len(list_filter(regexp_extract_all({c}, {quoted(p.TOKEN)}), lambda w: w in ({known})))"


def lexicon_suffix(pos: str, neg: str) -> str:
    return (f"case when {pos} > {neg} and {pos} >= {p.MIN_HITS} then ' positive' "
            f"when {neg} > {pos} and {neg} >= {p.MIN_HITS} then ' negative' when {pos} is not null then '' end")


def clean_basic(c: str) -> str:
    """Step by step, as the rule is worded."""
    return strip(strip_punct(delete(strip_urls(f"lower({c})"), f"{p.MENTION}|#")))


def clean_enhanced(c: str) -> str:
    base = normalised(c)
    letters = letters_only(strip_hashes(strip_mentions(strip_urls(base))))
    return (f"{letters} || "
            + lexicon_suffix(f"({lexicon_count(base, p.POSITIVE_WORDS)})", f"({lexicon_count(base, p.NEGATIVE_WORDS)})"))


def word_count(c: str) -> str:
    return f"len(regexp_extract_all({c}, {quoted(p.TOKEN)}))"


def joined(array: str) -> str:
    return f"array_to_string({array}, ' ')"


# --- table expressions --------------------------------------------------------------------------
POSTS = """posts as (
  select d.doc_id as post_id, d.text, d.lang, d.source as brand,
         case when l.toxic = 1 then 'negative' when l.quality = 1 then 'positive'
              when l.doc_id is not null then 'neutral' end as sentiment
  from documents d left join labels l on d.doc_id = l.doc_id)"""

LABELED = POSTS + """, labeled as (
  select post_id, text, brand, sentiment,
         case sentiment when 'negative' then 0 when 'neutral' then 1 else 2 end as label_id
  from posts where sentiment is not null)"""

LITERALS = f"literals as (select * from ({literal_values()}) t(post_id, text, brand, sentiment))"

TEXTS = LITERALS + """, texts as (
  select 'd' || doc_id as text_key, text from documents
  union all select 'p' || page_id, html from pages
  union all select 'c' || conv_id || '.' || turn, text from conversations
  union all select 'l' || post_id, text from literals)"""

PREPARED = LABELED + f""", cleaned as (
  select post_id, brand, sentiment, label_id, {clean_enhanced('text')} as cleaned_text from labeled),
prepared as (select * from cleaned where length(cleaned_text) > 0)"""

RATIOS = " ".join(f"when {k} then cast({r} as double)" for k, r in p.RESAMPLE_RATIOS.items())

RESAMPLED = PREPARED + f""", sizes as (select label_id, count(*) as class_n from prepared group by label_id),
draws as (
  select label_id, class_n, unnest(generate_series(1, draws)) as draw_no from (
    select label_id, class_n,
           cast(floor(cast((select class_n from sizes where label_id = 0) as double)
                      * case label_id {RATIOS} end) as bigint) as draws
    from sizes where label_id <> 0)),
drawn as (
  select label_id, draw_no,
         cast('0x' || substr(md5('{p.SEED}:' || label_id || ':' || draw_no), 1, 15) as bigint) % class_n as place
  from draws),
placed as (
  select post_id, label_id,
         row_number() over (partition by label_id order by md5('{p.SEED}:' || post_id)) - 1 as place
  from prepared),
resampled as (select post_id, label_id, draw_no from drawn join placed using (label_id, place)),
balanced as (
  select post_id, label_id, cast(0 as bigint) as draw_no from prepared where label_id = 0
  union all select post_id, label_id, draw_no from resampled)"""


def split(source: str, order: str, test: float, val: float, prefix: str = "") -> str:
    """CTEs ending in ``<prefix>assigned``: rows of ``source`` with their split."""
    n = prefix
    return f"""{n}q0 as (select label_id, count(*) as n from {source} group by label_id),
{n}q1 as (select *, cast(sum(n) over () as double) as total from q0_),
{n}q2 as (
  select *, total - ceil(cast({test} as double) * total) as wanted,
         n / total * (total - ceil(cast({test} as double) * total)) as exact from {n}q1),
{n}q3 as (
  select *, floor(exact) + case when row_number() over (order by exact - floor(exact) desc, label_id)
         <= wanted - sum(floor(exact)) over () then 1 else 0 end as rest_n from {n}q2),
{n}q4 as (select label_id, n, rest_n, sum(rest_n) over () as rest_total from {n}q3),
{n}q5 as (
  select *, rest_total - ceil(cast({val} as double) * rest_total) as wanted,
         rest_n / rest_total * (rest_total - ceil(cast({val} as double) * rest_total)) as exact from {n}q4),
{n}q6 as (
  select *, floor(exact) + case when row_number() over (order by exact - floor(exact) desc, label_id)
         <= wanted - sum(floor(exact)) over () then 1 else 0 end as train_n from {n}q5),
{n}assigned as (
  select s.*, case when s.rn <= q.train_n then 'train' when s.rn <= q.rest_n then 'val' else 'test' end as split
  from (select *, row_number() over (partition by label_id order by {order}) as rn from {source}) s
  join {n}q6 q using (label_id))""".replace("q0_", f"{n}q0")


SPLIT3 = RESAMPLED + ", " + split("balanced", f"md5('{p.SEED}:' || post_id || ':' || draw_no)", p.TEST_SHARE, p.VAL_SHARE)


def vocabulary(max_words: int) -> str:
    return SPLIT3 + f""", train_words as (
  select a.post_id, w.word, w.pos from assigned a join prepared c using (post_id),
         lateral (select unnest(string_split(c.cleaned_text, ' ')) as word,
                         generate_subscripts(string_split(c.cleaned_text, ' '), 1) as pos) w
  where a.split = 'train'),
counted as (
  select word, count(*) as n, min(cast(post_id as hugeint) * 10000000000 + pos) as first_seen
  from train_words group by word),
vocabulary as (
  select word, cast(row_number() over (order by n desc, first_seen) + {p.OOV_ID} as integer) as idx, n
  from (select * from counted order by n desc, first_seen limit {max_words - 2}))"""


def sequences(max_words: int) -> str:
    return vocabulary(max_words) + f""", tokens as (
  select post_id, unnest(string_split(cleaned_text, ' ')) as word,
         generate_subscripts(string_split(cleaned_text, ' '), 1) as pos from prepared),
sequences as (
  select t.post_id, list(coalesce(v.idx, {p.OOV_ID}) order by t.pos) as sequence
  from tokens t left join vocabulary v using (word) group by t.post_id)"""


SCORES = LABELED + """, mk as (
  select * from (values (1), (2), (3), (4)) m(model_id) cross join (values (0), (1), (2)) k(k)),
hashed as (
  select l.post_id, l.label_id, mk.model_id, mk.k,
         1 + ((l.post_id * 31 + mk.model_id * 101 + mk.k * 53) * (l.post_id * 31 + mk.model_id * 101 + mk.k * 53)) % 1009
           + case when mk.k = l.label_id then 100 * mk.model_id else 0 end as s
  from labeled l cross join mk),
scores as (
  select post_id, label_id, model_id,
         cast(max(case when k = 0 then s end) as double) / cast(sum(s) as double) as p0,
         cast(max(case when k = 1 then s end) as double) / cast(sum(s) as double) as p1,
         cast(max(case when k = 2 then s end) as double) / cast(sum(s) as double) as p2,
         max(case when k = 0 then s end) as s0, max(case when k = 1 then s end) as s1, max(case when k = 2 then s end) as s2,
         case when post_id % 5 = 0 then 'val' else 'test' end as split
  from hashed group by post_id, label_id, model_id)"""


def argmax(a: str, b: str, c: str) -> str:
    return f"case when {a} >= {b} and {a} >= {c} then 0 when {b} >= {c} then 1 else 2 end"


def aligned() -> str:
    columns = ", ".join(f"max(case when model_id = {m} then p{k} end) as m{m}_p{k}" for m in (1, 2, 3, 4) for k in (0, 1, 2))
    return SCORES + f", wide as (select post_id, label_id, split, {columns} from scores group by post_id, label_id, split)"


def methods() -> str:
    """``predicted``: one row per test post with the prediction of each of the four methods."""
    M, K = (1, 2, 3, 4), (0, 1, 2)
    own = {m: argmax(*[f"m{m}_p{k}" for k in K]) for m in M}
    average = [" + ".join(f"m{m}_p{k}" for m in M) for k in K]
    weighted = [" + ".join(f"m{m}_p{k} * weight_{m}" for m in M) for k in K]
    votes = [" + ".join(f"case when o{m} = {k} then 1 else 0 end" for m in M) for k in K]
    sure = [" + ".join(f"case when o{m} = {k} then greatest(m{m}_p0, m{m}_p1, m{m}_p2) else 0.0::double end" for m in M) for k in K]
    names = (("a", average), ("w", weighted), ("v", votes), ("c", sure))
    return aligned() + f""", val_accuracy as (
  select model_id, avg(cast(({argmax('p0', 'p1', 'p2')}) = label_id as integer)) as accuracy
  from scores where split = 'val' group by model_id),
weights as (select model_id, accuracy, pow(accuracy, 2) / sum(pow(accuracy, 2)) over () as weight from val_accuracy),
w as (select {', '.join(f'max(case when model_id = {m} then weight end) as weight_{m}' for m in M)} from weights),
owned as (select *, {', '.join(f'{own[m]} as o{m}' for m in M)} from wide, w),
summed as (
  select *, {', '.join(f'({e}) {"/ 4" if n == "a" else ""} as {n}{k}' for n, es in names for k, e in enumerate(es))} from owned),
predicted as (
  select *, {', '.join(f'{argmax(f"{n}0", f"{n}1", f"{n}2")} as pred_{n}' for n, _ in names)}
  from summed where split = 'test')"""


def cells() -> str:
    """``cells``: the confusion counts of the average method on the test posts, zeros kept."""
    return methods() + """, classes as (select * from (values (0, 'negative'), (1, 'neutral'), (2, 'positive')) t(k, name)),
cells as (
  select a.k as actual, a.name, b.k as pred, count(p.post_id) as n
  from classes a cross join classes b left join predicted p on p.label_id = a.k and p.pred_a = b.k
  group by a.k, a.name, b.k),
rated0 as (
  select actual, name, sum(case when pred = actual then n else 0 end) as hits, sum(n) as support,
         (select sum(n) from cells c2 where c2.pred = c1.actual) as predicted
  from cells c1 group by actual, name),
rated1 as (
  select *, coalesce(hits / nullif(cast(predicted as double), 0), 0) as precision,
         coalesce(hits / nullif(cast(support as double), 0), 0) as recall from rated0),
rated as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from rated1)"""
