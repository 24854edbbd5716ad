"""The registered queries of the operators, and the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpmill.session import work_path

from . import (collocations, decontaminate, importable, jaccard, licenses, lines, multiset, neighbours, packing, quality,
               quotations, token_files, trie, warc)

QUERIES: dict = {}
SQL: dict[str, str] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            importable(spark)
            return f(spark, folder)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f
    return keep


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_decontaminate", f"""
with d as (select doc_id, {_words('text', _LETTERED)} w from documents),
b as (select item_id, {_words('text', _LETTERED)} w from benchmark),
item_windows as (
  select item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g
  from b, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) t(i) where len(w) > 0),
sizes as (select distinct n from item_windows),
doc_windows as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
found as (select distinct doc_id, item_id, i, n from doc_windows join item_windows using (n, g)),
hit as (select doc_id, count(distinct p) n_hit from found, unnest(range(i, i + n)) t(p) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) items
          from (select distinct doc_id, cast(item_id as varchar) item from found) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join named using (doc_id)
""")
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))[0]


def _license_sql() -> str:
    rows = ", ".join(
        f"('{t}', '{label}', {base})"
        for table, base in ((licenses.BASE, "true"), (licenses.TEXTS, "false")) for t, label in table.items())
    k = licenses.K
    return f"""
with d as (select doc_id, {_words('text', _LETTERED)} w from documents),
t as (select template, label, base, string_split(template, ' ') w from (values {rows}) v(template, label, base)),
runs as (select template, label, base, len(w) - {k - 1} n_runs, i - 1 place, array_to_string(w[i:i + {k - 1}], ' ') said
         from t, unnest(range(1, len(w) - {k - 2})) u(i)),
said as (select doc_id, i - 1 p, array_to_string(w[i:i + {k - 1}], ' ') said from d, unnest(range(1, len(w) - {k - 2})) u(i)),
hits as (select doc_id, template, label, base, n_runs, place, p - place diagonal from said join runs using (said)),
places as (
  select doc_id, count(*) n_base, min(diagonal) first_word, max(diagonal) last_word,
         string_agg(distinct label, ',' order by label) base_labels, list(distinct label) base_set
  from (select doc_id, template, label, diagonal from hits where base
        group by doc_id, template, label, n_runs, diagonal having count(*) = n_runs) group by doc_id),
firsts as (select distinct doc_id, template, diagonal first from hits),
near as (
  select doc_id, template, label, base, n_runs, first, place, min(place + diagonal) word
  from hits join firsts using (doc_id, template)
  where diagonal between first and first + greatest({licenses.GAP}, (n_runs + {k - 1}) // {licenses.DRIFT_PART}) group by all),
behind as (
  select *, max(word) over (partition by doc_id, template, first order by place rows between unbounded preceding and 1 preceding) before
  from near),
shares as (
  select doc_id, label, base, count(*) filter (before is null or word > before)::double / n_runs share from behind
  group by doc_id, template, label, base, n_runs, first),
own as (
  select doc_id, max(share) score, list(distinct label) filter (not base and share >= {licenses.SHARE}) own_set
  from shares group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word,
       coalesce(base_labels, '') base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(own_set, [])))), ',') labels,
       coalesce(score, 0.0)::double score
from d left join places using (doc_id) left join own using (doc_id)
"""


@query("op3_license_scan", _license_sql())
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


@query("op10_warc", f"""
with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) payload_bytes,
                  sha256(coalesce(html, '')) payload_digest from pages),
f as (select payload_digest, min(page_id) first_id from p where payload_bytes >= {warc.MIN_BYTES} group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id <> first_id then 'revisit' else 'response' end record_type,
       case when page_id <> first_id then first_id end refers_to
from p left join f using (payload_digest)
""")
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(_table(spark, folder, "pages"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token-files")
    token_files.write_ids(_table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_ids(spark, path).drop("ids")


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, folder, "labels")))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@query("op7_quotations", r"""
with recursive m as (select conv_id, turn, role, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) ls
  from conversations),
l as (select conv_id, turn, role, i, regexp_extract(ls[i], '^[ \t]*>[> \t]*') mark, ls[i] line from m, unnest(range(1, len(ls) + 1)) t(i)),
v as (select *, len(mark) - len(replace(mark, '>', '')) lv, regexp_replace(line, '^[ \t]*>[> \t]*', '') body from l),
g as (select *, sum(case when lv = prev then 0 else 1 end) over (partition by conv_id, turn order by i) run
      from (select *, lag(lv) over (partition by conv_id, turn order by i) prev from v)),
r as (select conv_id, turn, role, run, any_value(lv) lv, string_agg(body, chr(10) order by i) body from g group by conv_id, turn, role, run),
n as (select *, coalesce(lead(lv) over (partition by conv_id, turn order by run) > lv, false) announces from r),
e as (select conv_id, turn, role, run, lv, case when announces
        then regexp_replace(body, '(?m)^.*\b(wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*\s*\z', '') else body end body from n),
o as (select conv_id, turn, any_value(role) role, regexp_replace(regexp_replace(coalesce(string_agg(
        body, chr(10) order by run) filter (lv = 0), ''), '\A\s+|\s+\z', '', 'g'), '^ +| +$', '', 'g') own
      from e group by conv_id, turn),
said as (select distinct conv_id, turn, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) passage
  from o, unnest(list_concat([own], string_split(own, chr(10)), regexp_split_to_array(own, '\n[ \t]*\n'))) t(p)),
source as (select conv_id, passage, min(turn) source from said where passage <> '' group by conv_id, passage),
own_lines as (select conv_id, turn, list_filter(list_transform(string_split(own, chr(10)),
        lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') ls from o),
q as (select conv_id, turn, run, lv, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) passage,
        list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') ls
      from e where lv > 0),
sizes as (select distinct conv_id, len(ls) n from q where len(ls) > 1),
said_lines as (
  select conv_id, turn, array_to_string(ls[i:i + n - 1], chr(10)) said
  from own_lines join sizes using (conv_id), unnest(range(1, len(ls) - n + 2)) t(i)),
line_source as (select conv_id, said, min(turn) source from said_lines group by conv_id, said),
k as (select q.conv_id, q.turn, q.lv, len(q.passage) size,
             least(case when s.source < q.turn then s.source end, case when z.source < q.turn then z.source end) source
      from q left join source s on q.conv_id = s.conv_id and q.passage = s.passage
      left join line_source z on q.conv_id = z.conv_id and len(q.ls) > 1 and array_to_string(q.ls, chr(10)) = z.said
      where q.passage <> ''),
b as (select conv_id, turn, count(*) n_quotes, count(source) n_linked,
             arg_min(source, row(lv, -size, source)) filter (source is not null) parent_turn from k group by conv_id, turn),
tree as (
  select o.conv_id, o.turn, o.turn root_turn, 0 depth from o left join b using (conv_id, turn) where parent_turn is null
  union all
  select b.conv_id, b.turn, tree.root_turn, tree.depth + 1 from b join tree on b.conv_id = tree.conv_id and b.parent_turn = tree.turn)
select o.conv_id, row_number() over (partition by o.conv_id order by root_turn, o.turn) - 1 as position, o.turn, o.role, root_turn,
       parent_turn, depth, coalesce(n_quotes, 0) n_quotes, coalesce(n_linked, 0) n_linked, own as text
from o join tree using (conv_id, turn) left join b using (conv_id, turn)
""")
def op7_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return quotations.conversations(_table(spark, folder, "conversations"))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    kept, lost = lines.dedup(docs, exact_from=1)
    return kept.select("doc_id", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5")).join(
        lost.withColumnRenamed("doc_id", "lost_id"), F.expr("doc_id <=> lost_id"), "left").select(
        "doc_id", "n_chars_kept", "text_md5", F.coalesce("n_same", F.lit(0)).cast("long").alias("n_same"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


@query("op2_jaccard", f"""
with recursive d as (select doc_id, {_words('text', _SPACED)} w from documents),
s as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) where len(w) > 0),
n as (select doc_id, count(*) n from s group by doc_id),
shared as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (
  select doc_id, doc_id from d union select reach.doc_id, b from reach join both_ways on reach.other = a)
select d.doc_id, coalesce(n, 0) n_shingles, component_id
from d left join n using (doc_id) join (select doc_id, min(other) component_id from reach group by doc_id) using (doc_id)
""")
def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.classes(_table(spark, folder, "documents"))


def _multiset_sql() -> str:
    k, bits, lane_at = multiset.RUN, multiset.BITS, multiset.BITS - multiset.LANE_BITS
    run = " + ".join(f"coalesce(h[s + {j}], 0) * {f}" for j, f in enumerate(multiset.FACTORS))
    near = ("case when {a} = {b} then 1.0 when coalesce({p}, 0) <= 0 then 0.0 "
            "else least(1.0, {p}::double / ({x} + {y} - {p})::double) end::double")
    return f"""
with d as materialized (
  select row_number() over (order by doc_id desc nulls last, md5(coalesce(text, ''))) - 1 i, doc_id, coalesce(text, '') text
  from documents),
pair as materialized (
  select d.i, d.doc_id, d.text, length(d.text) n_chars, later.i next_i,
         left(d.text, length(d.text) - length(d.text) // 2) || left(later.text, length(d.text) // 2) edited
  from d join d later on later.i = (d.i + 1) % (select count(*) from d)),
texts as (select i, 0 kind, text from pair union all select i, 1, edited from pair),
paragraphs as materialized (select i, kind, p from texts, unnest(string_split(text, chr(10))) t(p)),
digests as (select i, kind, salt, sha256(salt || ':' || sha256(p)) d from paragraphs, range({multiset.SALTS}) s(salt)),
equal_lanes as (
  select i, kind, salt * 8 + part lane, sum(('0x' || substr(d, part::bigint * 8 + 1, 8))::bigint) v
  from digests, range(8) r(part) group by all),
hashed as (
  select i, kind, list_transform(regexp_extract_all(p, '{_SPACED}'), lambda w: ('0x' || left(md5(w), {bits // 4}))::bigint::hugeint) h
  from paragraphs),
runs as (select i, kind, ({run}) % {2 ** bits} r from hashed, unnest(range(1, greatest(len(h) - {k - 1}, 1) + 1)) t(s) where len(h) > 0),
alike as materialized (
  select i, kind, (r // {2 ** lane_at})::bigint lane, sum(case when (r // {2 ** (lane_at - 1)}) % 2 = 1 then 1 else -1 end) v
  from runs group by all),
lanes as (
  select i, kind, lane, v from equal_lanes union all select i, kind, lane + {multiset.EQUAL}, v from alike),
prints as materialized (
  select i, kind, string_agg(printf('%08x', ((coalesce(v, 0) % 4294967296 + 4294967296) % 4294967296)::bigint), '' order by lane) f
  from (select i, kind, lane from pair, range(2) k(kind), range({multiset.LANES}) l(lane)) left join lanes using (i, kind, lane)
  group by i, kind),
squares as materialized (select i, kind, sum(v * v) q from alike group by i, kind),
by_edit as (select a.i, sum(a.v * b.v) p from alike a join alike b on a.i = b.i and a.lane = b.lane where a.kind = 0 and b.kind = 1 group by a.i),
by_next as (
  select pair.i, sum(a.v * b.v) p from pair join alike a on a.i = pair.i join alike b on b.i = next_i and a.lane = b.lane
  where a.kind = 0 and b.kind = 0 group by pair.i)
select doc_id, n_chars, sha256(edited) edited_sha256, f.f fingerprint, e.f edited_fingerprint,
       {near.format(a="f.f", b="e.f", p="by_edit.p", x="fq.q", y="eq.q")} near_edited,
       {near.format(a="f.f", b="l.f", p="by_next.p", x="fq.q", y="lq.q")} near_next
from pair join prints f on f.i = pair.i and f.kind = 0 join prints e on e.i = pair.i and e.kind = 1
join prints l on l.i = next_i and l.kind = 0
left join squares fq on fq.i = pair.i and fq.kind = 0 left join squares eq on eq.i = pair.i and eq.kind = 1
left join squares lq on lq.i = next_i and lq.kind = 0
left join by_edit on by_edit.i = pair.i left join by_next on by_next.i = pair.i
"""


@query("op11_fingerprints", _multiset_sql())
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return multiset.edited(_table(spark, folder, "documents"))


#: The remainder of crc32 of a conversation's id, bit by bit, as SQL has no such function.
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4"""


@query("op12_prefix_trie", f"""
with t as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text, turn from conversations where conv_id is not null),
own as materialized (
  select conv_id, md5(length(role) || ':' || role || text) digest, len(regexp_extract_all(text, '{_SPACED}')) words,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) place from t),
c as materialized (
  select conv_id, count(*) n_own, conv_id - conv_id % 20 base, {_CRC} h from own group by conv_id),
sized as materialized (
  select c.conv_id, c.base, c.h, least(c.h, coalesce(b.n_own, 0)) used, c.n_own from c left join c b on b.conv_id = c.base),
turns as (
  select s.conv_id, o.place depth, digest, words from sized s join own o on o.conv_id = s.base and o.place <= h
  union all
  select s.conv_id, o.place - h + used, digest, words from sized s join own o on o.conv_id = s.conv_id and o.place > h),
r as materialized (
  select conv_id, depth, words, list(digest) over (partition by conv_id order by depth) path from turns
  union all select conv_id, 0, 0, [] from c),
n as materialized (
  select depth, path, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * max(words) saved from r group by depth, path),
up as materialized (
  select n.depth, n.path, p.path up_path, p.conv_id parent_conv_id from n join r on r.conv_id = n.conv_id and r.depth = n.depth - 1
  join n p on p.depth = r.depth and p.path = r.path),
children as materialized (select depth - 1 depth, up_path path, count(*) n_children from up group by all),
subtree as (
  select r.depth, r.path, sum(case when children.path is null then 1 else 0 end) n_leaves, sum(saved) saved_tokens
  from n left join children on children.depth = n.depth and children.path = n.path
  join r on r.conv_id = n.conv_id and r.depth <= n.depth group by r.depth, r.path),
ends as (
  select depth, path, string_agg(conv_id::varchar, ',' order by conv_id) ids
  from (select r.* from r join (select conv_id, max(depth) depth from r group by conv_id) using (conv_id, depth)) group by depth, path)
select n.conv_id, n.depth::bigint depth, parent_conv_id, n_convs, coalesce(n_children, 0) n_children, n_leaves::bigint n_leaves,
       saved_tokens::bigint saved_tokens, sha256(coalesce(ids, '')) ends_sha256
from n left join up using (depth, path) left join children using (depth, path) join subtree using (depth, path)
left join ends using (depth, path)
""")
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.nodes(_table(spark, folder, "conversations"))


_PIECES = r"[.,;:!?\x0A-\x0D]"


@query("op13_collocations", f"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PIECES}')) p
  from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces),
f as materialized (
  select lang, array_to_string(w[i:i + k - 1], ' ') phrase, k, count(*) f
  from w, range(1, 4) s(k), unnest(range(1, len(w) - k + 2)) t(i) group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as materialized (
  select lang, phrase, string_split(phrase, ' ') w, k, f a from f where k > 1 and f >= {collocations.LEAST}),
covered as (
  select distinct lang, phrase from (
    select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) phrase from c where k = 3) long
  join (select lang, phrase, f from f where k = 2) using (lang, phrase) where 100 * a >= {collocations.COVER} * f),
cuts as (
  select c.lang, c.phrase, a, cut, lf.f l, rf.f r, ({collocations.SCALE}::hugeint * a * a) // (lf.f::hugeint * rf.f) score
  from c, range(1, 3) t(cut) join f lf on lf.lang = c.lang and lf.phrase = array_to_string(c.w[1:cut], ' ')
  join f rf on rf.lang = c.lang and rf.phrase = array_to_string(c.w[cut + 1:c.k], ' ') where cut < c.k),
best as (
  select * from cuts anti join covered using (lang, phrase)
  qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from best)
select lang, rank, phrase, a, l, r, n, score::bigint score from ranked join n using (lang) where rank <= {collocations.TOP}
""")
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))
