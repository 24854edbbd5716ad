"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are compared trimmed. A line goes if the same line stands earlier (by document id, then by line number), or if
it has ``MIN_CHARS`` characters or more and an earlier such line is within ``EDITS`` edits of it. Repeats are looked for
among lines of ``exact_from`` characters or more: with 1 these are all lines but blank ones, as the registered query and
the pipeline have it; by default shorter lines than ``MIN_CHARS`` are left alone.

Two strings within t edits, cut into t + 1 segments, share a segment near its place. Each different line gives
the hashes of its own segments and of those substrings of it that could be a segment of a line up to t characters
shorter (only places that the edits left over on either side allow). Lines that share a hash are candidates.

In a group of candidates every line is first compared with the earliest one, so a group of any size costs a row a
line. Groups of ``FEW`` lines are then joined with themselves for the lines that this does not settle. The lines of larger
groups are cut again, into ``t + FINE`` segments: t edits leave ``FINE`` of them as they are, so two near lines agree
in all but some t segments (those in between moved by what the edits before them put in or take out). Lines that agree so
are groups again, their earliest line is tried first, and only lines that are open after both rounds are joined with
all earlier ones of such a group. Filters that no pair within t edits fails stand before every such pair: on lengths, and on
the parities of counts of characters and of pairs of neighbours. Pairs are verified by a bit-parallel edit distance in a band of 2t + 1 diagonals:
a column of the band is two words of bits, kept in one number.

Hashes that very many lines share are seen in a sample of the documents, which decides nothing but how the rows of such a
hash are dealt: over shares, each with an earliest line of its own, of which the earliest is then taken.

Texts are not shuffled for the join: hashes go by line, and only texts of candidates are fetched. Edge cases: null and
empty texts have no lines to compare; rows may repeat an id (equal lines at one place of one id count as one line);
null ids come first; empty tables give empty results. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpmill.session import stage

MIN_CHARS = 20
EDITS = 2
#: Segments that near lines of a large group have alike, at least.
FINE = 4
#: Open lines of groups up to this size are compared with all earlier lines of the group.
FEW = 32
#: One in so many documents is looked at for hashes to deal over ``SHARES`` shares: those of one in ``HOT`` of its rows.
LOOKED_AT, HOT, SHARES = 64, 2000, 64
#: Parities of character counts are kept for characters hashed into so many classes.
CLASSES = 61


def split_lines(docs: DataFrame, id_col: str, text_col: str, least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, no, line, size``: the lines that take part, those of ``least`` characters or more."""
    # trimmed and measured before they are exploded: what comes later reads a column and not the rule for it
    cut = F.transform(F.transform(F.split(F.col(text_col), "\n", -1), trimmed), lambda x: F.struct(x.alias("line"), F.length(x).alias("size")))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("no", "x"))
        .select("doc_id", "no", "x.line", "x.size").where(F.col("size") >= least)
    )


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _place(doc_id: Column, no: Column, kind: T.DataType) -> Column:
    """What orders places, null ids first: one number for ids that are whole numbers, so that the least of them is a hash aggregate."""
    if not isinstance(kind, T.IntegralType):
        return F.struct(doc_id.alias("doc_id"), no.alias("no"))
    whole = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(f"{-2**63 - 1}").cast("decimal(19,0)"))
    return (whole * F.lit("2147483648").cast("decimal(10,0)") + no.cast("decimal(10,0)")).cast("decimal(38,0)")


def _of_place(at: Column, kind: T.DataType) -> tuple[Column, Column]:
    """Document and line number of a place."""
    if not isinstance(kind, T.IntegralType):
        return at.getField("doc_id"), at.getField("no")
    wide = F.lit("2147483648").cast("decimal(10,0)")
    no = F.pmod(at, wide).cast("int")
    doc_id = F.call_function("div", (at - no.cast("decimal(10,0)")).cast("decimal(38,0)"), wide)
    return F.when(at >= F.lit(f"{-2**94}").cast("decimal(38,0)"), doc_id).cast(kind), no


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, where a lambda inside it would work it out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _begin(segment: str, size: str, parts: int) -> str:
    """Characters before a segment: the first ones have the base length, the last ``size % parts`` one character more."""
    return f"({segment} * ({size} div {parts}) + greatest(0, {segment} - {parts} + {size} % {parts}))"


def segment_cases(edits: int) -> str:
    """Characters fewer, segment, shift: the substrings by which lines within ``edits`` edits meet."""
    cases = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, less - (edits - i)), min(i, less + edits - i)
            # equal lengths meet in one direction: the other line has the opposite shift
            cases += [f"struct({less} as less, {i} as i, {shift} as shift)" for shift in range(0 if less == 0 else low, high + 1)]
    return f"array({', '.join(cases)})"


def fine_cases(edits: int) -> str:
    """Characters fewer, number of a choice of ``edits`` segments, and the runs of the other segments with their shifts."""
    parts, cases = edits + FINE, {}
    for chosen, less in product(enumerate(combinations(range(parts), edits)), range(edits + 1)):
        no, out = chosen
        edges = [-1, *out, parts]
        for shifts in product(range(-edits, edits + 1), repeat=edits - 1):
            shifts = (0, *shifts, less)
            if sum(abs(a - b) for a, b in zip(shifts, shifts[1:])) > edits:
                continue
            runs = tuple((a + 1, b, shift) for a, b, shift in zip(edges, edges[1:], shifts) if b - a > 1)
            moved = [shift for *_, shift in runs if shift]
            if less or not moved or moved[0] > 0:  # equal lengths meet in one direction
                cases[less, no, runs] = None
    texts = (f"struct({less} as less, {no} as no, array({', '.join(f'struct({a} as a, {b} as b, {s} as s)' for a, b, s in runs)}) as runs)"
             for less, no, runs in cases)
    return f"array({', '.join(texts)})"


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``key`` beside the columns of ``lines``: a row for each hash by which ``line`` (of ``size`` characters) may meet others."""
    begin, end = _begin("c.i", "(size - c.less)", edits + 1), _begin("(c.i + 1)", "(size - c.less)", edits + 1)
    # a row for each case first: the hash is then plain compiled code
    return lines.withColumn("c", F.explode(F.expr(segment_cases(edits)))).withColumn("key", F.expr(
        f"xxhash64(size - c.less, c.i, substring(line, cast({begin} + c.shift + 1 as int), cast({end} - {begin} as int)))")).drop("c")


def fine_keys(lines: DataFrame, edits: int) -> DataFrame:
    """``key`` beside the columns of ``lines``: a row for each hash of all segments but ``edits`` of them."""
    begin, end = _begin("r.a", "(size - c.less)", edits + FINE), _begin("r.b", "(size - c.less)", edits + FINE)
    return lines.withColumn("c", F.explode(F.expr(fine_cases(edits)))).withColumn("key", F.expr(
        "xxhash64(size - c.less, c.no, transform(c.runs, r ->"
        f" substring(line, cast({begin} + r.s + 1 as int), cast({end} - {begin} as int))))")).drop("c")


def repeats(lines: DataFrame) -> DataFrame:
    """``doc_id, no``: places of lines that stand at an earlier place too."""
    hashed = stage(lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "doc_id", "no",
        _place(F.col("doc_id"), F.col("no"), lines.schema["doc_id"].dataType).alias("at")), "line-hashes")
    again = stage(hashed.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "lines-repeated")
    return hashed.join(again.hint("merge"), ["h1", "h2"]).where("at <> first").select("doc_id", "no")


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """``key, at, head``: the first places of different lines that share a hash, with the earliest of them."""
    places = lines.select(
        "doc_id", "line", "size", F.xxhash64("line").alias("h1"),
        _place(F.col("doc_id"), F.col("no"), lines.schema["doc_id"].dataType).alias("at"))
    looked_at = stage(
        segment_keys(places.where(F.pmod(F.xxhash64("doc_id", F.lit("looked at")), F.lit(LOOKED_AT)) == 0), edits)
        .groupBy("key").agg(F.count("*").alias("n")), "line-keys-looked-at")
    total = looked_at.agg(F.sum("n")).first()[0] or 0
    # at most HOT rows, whatever the table
    hot = looked_at.where(F.col("n") >= max(LOOKED_AT, -(-total // HOT))).select("key", F.lit(True).alias("hot"))
    dealt = (
        segment_keys(places, edits).select("key", "h1", "at").join(F.broadcast(hot), "key", "left")
        .withColumn("share", F.when(F.col("hot"), F.pmod(F.hash("at"), F.lit(SHARES)) + 1).otherwise(0))
    )
    group = Window.partitionBy("key", "share")
    met = stage(
        dealt.select("key", "share", "h1", "at", F.min("at").over(group).alias("head"),
                     F.min("h1").over(group).alias("low"), F.max("h1").over(group).alias("high"))
        .where("share > 0 or low <> high"), "lines-met")
    # as many rows as hashes that are dealt
    joined = met.where("share > 0").groupBy("key").agg(
        F.min("head").alias("first"), F.min("low").alias("lowest"), F.max("high").alias("highest"))
    return stage(
        met.join(F.broadcast(joined), "key", "left").where("share = 0 or lowest <> highest")
        # the copies of a line share all of its hashes: it goes on once, by its first place
        .groupBy("key", "h1").agg(F.min("at").alias("at"), F.min(F.coalesce("first", "head")).alias("head"))
        .select("key", "at", "head"), "line-candidates")


def fetched(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``at, line, size, parity, beside`` of the lines at ``places``."""
    kind = docs.schema[id_col].dataType
    doc_id, no = _of_place(F.col("at"), kind)
    # which lines are asked for grows with the documents, so the texts are joined in one way at every size
    wanted = stage(places.select(doc_id.alias("want_id"), no.alias("no")).groupBy("want_id").agg(
        F.collect_set("no").alias("nos")), "lines-wanted").hint("merge")
    parity = F.aggregate("chars", F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(_bit(c)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stage(
        texts.join(wanted, F.expr("doc_id <=> want_id"))
        .select("doc_id", "nos", F.split("text", "\n", -1).alias("all"))
        .select("doc_id", F.explode(F.transform("nos", lambda n: F.struct(n.alias("no"), F.get("all", n).alias("line")))).alias("x"))
        .select(_place(F.col("doc_id"), F.col("x.no"), kind).alias("at"), trimmed(F.col("x.line")).alias("line"))
        .withColumn("size", F.length("line")).where(F.col("size") >= MIN_CHARS).distinct()
        .withColumn("chars", F.split("line", "")).withColumn("parity", parity)
        .select("at", "line", "size", "parity", neighbour_parity(F.col("line")).alias("beside")), "line-texts")


def _bit(c: Column) -> Column:
    """The bit of a character's class."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(c), F.lit(CLASSES)).cast("int"))


def neighbour_parity(line: Column) -> Column:
    """Parities of counts of neighbouring characters, hashed into 64 classes; an edit changes four of them at most."""
    return _bound(F.split(line, ""), lambda chars: F.aggregate(
        F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), lambda a, b: F.when(
            b.isNull(), F.lit(0).cast("long")).otherwise(
                F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(a, b), F.lit(64)).cast("int")))),
        F.lit(0).cast("long"), lambda bits, bit: bits.bitwiseXOR(bit)))


def _bits(k: int) -> tuple[int, int]:
    return 2 * k + 1, (1 << (2 * k + 1)) - 1


def within(left: str, right: str, edits: int) -> Column:
    """Whether two strings of more than ``edits`` characters each are within ``edits`` edits.

    Column j of the band holds the vertical steps of rows j - k to j + k as bits; the distance is followed along
    the lowest diagonal and then along the last row. State: distance, falling steps and rising steps in one number.
    """
    wide, mask = _bits(edits)
    match = " + ".join(
        f"if(get(x.a, j - 1 + {t - edits}) = x.b[j - 1], {1 << t}, 0)" for t in range(wide))
    start = (edits << (2 * wide)) + (mask ^ ((1 << edits) - 1))
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    follow = (
        f"if(j + {edits} <= size(x.a), if((z & {1 << (2 * edits)}) = 0, 1, 0),"
        f" cast(shiftright(up, size(x.a) - j + {edits}) & 1 as int) - cast(shiftright(z & v.p, size(x.a) - j + {edits}) & 1 as int))"
    )
    step = let(
        "v", f"struct(s & {mask}L as p, shiftright(s, {wide}) & {mask}L as q, cast({match} as bigint) as m, shiftright(s, {2 * wide}) as d)",
        let("z", f"((((v.m & v.p) + v.p) ^ v.p) | v.m | v.q) & {mask}L",
            let("up", f"(v.q | ~(z | v.p)) & {mask}L",
                f"shiftleft(v.d + {follow}, {2 * wide}) + shiftleft((shiftright(z, 1) & up) & {mask}L, {wide})"
                f" + (((z & v.p) | ~(shiftright(z, 1) | up)) & {mask}L)")))
    walk = f"shiftright(aggregate(sequence(1, size(x.b)), {start}L, (s, j) -> {step}), {2 * wide}) <= {edits}"
    both = f"transform(array(struct(split({left}, '') as a, split({right}, '') as b)), x -> {walk})[0]"
    return F.expr(f"abs(length({left}) - length({right})) <= {edits} and {both}")


def near(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``at``: those of the pairs ``at, other`` whose lines are within ``edits`` edits."""
    one = texts.select("at", F.col("line").alias("one"), F.col("parity").alias("one_parity"))
    two = texts.select(F.col("at").alias("other"), F.col("line").alias("two"), F.col("parity").alias("two_parity"))
    return stage(
        pairs.distinct().join(one, "at").join(two, "other")
        .where(F.bit_count(F.col("one_parity").bitwiseXOR(F.col("two_parity"))) <= 2 * edits)
        .where(within("one", "two", edits)).select("at").distinct(), "lines-near")


def earlier(members: DataFrame, edits: int) -> DataFrame:
    """``at, other``: open members (``key, at, open, size, parity, beside``) with earlier ones of their group that may be near."""
    others = members.select("key", *[F.col(c).alias(f"other_{c}") for c in ("at", "size", "parity", "beside")])
    return members.where("open").join(others, "key").where(
        (F.col("other_at") < F.col("at")) & (F.abs(F.col("size") - F.col("other_size")) <= edits)
        & (F.bit_count(F.col("parity").bitwiseXOR(F.col("other_parity"))) <= 2 * edits)
        & (F.bit_count(F.col("beside").bitwiseXOR(F.col("other_beside"))) <= 4 * edits)).select("at", F.col("other_at").alias("other"))


def still_open(members: DataFrame, settled: DataFrame) -> DataFrame:
    """``members`` (``key, at`` and more) of groups of two or more with a member that is not ``settled``; ``open`` marks those, ``n`` counts."""
    marked = stage(members.join(settled.withColumn("settled", F.lit(True)), "at", "left").select(
        *members.columns, F.col("settled").isNull().alias("open")), "line-members")
    groups = marked.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any and n > 1")
    return marked.join(groups.select("key", "n"), "key")


def near_places(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    """``doc_id, no`` of different lines that an earlier line is near to."""
    found = candidates(lines, edits)
    texts = fetched(docs, found.select("at"), id_col, text_col)
    others = found.where("at <> head")
    by_head = near(others.select("at", F.col("head").alias("other")), texts, edits)

    # what the filters need stays with a member from here on, so that it is fetched once and not again for each side of a join
    tests = ["at", "size", "parity", "beside"]
    members = stage(still_open(others.select("key", "at").join(texts.select(tests), "at"), by_head), "lines-open")
    by_few = near(earlier(members.where(F.col("n") <= FEW), edits), texts, edits)

    settled = by_head.unionByName(by_few).distinct()
    large = members.where(F.col("n") > FEW).select("at").distinct().join(texts, "at")
    fine = stage(fine_keys(large, edits).select("key", *tests).distinct(), "line-fine-keys")
    heads = fine.groupBy("key").agg(F.min("at").alias("head"), F.max("at").alias("last")).where("head <> last").select("key", "head")
    agreed = stage(fine.join(heads, "key").where("at <> head"), "line-agreed")
    by_fine = near(agreed.join(settled, "at", "left_anti").select("at", F.col("head").alias("other")), texts, edits)
    rest = still_open(agreed.drop("head"), settled.unionByName(by_fine).distinct())
    by_rest = near(earlier(stage(rest, "lines-open"), edits), texts, edits)

    doc_id, no = _of_place(F.col("at"), docs.schema[id_col].dataType)
    every = by_head.unionByName(by_few).unionByName(by_fine).unionByName(by_rest)
    return every.distinct().select(doc_id.alias("doc_id"), no.alias("no"))


def dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
            exact_from: int = MIN_CHARS) -> DataFrame:
    """``doc_id, no, near``: the places of lines that go; ``near`` tells an edited line from a repeated one."""
    lines = split_lines(docs, id_col, text_col, exact_from)
    close = near_places(docs, lines.where(F.col("size") >= MIN_CHARS), id_col, text_col, edits)
    return stage(repeats(lines).withColumn("near", F.lit(False)).unionByName(close.withColumn("near", F.lit(True))).distinct(), "lines-dropped")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
          keep_emptied: bool = True, exact_from: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """All columns of ``docs`` with the lines that stay in ``text_col``, and ``doc_id, n_same, n_near`` of texts that lose some.

    Without ``keep_emptied``, rows that lose every line but blank ones go.
    """
    gone = dropped(docs, id_col, text_col, edits, exact_from)
    by_doc = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(
        F.sort_array(F.collect_set("no")).alias("gone_nos"),
        F.count_if(~F.col("near")).alias("n_same"), F.count_if("near").alias("n_near"))
    lost = stage(by_doc, "lines-by-document")
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("whole"), F.col(id_col).alias("own_id")).join(
        lost.select("gone_id", "gone_nos").hint("merge"), F.expr("own_id <=> gone_id"), "left")
    text = F.col("whole").getField(text_col)
    rebuilt = F.when(F.col("gone_nos").isNull(), text).otherwise(_bound(F.split(text, "\n", -1), lambda parts: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone_nos")), lambda i: F.get(parts, i)), "\n")))
    if not keep_emptied:
        inner = inner.withColumn("rebuilt", rebuilt).where(F.col("gone_nos").isNull() | F.col("rebuilt").rlike(r"\S"))
        rebuilt = F.col("rebuilt")
    out = inner.select(*[rebuilt.alias(n) if n == text_col else F.col("whole").getField(n).alias(n) for n in names])
    return out, lost.select(F.col("gone_id").alias("doc_id"), "n_same", "n_near")
