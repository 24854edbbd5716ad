"""Collocations of two and three words, mined from a weighted de Bruijn graph.

Words in a piece (between punctuation marks or line breaks) make edges: a run of three words joins the node of its first
two to the node of its last two, and its weight is how often it stands in the texts of a language. Only these longest runs
are counted, together with the ends of pieces: the last two words and the last word have no third and no second word
behind them. All shorter counts follow from the flow: a pair stands as often as edges leave its node plus pieces end there,
a word as often as the pairs that it opens plus pieces end with it.

Tasks count runs before the shuffle (``run_blocks``), words coded as numbers; all runs of a chunk of text that open with the
same word are one row, so a row of the shuffle stands for many runs. The one large shuffle deals rows by their first word, so
that the edges that leave a node, and the nodes that leave a word, meet in one place, where their sums are taken
(``merged``). Words that stand more than ``HEAVY_RUNS`` times, and open more than one in ``MOST_HEAVY`` of all runs, are
found beforehand; their runs are dealt over as many shares as they fill, by the two words behind, and the sums of the shares
are added up afterwards (``flows``).

Frequent edges are then compacted (``paths``): edges u -> v -> x are parts of one path if v is entered and left by nothing
else (both edges weigh as much as v). Paths are found by pointer jumping and kept in blocks of ``BLOCK`` edges. Such a link
cannot close a circle, as a piece would have no end. A pair inside a path stands in a longer candidate each time it stands
anywhere, so it is settled without a look at its counts, and all runs of a path have the path's weight.

Numbers are exact: scores are integer quotients of decimals of 38 digits. Lookups of hot words are dealt over ``SALTS``
shares; the top rows of a language are cut in each task before the shuffle, so no task takes a whole language.

Edge cases: null texts are empty, a null language is ``und``; texts without words, empty tables and languages without a
frequent pair give no row; repeated rows count as often; only the two named columns are read, so none can clash. A text
larger than ``CHUNK_BYTES`` is cut between pieces, so memory follows the longest piece and the largest share of a word.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chirpmill.session import stage

LEAST = 10
COVER = 50
TOP = 2000
SCALE = 1_000_000
BLOCK = 1024
SALTS = 16
CHUNK_BYTES = 3 << 20
#: Runs are merged so many bytes of rows at a time, or a word's share if that is more.
MERGE_BYTES = 3 << 20
HEAVY_RUNS = 1_000_000
MOST_HEAVY = 10_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAKS = _CUTS.copy()
_BREAKS[[0x20, 0x09]] = True

_EDGE = ["lang", "pair", "third"]


def _chunks(offsets: np.ndarray, data: np.ndarray):
    """(first row, last row, from byte, to byte) of some texts at a time; one that is too large is cut between pieces."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        at, end = int(offsets[row]), int(offsets[last])
        while end - at > CHUNK_BYTES:
            # the last cut in the chunk, or else the first one behind it
            near = np.flatnonzero(_CUTS[data[at:at + CHUNK_BYTES]])
            if len(near):
                to = at + int(near[-1]) + 1
            else:
                far = np.flatnonzero(_CUTS[data[at + CHUNK_BYTES:end]])
                to = at + CHUNK_BYTES + int(far[0]) + 1 if len(far) else end
            yield row, last, at, to
            at = to
        yield row, last, at, end
        row = last


class _Coded(NamedTuple):
    """The words of a chunk in order: codes (from 1) in ``known``, languages in ``spoken``, and those behind in the piece (0: none)."""

    known: pa.Array
    spoken: pa.Array
    lang: np.ndarray
    word: np.ndarray
    second: np.ndarray
    third: np.ndarray


def _count_type(raw: np.ndarray) -> type:
    return np.int32 if len(raw) < 2 ** 31 else np.int64


def _coded(lang: pa.Array, offsets: np.ndarray, raw: np.ndarray) -> _Coded | None:
    inside = ~_BREAKS[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    n = len(start)
    if not n:
        return None
    text = np.searchsorted(offsets, start, "right") - 1
    kept = np.cumsum(inside, dtype=_count_type(raw))
    at = np.append(kept[start] - 1, kept[-1])
    words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[raw[inside]]))
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64) + 1
    langs = lang.dictionary_encode()
    # a word is followed in its piece if no cut and no other text lies between
    cuts = np.cumsum(_CUTS[raw], dtype=_count_type(raw))[start]
    follows = np.append((text[1:] == text[:-1]) & (cuts[1:] == cuts[:-1]), False)
    second = np.where(follows, np.append(code[1:], 0), 0)
    third = np.where(follows & np.append(follows[1:], False), np.append(second[1:], 0), 0)
    return _Coded(coded.dictionary.cast(pa.string()), langs.dictionary.cast(pa.string()),
                  langs.indices.to_numpy().astype(np.int64)[text], code, second, third)


def _different(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of the row of each different row of some columns of small numbers, in their order."""
    key = columns[0]
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if int(key.max(initial=0)) > (2 ** 62) // wide:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + c
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    moved = np.zeros(len(columns[0]), bool)
    moved[:1] = True
    for c in columns:
        moved[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(moved)


def _chunked(batch: pa.RecordBatch):
    column = batch.column(1).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for row, last, at, end in _chunks(offsets, data):
        found = _coded(batch.column(0).slice(row, last - row), np.clip(offsets[row:last + 1], at, end) - at, data[at:end])
        if found is not None:
            yield found


def _word_rows(batches):
    for c in (c for batch in batches if batch.num_rows for c in _chunked(batch)):
        first, number = _different(c.lang, c.word)
        yield pa.RecordBatch.from_arrays(
            [c.spoken.take(pa.array(c.lang[first])), c.known.take(pa.array(c.word[first] - 1)), pa.array(np.bincount(number), pa.int64())],
            names=["lang", "word", "f"])


def _block(c: _Coded, heavy: dict[tuple[str, str], int]) -> pa.RecordBatch:
    first, number = _different(c.lang, c.word, c.second, c.third)
    lang, word, second, third, times = c.lang[first], c.word[first], c.second[first], c.third[first], np.bincount(number)
    share = np.zeros(len(first), np.int64)
    place = {w: i for i, w in enumerate(c.known.to_pylist(), 1)} if heavy else {}
    tongues = {t: i for i, t in enumerate(c.spoken.to_pylist())}
    spread = [(tongues[t], place[w], n) for (t, w), n in heavy.items() if t in tongues and w in place]
    if spread:
        hashed = np.array([0] + [zlib.crc32(w.encode()) for w in place], np.int64)
        for t, w, n in spread:
            own = (lang == t) & (word == w)
            share[own] = (hashed[second[own]] * 31 + hashed[third[own]]) % n
        order = np.lexsort((third, second, share, word, lang))
        lang, word, second, third, times, share = (x[order] for x in (lang, word, second, third, times, share))
    texts = pa.concat_arrays([pa.array([""]), c.known])
    runs = pc.binary_join_element_wise(
        texts.take(pa.array(second)), texts.take(pa.array(third)), pa.array(times).cast(pa.string()), pa.scalar(" "))
    at = _starts(lang, word, share)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(runs)), pa.int32()), runs)
    return pa.RecordBatch.from_arrays(
        [c.spoken.take(pa.array(lang[at])), c.known.take(pa.array(word[at] - 1)), pa.array(share[at], pa.int32()),
         pc.binary_join(lists, "\n")], names=["lang", "word", "share", "runs"])


def _source(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def heavy_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[tuple[str, str], int]:
    """Words that would be too much for one task, and over how many shares their runs go; ``MOST_HEAVY`` at most."""
    words = stage(
        _source(docs, text_col, lang_col).mapInArrow(_word_rows, "lang string, word string, f long")
        .groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") > HEAVY_RUNS), "heavy-words")
    # fewer than MOST_HEAVY words can each hold more than that part of what they hold together
    n = words.agg(F.sum("f")).first()[0] or 0
    most = max(HEAVY_RUNS, n // MOST_HEAVY)
    return {(r.lang, r.word): int(-(-r.f // HEAVY_RUNS)) for r in words.where(F.col("f") > most).collect()}


def run_blocks(docs: DataFrame, heavy: dict[tuple[str, str], int], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, word, share, runs``: the runs of a chunk that open with a word, a line each: the two words behind and how often.

    At the end of a piece these words are empty.
    """
    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                for c in _chunked(batch):
                    out = _block(c, heavy)
                    # some rows at a time, as Spark takes a batch as a whole
                    for i in range(0, out.num_rows, 1 << 14):
                        yield out.slice(i, 1 << 14)

    return _source(docs, text_col, lang_col).mapInArrow(rows, "lang string, word string, share int, runs string")


def _told(kind: str, lang, pair, third, total) -> pa.RecordBatch:
    n = len(total)
    third = pa.nulls(n, pa.string()) if third is None else third
    return pa.RecordBatch.from_arrays(
        [pa.array([kind]).take(pa.array(np.zeros(n, np.int64))), lang, pair, third, pa.array(total, pa.int64())],
        names=["kind", *_EDGE, "total"])


def _merge(rows: pa.Table, least: int, shared: set[tuple[str, str]]):
    """The counts of all runs of some whole shares: frequent edges and nodes, and how often each first word stands."""
    rows = rows.combine_chunks()
    lang, word = (rows.column(c).combine_chunks() for c in ("lang", "word"))
    coded = [x.dictionary_encode() for x in (lang, word)]
    ids = [x.indices.to_numpy().astype(np.int64) for x in coded]
    starts = _starts(*ids, rows.column("share").to_numpy())
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids[0]))))
    lines = pc.split_pattern(rows.column("runs").combine_chunks(), "\n")
    group = np.repeat(group, pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    fields = pc.split_pattern(lines.flatten(), " ").flatten()
    places = np.arange(0, len(fields), 3)
    second, third = (fields.take(pa.array(places + i)).dictionary_encode() for i in (0, 1))
    times = fields.take(pa.array(places + 2)).cast(pa.int64()).to_numpy()
    two, three = (x.indices.to_numpy().astype(np.int64) for x in (second, third))
    first, number = _different(group, two, three)
    c = np.bincount(number, weights=times).astype(np.int64)  # exact below 2 ** 53
    group, two, three = group[first], two[first], three[first]
    # runs are in the order of group and second word
    opens = _starts(group, two)
    flow = np.add.reduceat(c, opens)
    heads = _starts(group)
    no_second = pc.equal(second.dictionary, "").to_numpy(zero_copy_only=False)
    no_third = pc.equal(third.dictionary, "").to_numpy(zero_copy_only=False)
    in_shares = np.array([pair in shared for pair in zip(lang.take(pa.array(starts)).to_pylist(), word.take(pa.array(starts)).to_pylist())]) \
        if shared else np.zeros(len(starts), bool)

    def of(at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        row = pa.array(starts[group[at]])
        return lang.take(row), pc.binary_join_element_wise(word.take(row), second.dictionary.take(pa.array(two[at])), " ")

    edge = np.flatnonzero((c >= least) & ~no_third[three])
    node = ~no_second[two[opens]] & ((flow >= least) | in_shares[group[opens]])
    at = opens[node]
    yield _told("edge", *of(edge), third.dictionary.take(pa.array(three[edge])), c[edge])
    yield _told("node", *of(at), None, flow[node])
    row = pa.array(starts[group[heads]])
    yield _told("word", lang.take(row), word.take(row), None, np.add.reduceat(c, heads))


def merged(blocks: DataFrame, heavy: dict[tuple[str, str], int], least: int = LEAST) -> DataFrame:
    """``kind, lang, pair, third, total``: sums over each share of a first word; of a heavy word all pairs, as parts."""
    shared = set(heavy)

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < MERGE_BYTES:
                continue
            # all but the last share are whole
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "word")]
            last = int(_starts(*key, table.column("share").to_numpy())[-1])
            if last:
                yield from _merge(table.slice(0, last), least, shared)
            rest = pa.Table.from_batches(table.slice(last).to_batches())
            held, size = rest.to_batches(), 0
        if held:
            yield from _merge(pa.Table.from_batches(held), least, shared)

    keys = ["lang", "word", "share"]
    return blocks.repartition(*keys).sortWithinPartitions("word", "lang", "share").mapInArrow(
        rows, "kind string, lang string, pair string, third string, total long")


def flows(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``kind, lang, pair, third, total``, written once.

    ``node``: a pair that stands ``least`` times; ``edge``: a run of three that does; ``word``: a word (in ``pair``).
    """
    heavy = heavy_words(docs, text_col, lang_col)
    parts = merged(run_blocks(docs, heavy, text_col, lang_col), heavy, least)
    if heavy:
        parts = parts.groupBy("kind", "lang", "pair", "third").agg(F.sum("total").alias("total")).where(
            (F.col("kind") == "word") | (F.col("total") >= least))
    return stage(parts, "flows", ("kind",))


def word_counts(told: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words."""
    return told.where("kind = 'word'").select("lang", F.col("pair").alias("word"), F.col("total").alias("f"))


def edges(told: DataFrame) -> DataFrame:
    """``edge, lang, pair, next_pair, third, weight, flow, next_flow``: frequent edges with the counts of both their nodes."""
    nodes = told.where("kind = 'node'").select("lang", "pair", F.col("total").alias("flow"))
    rows = told.where("kind = 'edge'").select(
        "lang", "pair", "third", F.col("total").alias("weight"),
        F.concat_ws(" ", F.substring_index("pair", " ", -1), "third").alias("next_pair"))
    return stage(
        rows.join(nodes, ["lang", "pair"])
        .join(nodes.withColumnsRenamed({"pair": "next_pair", "flow": "next_flow"}), ["lang", "next_pair"])
        .select(F.monotonically_increasing_id().alias("edge"), "lang", "pair", "next_pair", "third", "weight", "flow", "next_flow"), "edges")


def paths(found: DataFrame) -> DataFrame:
    """``lang, path, block, weight, words, flow, next_flow``: unary paths of ``edges``, in blocks of ``BLOCK`` edges.

    ``words`` of a block holds its edges as runs of three; ``flow`` is the count of its first node, ``next_flow`` of its last.
    """
    into = found.where("weight = next_flow").select("lang", F.col("next_pair").alias("node"), F.col("edge").alias("before"))
    out = found.where("weight = flow").select("lang", F.col("pair").alias("node"), "edge")
    links = stage(into.join(out, ["lang", "node"]).select(
        "edge", F.col("before").alias("at"), F.lit(1).cast("long").alias("far"), F.lit(False).alias("ended")), "links")
    # an edge has one edge before it at most, so the pointers of a round differ; they reach back twice as far in the next
    while not links.where("not ended").isEmpty():
        known = links.select(F.col("edge").alias("at"), F.col("at").alias("on"), F.col("far").alias("more"), F.col("ended").alias("on_ended"))
        moved = links.where("not ended").join(known, "at", "left").select(
            "edge", F.coalesce("on", "at").alias("at"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
            F.coalesce("on_ended", F.lit(True)).alias("ended"))
        links = stage(links.where("ended").unionByName(moved), "links")
    placed = found.join(links.select("edge", F.col("at").alias("path"), "far"), "edge", "left").select(
        F.coalesce("path", "edge").alias("path"), F.coalesce("far", F.lit(0)).alias("far"), "lang", "pair", "third", "weight", "flow", "next_flow")
    steps = F.sort_array(F.collect_list(F.struct("far", "pair", "third", "flow", "next_flow")))
    return stage(
        placed.groupBy("lang", "path", F.floor(F.col("far") / BLOCK).alias("block"), "weight").agg(steps.alias("steps"))
        .select("lang", "path", "block", "weight", F.concat(F.split(F.col("steps")[0]["pair"], " "), F.col("steps.third")).alias("words"),
                F.col("steps")[0]["flow"].alias("flow"), F.element_at("steps", -1)["next_flow"].alias("next_flow")), "paths")


def candidates(told: DataFrame, cover: int = COVER) -> DataFrame:
    """``lang, phrase, first, last, a, left_flow, right_flow``: phrases that no longer candidate covers.

    The flows of a phrase of three words are the counts of its first two and its last two words; a phrase of two has none.
    """
    found = edges(told)
    # only the ends of a path need counts of their own, inside it every pair weighs as much as the path
    places = paths(found).select(
        "*", F.expr("size(words) - 2").alias("n"), F.posexplode(F.expr("transform(sequence(1, size(words) - 2), i -> slice(words, i, 3))")).alias("i", "w"))
    triples = places.select(
        "lang", F.concat_ws(" ", "w").alias("phrase"), F.col("w")[0].alias("first"), F.col("w")[2].alias("last"), F.col("weight").alias("a"),
        F.when(F.col("i") == 0, F.col("flow")).otherwise(F.col("weight")).alias("left_flow"),
        F.when(F.col("i") == F.col("n") - 1, F.col("next_flow")).otherwise(F.col("weight")).alias("right_flow"))
    covered = (
        found.where(F.col("weight") * 100 >= F.col("flow") * cover).select("lang", "pair")
        .unionByName(found.where(F.col("weight") * 100 >= F.col("next_flow") * cover).select("lang", F.col("next_pair").alias("pair"))).distinct()
    )
    none = F.lit(None).cast("long")
    pairs = told.where("kind = 'node'").join(covered, ["lang", "pair"], "left_anti").select(
        "lang", F.col("pair").alias("phrase"), F.substring_index("pair", " ", 1).alias("first"),
        F.substring_index("pair", " ", -1).alias("last"), F.col("total").alias("a"), none.alias("left_flow"), none.alias("right_flow"))
    return triples.unionByName(pairs)


def scored(told: DataFrame, least: int = LEAST, cover: int = COVER) -> DataFrame:
    """``lang, phrase, a, l, r, n, score``: candidates with the counts of the cut that scores lowest."""
    words = stage(word_counts(told), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # a word that opens or ends very many phrases is looked up in shares; those of a frequent phrase are frequent
    shares = words.where(F.col("f") >= least).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda column: F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")
    rows = (
        candidates(told, cover).withColumn("salt", salt("last"))
        .join(shares.select("lang", F.col("word").alias("first"), "salt", F.col("f").alias("f_first")), ["lang", "first", "salt"])
        .withColumn("salt", salt("first"))
        .join(shares.select("lang", F.col("word").alias("last"), "salt", F.col("f").alias("f_last")), ["lang", "last", "salt"])
    )
    wide = lambda c: c.cast("decimal(15,0)")

    def cut(k: int, left, right):
        score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(F.col("a")) * wide(F.col("a"))), wide(left) * wide(right))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    two = cut(1, F.col("f_first"), F.col("f_last"))
    three = F.least(cut(1, F.col("f_first"), F.col("right_flow")), cut(2, F.col("left_flow"), F.col("f_last")))
    return (
        rows.withColumn("cut", F.when(F.isnull("left_flow"), two).otherwise(three))
        .join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language."""
    rows = scored(flows(docs, least), least, cover)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
