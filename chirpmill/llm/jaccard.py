"""N-gram Jaccard join with signature trees: all texts whose shingle sets overlap by ``SHARE`` are linked, exactly.

A text's set holds the 64-bit hashes of its 5-word shingles; equal sets are one class from the start. A set of n shingles
that is similar enough to another misses at most n / 4 of them there. So, in any order that all sets share, the first
n / 4 + 1 shingles of two similar sets have one in common. The order used puts rare shingles first, by how many
sets hold them. That is done twice: counted over all texts for the lowest ``SAMPLE`` of the hashes (and read off nowhere
else), which leaves the sets that may be similar to any other, and then over all shingles of these.
Sets that share one of these first shingles form a block, and blocks with equal members are one. Two sets whose first shared
shingle stands behind others in their lists cannot share those, which bounds the size that a partner can have (``most``).

In each block a signature tree is walked. A member's signature is a bitmap of its shingles with its size; inner nodes
hold the OR of the bitmaps below them, the range of sizes and the largest ``most``. Node pairs are kept only while the
largest possible overlap (common bits, and the most shingles that can hide behind shared bits) reaches what their least sizes
demand, and while they hold members of different components. Members of a pair of leaves are compared by the same tests in
one row. First, though, every member is compared with the block's
centre, the member that shares most: copies of one original are tied together by that, so the walk afterwards only
has what lies apart, and a block of any size costs a row a member. Pairs that remain are verified on the whole sets.

Edge cases: null, empty and wordless texts have no shingles, link with nothing and are their own component; with fewer
than five words the whole sequence is the one shingle; ids may repeat (the rows of an id are one document for
components); null ids stay null; empty tables give no rows. Only the two named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirpmill.session import checked_small, stage

from .components import components
from .wordhash import SPACED, grams, mix, pieces, words

SHINGLE = 5
#: Linked if ``SHARE[1] * common >= SHARE[0] * union``.
SHARE = (75, 100)
SAMPLE = 0.34
LEAF, FAN = 32, 8
#: Sets that may share a 64-bit digest with another set.
MOST_CLASHES = 10_000
#: 64-bit words of a signature.
CELLS = 32

_LIMIT = np.uint64(int(SAMPLE * 2**64))
_OTHER = np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text and shingle, ordered by both and each once, and the size of each text's set."""
    w = words(data, offsets, SPACED)
    count = np.bincount(w.text, minlength=len(offsets) - 1)
    g = grams(w.hash, SHINGLE)
    whole = w.text[:len(g)] == w.text[SHINGLE - 1:SHINGLE - 1 + len(g)]
    text, token = [w.text[:len(g)][whole]], [g[whole]]
    begin = np.cumsum(count) - count
    for k in range(1, SHINGLE):
        few = np.flatnonzero(count == k)
        if len(few):
            text.append(few)
            token.append(grams(w.hash, k, salt=k)[begin[few]])
    text, token = np.concatenate(text), np.concatenate(token)
    order = np.lexsort((token, text))
    text, token = text[order], token[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (token[1:] != token[:-1])
    text, token = text[fresh], token[fresh]
    return text, token, np.bincount(text, minlength=len(offsets) - 1)


def _digests(text: np.ndarray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    out = []
    for value in (mix(token), mix(token ^ _OTHER)):
        upto = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(value, out=upto[1:])
        end = np.cumsum(size)
        out.append(mix(upto[end] - upto[end - size] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def needed(n):
    """How many shingles, first in the common order, must hold one of any similar set."""
    return n // 4 + 1


def _sent(text: np.ndarray, token: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of each set are sent, and how many: the sampled ones, and the first ``needed`` if those are fewer."""
    low = np.bincount(text[token < _LIMIT], minlength=len(size))
    sent = np.where(size > 0, np.maximum(low, needed(size)), 0)
    place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
    return place < sent[text], np.where(sent > low, -sent, sent)


def _shortened(digest: np.ndarray, bits: int) -> np.ndarray:
    return digest if bits == 64 else digest & np.int64((1 << bits) - 1)


def _set_rows(bits: int):
    def run(batches):
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                text, token, size = shingle_sets(data, offsets)
                one, two = _digests(text, token, size)
                _, sent = _sent(text, token, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(size)), pa.array(_shortened(one, bits)), pa.array(two), pa.array(size), pa.array(sent)],
                    names=["doc_id", "sid", "second", "n", "sent"])
    return run


def _sent_rows(bits: int, renamed: np.ndarray):
    def run(batches):
        known: set[int] = set()
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                text, token, size = shingle_sets(data, offsets)
                one, two = _digests(text, token, size)
                one = _shortened(one, bits)
                if len(renamed):
                    one = np.where(np.isin(two, renamed), two, one)
                use, _ = _sent(text, token, size)
                # a copy inside a task adds nothing; copies in other tasks are told by their digest
                new = np.zeros(len(size), bool)
                for i, s in enumerate(one.tolist()):
                    if size[i] and s not in known:
                        new[i] = True
                        known.add(s)
                if len(known) > 1 << 18:
                    known.clear()
                use &= new[text]
                yield pa.RecordBatch.from_arrays([pa.array(token[use].view(np.int64)), pa.array(one[text[use]])], names=["token", "sid"])
    return run


def _whole_rows(batches):
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1)):
            text, token, size = shingle_sets(data, offsets)
            end = np.cumsum(size)
            for i, (a, b) in enumerate(zip(end - size, end)):
                bits = np.zeros(CELLS * 64, bool)
                bits[token[a:b] % np.uint64(CELLS * 64)] = True
                cells = np.packbits(bits, bitorder="little").view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first + i, 1), pa.array([int(b - a)]),
                     pa.ListArray.from_arrays(pa.array([0, CELLS], pa.int32()), pa.array(cells)),
                     pa.array([int(b - a - bits.sum())]), pa.array([token[a:b].tobytes()], pa.binary())],
                    names=["sid", "n", "bits", "hidden", "tokens"])


def _shared_digests(made: DataFrame) -> DataFrame:
    """``sid`` of several different sets."""
    return made.groupBy("sid").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select("sid")


def sets(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """``doc_id, sid, second, n, sent`` of every row: digests and size of its set.

    Different sets that share the first digest are named by the second instead: a few, as chance has it, in 10^10 sets.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    made = stage(source.mapInArrow(_set_rows(bits), f"doc_id {kind}, sid bigint, second bigint, n bigint, sent bigint"), "shingle-sets")
    shared = [r[0] for r in checked_small(_shared_digests(made), MOST_CLASHES, "sets with the digest of another set").collect()]
    if not shared:
        return made
    made = made.withColumn("sid", F.when(F.col("sid").isin(shared), F.col("second")).otherwise(F.col("sid")))
    if clash := _shared_digests(made).head():
        raise ValueError(f"different sets have the digest {clash['sid']}")
    return made


def _first_shingles(sent: DataFrame, sizes: DataFrame) -> DataFrame:
    """``sid, n, sent, shared, alone, list``: the first shingles of each set in the common order, those that no other set has left out.

    ``sent`` is ``token, sid`` in one shuffle by ``token``, ``sizes`` is ``sid, n, sent``; ``alone`` counts what is left out.
    """
    held = sent.groupBy("token").agg(
        F.min("sid").alias("low"), F.max("sid").alias("high"), F.count("*").alias("df")).where("low <> high").select("token", "df")
    common = sent.join(held, "token")
    lists = common.groupBy("sid").agg(F.collect_set(F.struct("df", "token")).alias("list"))
    # shingles that no other set has come first in the order, so they use up places
    places = F.when(F.col("sent") < 0, F.size("list")).otherwise(
        F.expr("n div 4 + 1") - (F.col("sent") - F.size("list")))
    return (
        lists.join(sizes, "sid").withColumn("places", places.cast("int")).where("places > 0")
        .select("sid", "n", "sent", (F.size("list") / F.abs("sent")).alias("shared"), (F.col("sent") - F.size("list")).alias("alone"),
                F.slice(F.sort_array("list"), F.lit(1), F.greatest("places", F.lit(0))).alias("list"))
    )


def _by_token(rows: DataFrame) -> DataFrame:
    """The rows in one shuffle: the joins that follow ask for this filter, so given here it is not made twice."""
    return rows.where("token is not null and sid is not null").repartition("token")


def asked(docs: DataFrame, made: DataFrame, text_col: str, bits: int = 64) -> DataFrame:
    """``sid`` of sets that share one of their first shingles with another, as far as the sampled shingles tell."""
    # those of ``sets`` that go by their second digest, at most as many as it allows
    renamed = np.array([r[0] for r in made.where("sid = second").select("second").distinct().collect()], np.int64)
    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(_sent_rows(bits, renamed), "token bigint, sid bigint")
    sizes = made.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("sent").alias("sent"))
    members = stage(_first_shingles(_by_token(sent), sizes).select("sid", F.explode("list.token").alias("token")), "first-shingles")
    met = members.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("token")
    return stage(members.join(met, "token", "left_semi").select("sid").distinct(), "sets-asked")


def _token_rows(batches):
    for batch in batches:
        held, size = [], 0
        for i, (sid, tokens) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
            held.append((sid, np.frombuffer(tokens.as_buffer(), np.int64)))
            size += len(held[-1][1])
            if size >= 1 << 18 or i + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([t for _, t in held])), pa.array(np.repeat([s for s, _ in held], [len(t) for _, t in held]))],
                    names=["token", "sid"])
                held, size = [], 0


def whole_sets(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """``sid, n, bits, hidden, tokens`` of the sets that may be similar to another, from one text of each."""
    source = made.join(asked(docs, made, text_col, bits), "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("of"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stage(
        texts.join(stage(source, "set-sources").hint("merge"), F.expr("doc_id <=> of")).select("sid", "text")
        .mapInArrow(_whole_rows, "sid bigint, n bigint, bits array<bigint>, hidden bigint, tokens binary"), "whole-sets")


def blocks(docs: DataFrame, made: DataFrame, text_col: str, bits: int = 64, id_col: str = "doc_id", whole: DataFrame | None = None) -> DataFrame:
    """``block, sid, n, shared, most``: sets that share one of their first shingles; blocks with equal members are one.

    All shingles of the ``whole`` sets that were asked for are counted. What stands before the shared shingle in a set's list is not in the other set, so
    that one has ``most`` shingles at most if it is similar enough and the two do not meet in an earlier block.
    """
    if whole is None:
        whole = whole_sets(docs, made, id_col, text_col, bits)
    sent = whole.select("sid", "tokens").mapInArrow(_token_rows, "token bigint, sid bigint")
    first = stage(_first_shingles(_by_token(sent), whole.select("sid", "n", F.col("n").alias("sent"))), "first-shingles")
    members = first.select("sid", "n", "shared", "alone", F.posexplode("list").alias("place", "x")).select(
        "sid", "n", "shared", "x.df", "x.token", most_of(F.col("n"), F.col("alone") + F.col("place")).alias("most"))
    prints = members.groupBy("token").agg(
        F.first("df").alias("df"),
        F.count("*").alias("many"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("p1"),
        F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("p2")).where("many > 1")
    # of blocks with equal members the first in the common order, where ``most`` is largest
    kept = prints.groupBy("many", "p1", "p2").agg(F.min(F.struct("df", "token")).alias("x")).select("x.token")
    return stage(members.drop("df").join(kept, "token").withColumnRenamed("token", "block"), "blocks")


def most_of(n: Column, before: Column) -> Column:
    """The most shingles of a similar set, for a set of ``n`` that holds ``before`` of them that are not in the other."""
    low, full = SHARE
    return F.call_function("div", (n - before) * (low + full) - n * low, F.lit(low).cast("bigint"))


def may_overlap(common: Column, hidden: Column, least_a: Column, least_b: Column) -> Column:
    """Whether so many common bits, and shingles hidden behind others' bits, allow for the overlap that is asked."""
    low, full = SHARE
    return (common + hidden) * (low + full) >= (least_a + least_b) * low


def common_bits(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x & y)), 0, (s, v) -> s + v)")


def sizes_fit(low_a, high_a, low_b, high_b) -> Column:
    low, full = SHARE
    return (F.col(high_a) * full >= F.col(low_b) * low) & (F.col(high_b) * full >= F.col(low_a) * low)


def _verified(batches):
    low, full = SHARE
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(full * common >= low * (len(x) + len(y) - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def likely(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that their signatures allow to be similar enough."""
    sign = lambda name: whole.select(*[F.col(c).alias(c if c == name else f"{c}_{name}") for c in ("n", "bits", "hidden")], F.col("sid").alias(name))
    return stage(
        pairs.distinct().join(sign("a"), "a").join(sign("b"), "b")
        .where(sizes_fit("n_a", "n_a", "n_b", "n_b"))
        .where(may_overlap(common_bits("bits_a", "bits_b"), F.least("hidden_a", "hidden_b"), F.col("n_a"), F.col("n_b")))
        .select("a", "b"), "likely-pairs")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` that are similar enough by their whole sets."""
    return stage(
        pairs.join(whole.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
        .join(whole.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint"), "similar-pairs")


def _leaf_side(leaves: pa.Array, row: int) -> tuple[np.ndarray, ...]:
    leaf = leaves[row].values
    cells = leaf.field("bits").flatten().to_numpy().reshape(-1, CELLS).view(np.uint64)
    return *[leaf.field(c).to_numpy() for c in ("sid", "component", "n", "most", "hidden")], cells


def _leaf_pairs(batches):
    """Pairs of members of two leaves that sizes, components, what stands before the shared shingle and signatures allow."""
    low, full = SHARE
    for batch in batches:
        first, second = [], []
        for row in range(batch.num_rows):
            a, kin_a, n_a, most_a, hidden_a, bits_a = _leaf_side(batch.column(0), row)
            b, kin_b, n_b, most_b, hidden_b, bits_b = _leaf_side(batch.column(1), row)
            fit = (kin_a[:, None] != kin_b) & (n_a[:, None] <= most_b) & (n_b <= most_a[:, None])
            fit &= (n_a[:, None] * full >= n_b * low) & (n_b * full >= n_a[:, None] * low)
            i, j = np.nonzero(fit)
            common = np.zeros(len(i), np.int64)
            for k in range(CELLS):
                common += np.bitwise_count(bits_a[i, k] & bits_b[j, k])
            near = (common + np.minimum(hidden_a[i], hidden_b[j])) * (low + full) >= (n_a[i] + n_b[j]) * low
            first.append(np.minimum(a[i[near]], b[j[near]]))
            second.append(np.maximum(a[i[near]], b[j[near]]))
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["a", "b"])


def tree_pairs(members: DataFrame, whole: DataFrame) -> DataFrame:
    """``a, b``: members of one block and different components that a walk of the block's tree cannot rule out.

    ``members`` is ``block, sid, component`` and, where it is known, the ``most`` shingles of a partner. A block of more
    than a leaf has leaves of members of similar size and ``most``, and of one component where that has enough of them.
    """
    if "most" not in members.columns:
        members = members.withColumn("most", F.lit(2**62))
    members = members.select("block", "sid", "component", "most")
    per = members.groupBy("block", "component").agg(F.count("*").alias("many"))
    held = members.groupBy("block").agg(F.count("*").alias("held"))
    band = lambda value: F.floor(F.log(value) / F.log(F.lit(SHARE[1] / SHARE[0]))).cast("int")
    rows = (
        members.join(per, ["block", "component"]).join(held, "block").join(whole.select("sid", "n", "bits", "hidden"), "sid")
        .withColumn("bush", F.when(F.col("held") > LEAF, F.xxhash64(
            band("n"), F.when(F.col("many") >= LEAF, F.col("component")),
            # finer, as a large block of copies of one text has one size
            F.floor(F.least(F.col("most") / F.col("n"), F.lit(2)) * 16))).otherwise(0))
    )
    counts = rows.groupBy("block", "bush").agg(F.count("*").alias("size"))
    rows = stage(
        rows.join(counts, ["block", "bush"])
        .withColumn("cell", F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / LEAF)))
        .select("block", "bush", "cell", "sid", "component", "n", "most", "bits", "hidden"), "tree-members")
    nodes = rows.groupBy("block", "bush", "cell").agg(
        F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(CELLS)]).alias("bits"), F.max("hidden").alias("hidden"),
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("most"), F.min("component").alias("kin_low"), F.max("component").alias("kin_high"))
    levels = [stage(nodes, "tree-nodes")]
    while levels[-1].where("cell > 0").head() is not None:
        below = levels[-1].withColumn("cell", F.floor(F.col("cell") / FAN))
        levels.append(stage(below.groupBy("block", "bush", "cell").agg(
            F.array(*[F.bit_or(F.get("bits", F.lit(i))) for i in range(CELLS)]).alias("bits"), F.max("hidden").alias("hidden"),
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("most").alias("most"),
            F.min("kin_low").alias("kin_low"), F.max("kin_high").alias("kin_high")), "tree-nodes"))

    def side(level: DataFrame, name: str, up: bool) -> DataFrame:
        parent = [F.floor(F.col("cell") / FAN).alias(f"up_{name}")] if up else []
        return level.select("block", *parent, *[F.col(c).alias(f"{c}_{name}") for c in (
            "bush", "cell", "bits", "hidden", "low", "high", "most", "kin_low", "kin_high")])

    def hopeful(pairs: DataFrame) -> DataFrame:
        return (
            pairs.where((F.col("bush_a") < F.col("bush_b")) | ((F.col("bush_a") == F.col("bush_b")) & (F.col("cell_a") <= F.col("cell_b"))))
            .where("not (kin_low_a = kin_high_a and kin_low_b = kin_high_b and kin_low_a = kin_low_b)")
            .where(sizes_fit("low_a", "high_a", "low_b", "high_b") & (F.col("low_a") <= F.col("most_b")) & (F.col("low_b") <= F.col("most_a")))
            .where(may_overlap(common_bits("bits_a", "bits_b"), F.least("hidden_a", "hidden_b"), F.col("low_a"), F.col("low_b")))
            .select("block", "bush_a", "cell_a", "bush_b", "cell_b")
        )

    top = levels[-1]
    pairs = stage(hopeful(side(top, "a", False).join(side(top, "b", False), "block")), "tree-pairs")
    for level in levels[-2::-1]:
        upper = pairs.withColumnRenamed("cell_a", "up_a").withColumnRenamed("cell_b", "up_b")
        pairs = stage(hopeful(
            upper.join(side(level, "a", True), ["block", "bush_a", "up_a"]).join(side(level, "b", True), ["block", "bush_b", "up_b"])), "tree-pairs")
    # a row for a leaf, so that a row for a pair of leaves stands for all pairs of their members
    leaves = rows.groupBy("block", "bush", "cell").agg(F.collect_list(F.struct("sid", "component", "n", "most", "hidden", "bits")).alias("leaf"))
    leaf = lambda name: leaves.select("block", *[F.col(c).alias(f"{c}_{name}") for c in ("bush", "cell", "leaf")])
    return (
        pairs.join(leaf("a"), ["block", "bush_a", "cell_a"]).join(leaf("b"), ["block", "bush_b", "cell_b"])
        .select("leaf_a", "leaf_b").mapInArrow(_leaf_pairs, "a bigint, b bigint").distinct()
    )


def links(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """``a, b``: similar sets, as many pairs as it takes to tie together what belongs together."""
    whole = whole_sets(docs, made, id_col, text_col, bits)
    member = blocks(docs, made, text_col, bits, id_col, whole)
    centre = member.groupBy("block").agg(F.max(F.struct("shared", "sid", "n")).alias("c")).select(
        "block", F.col("c.sid").alias("centre"), F.col("c.n").alias("centre_n"))
    around = stage(member.join(centre, "block").where("sid <> centre"), "around")
    beside = around.where(sizes_fit("n", "n", "centre_n", "centre_n")).select(
        F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b"))
    found = verified(likely(beside, whole), whole)
    known = components(found)
    labelled = around.select("block", "sid", "most").join(known.withColumnRenamed("node", "sid"), "sid", "left").select(
        "block", "sid", "most", F.coalesce("component", "sid").alias("component"))
    open_blocks = labelled.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rest = stage(labelled.join(open_blocks.select("block"), "block", "left_semi"), "open-members")
    return found.unionByName(verified(tree_pairs(rest, whole), whole))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component is the least id that links lead to.

    ``bits`` of the first digest are used, and the second where that is not enough to tell sets apart.
    """
    made = sets(docs, id_col, text_col, bits)
    label = components(links(docs, made, id_col, text_col, bits))
    named = made.join(label.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("group"))
    named = stage(named, "set-components")
    least = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    return named.join(least, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
