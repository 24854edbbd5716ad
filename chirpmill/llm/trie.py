"""A prefix trie over conversations, with subtree totals by bands of depths.

Conversations are first rebuilt: a conversation opens with the first turns of the one at the start of its block of
``BLOCK`` ids (how many follows from the crc32 of its id), then goes on with its own turns after as many. A node is a
distinct sequence of leading turns. It is named by its depth and two 64-bit numbers, each the exclusive or of hashes of
(place, md5 of role and text) over its turns, so that a name is a running total and a very long conversation can be
numbered and named in pieces.

Subtree totals (childless nodes, saved words) would need a row for each pair of a node and an ancestor, or a round for
each depth. Depths are cut into bands of fixed height instead: every node adds its own values to its ancestors within its
band, at most ``height`` rows a node. That completes the totals of the lowest bands; then, from the lowest band up, each
band's roots add the totals of the roots below them (one round a band, over band roots only), and in the end each band
root adds its total to the nodes above it in the band above. The height is the square root of the depth, ``LEAST_HEIGHT``
at least, so both the rounds and the rows a node follow that root.

No task takes a whole conversation or node: turns are numbered over sorted ranges, node counts have partial sums, children
find their parent over ``SALTS`` shares, and the ids that end at a node are joined in blocks of ``ENDS`` and read as one
stream by their digest. Joins within a band are by (conversation, band). Intermediate tables are written.

Edge cases: rows with a null id belong to no conversation; a null turn comes first; null roles and texts are empty; turns
of one number are ordered by the md5 of role and text, repeated rows are turns too; an empty table has no node, not even a
root. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpmill.session import stage

BLOCK = 20
MOST_SHARED = 4
LEAST_HEIGHT = 8
SALTS = 16
#: Ids that end at one node are joined in blocks of 2 ** ENDS.
ENDS = 12

NODE = ["depth", "hi", "lo"]


def _named(*columns: str, prefix: str) -> list[Column]:
    return [F.col(c).alias(prefix + c) for c in columns]


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, part, seq, digest, words``: turns in order; ``seq`` grows with it inside each written range ``part``.

    A conversation of any length is spread over as many ranges as it fills.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest"]
    return stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("seq"))
        .withColumn("part", F.shiftright("seq", 33)), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, n_turns`` of the rebuilt conversations, and their turns ``conv_id, depth, digest, words``."""
    rows = numbered(turns)
    parts = rows.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    sizes = parts.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("base", F.expr(f"conv_id - conv_id % {BLOCK}"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = stage(
        sizes.join(bases, "base", "left")
        .withColumn("shared", F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED)
        .withColumn("used", F.least("shared", F.coalesce("n_base", F.lit(0))))
        .withColumn("n_turns", F.expr("used + greatest(n_own - shared, 0)")), "conversations")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(
        parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(convs.select("conv_id", "shared", "used"), "conv_id"), ["conv_id", "part"]
    ).withColumn("place", F.expr("offset + seq - first + 1"))
    heads = placed.where(f"place < {MOST_SHARED} and conv_id % {BLOCK} = 0").select(
        F.col("conv_id").alias("base"), "place", "digest", "words")
    opened = convs.where("used > 0").select("conv_id", "base", "shared").join(heads, "base").where("place <= shared")
    columns = ["conv_id", "depth", "digest", "words"]
    return convs.select("conv_id", "n_turns"), (
        opened.withColumn("depth", F.col("place")).select(columns)
        .unionByName(placed.where("place > shared").withColumn("depth", F.expr("place - shared + used")).select(columns)))


def _band(depth: str, height: int) -> Column:
    return F.floor(F.col(depth) / height)


def prefixes(turns: DataFrame, height: int) -> DataFrame:
    """``conv_id, depth, band, hi, lo, up_hi, up_lo, words``: the node at each turn, and the name of the one above it."""
    rows = turns.select(
        "conv_id", "depth", "words", _band("depth", height).alias("band"),
        F.xxhash64(F.lit("hi"), "depth", "digest").alias("h"), F.xxhash64(F.lit("lo"), "digest", "depth").alias("l"))
    bands = rows.groupBy("conv_id", "band").agg(F.bit_xor("h").alias("h"), F.bit_xor("l").alias("l"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = bands.select("conv_id", "band", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "hl"))
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.join(carried, ["conv_id", "band"]).select(
        "conv_id", "depth", "band", "words", "h", "l",
        F.bit_xor("h").over(inside).bitwiseXOR(F.col("h_before")).alias("hi"),
        F.bit_xor("l").over(inside).bitwiseXOR(F.col("l_before")).alias("lo"))
    return named.select("conv_id", "depth", "band", "words", "hi", "lo",
                        F.col("hi").bitwiseXOR(F.col("h")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("l")).alias("up_lo"))


def _ends_rows(batches):
    """One digest for each node from its blocks of ids, which come one after another."""
    node, digest = None, None
    out: list[tuple] = []

    def drained():
        found = pa.Table.from_pylist([dict(zip((*NODE, "ends_sha256"), r)) for r in out], pa.schema(
            [("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())]))
        out.clear()
        return found.to_batches()

    for batch in batches:
        for depth, hi, lo, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (depth, hi, lo) != node:
                if digest:
                    out.append((*node, digest.hexdigest()))
                node, digest = (depth, hi, lo), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield from drained()
    if digest:
        out.append((*node, digest.hexdigest()))
        yield from drained()


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, hi, lo, ends_sha256`` of the nodes at which a conversation ends."""
    blocks = ends.groupBy(*NODE, F.shiftright("conv_id", ENDS).alias("block")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))
    return (
        blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
        .mapInArrow(_ends_rows, "depth long, hi long, lo long, ends_sha256 string"))


def _band_root_totals(roots: DataFrame, last: int) -> DataFrame | None:
    """Completed totals of the roots of bands 1 to ``last``, each the sum of its own band and of the roots below it."""
    done = below = None
    for band in range(last, 0, -1):
        now = roots.where(F.col("band") == band)
        if below is not None:
            from_below = below.groupBy(F.col("root_hi").alias("hi"), F.col("root_lo").alias("lo")).agg(
                F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
            now = now.join(from_below, ["hi", "lo"], "left").select(
                "conv_id", "band", *NODE, "root_hi", "root_lo",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        below = stage(now, f"band-{band}")
        done = below if done is None else done.unionByName(below)
    return done


def nodes(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations."""
    convs, told = rebuilt(turns)
    told = stage(told, "rebuilt")
    deepest = told.agg(F.max("depth")).first()[0] or 0
    height = max(LEAST_HEIGHT, math.isqrt(deepest) + 1)
    rows = stage(prefixes(told, height), "prefixes")

    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in (*NODE, "up_hi", "up_lo")), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    below = rows.groupBy(*NODE).agg(
        F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.max("words").alias("words"))
    found = stage(below.unionByName(top.select(below.columns)), "nodes")

    # children look their parent up, a share of them at a time
    salted = found.where("depth > 0").withColumn("salt", F.pmod(F.col("hi"), F.lit(SALTS)))
    above = [(F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")]
    shares = stage(salted.groupBy(*above, "salt").agg(F.count("*").alias("n")), "shares")
    children = shares.groupBy(*NODE).agg(F.sum("n").alias("n_children"))
    parents = shares.join(found.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE).select(
        (F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), "salt", "parent_conv_id")
    own = stage(
        found.withColumn("salt", F.when(F.col("depth") > 0, F.pmod(F.col("hi"), F.lit(SALTS))))
        .join(parents, ["depth", "up_hi", "up_lo", "salt"], "left").join(children, NODE, "left")
        .select(*NODE, "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                _band("depth", height).alias("band"), F.isnull("n_children").cast("long").alias("leaf"),
                ((F.col("n_convs") - 1) * F.col("words")).alias("words_saved")), "own")

    # every node to itself and its ancestors in its band; the root of all is above all of band 0
    path = rows.select("conv_id", "band", *_named(*NODE, prefix="a_"))
    inside = (
        own.where("depth > 0").join(path, ["conv_id", "band"]).where("a_depth <= depth")
        .groupBy(*(F.col(f"a_{c}").alias(c) for c in NODE)).agg(F.sum("leaf").alias("leaves"), F.sum("words_saved").alias("saved"))
    )
    whole = own.where("band = 0").agg(F.sum("leaf").alias("leaves"), F.sum("words_saved").alias("saved")).where("leaves is not null")
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    inside = stage(inside.unionByName(whole.select(*zero, "leaves", "saved")), "in-band")

    # band roots know the root of the band above from the path of their first conversation
    starts = path.where(F.col("a_depth") == F.col("band") * height).select(
        "conv_id", (F.col("band") + 1).alias("band"), F.col("a_hi").alias("root_hi"), F.col("a_lo").alias("root_lo"))
    roots = stage(
        own.where(f"band > 0 and depth = band * {height}").select("conv_id", "band", *NODE)
        .join(inside, NODE).join(starts, ["conv_id", "band"], "left")
        .select("conv_id", "band", *NODE, F.coalesce("root_hi", F.lit(0)).alias("root_hi"), F.coalesce("root_lo", F.lit(0)).alias("root_lo"),
                "leaves", "saved"), "band-roots")
    totals = _band_root_totals(roots, deepest // height)
    if totals is None:
        more = inside.limit(0)
    else:
        totals = totals.select("conv_id", (F.col("band") - 1).alias("band"), "leaves", "saved")
        to_top = totals.where("band = 0").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).where("leaves is not null")
        more = (
            totals.join(path, ["conv_id", "band"])
            .groupBy(*(F.col(f"a_{c}").alias(c) for c in NODE)).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            .unionByName(to_top.select(*zero, "leaves", "saved")))
    subtree = inside.unionByName(more).groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    last = convs.select("conv_id", F.col("n_turns").alias("depth"))
    ended = rows.join(last, ["conv_id", "depth"]).select(*NODE, "conv_id").unionByName(
        last.where("depth = 0").select(*zero, "conv_id"))
    return (
        own.join(subtree, NODE).join(_ends(ended), NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
