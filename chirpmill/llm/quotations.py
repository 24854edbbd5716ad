"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that begin with ``>`` marks are quotes; the number of marks is the level. Neighbouring lines of one level make a
passage. Passages and messages are normalised (lower case, runs of white space as one blank) and hashed; a passage
is joined to the first message of its conversation whose own words are that passage, or hold it as one of their lines
or paragraphs, or as lines that follow each other (blank lines aside). A message answers the message that its least nested linked quote comes from (the longest such passage,
then the earliest message, if there are several). Threads are the trees of answers, found by pointer jumping;
conversations are ordered by thread and turn, so an answer never stands before what it answers, and quotes and the
lines that announce them (``... wrote:``) are taken out. A line that announces a deeper quote inside a quote is taken
out of that passage too, as its writer did not say it in their own words.

A conversation may hold any number of rows: no window or list ever gathers one. Places come from a sort over all
messages in ranges and the counts of the ranges.

Edge cases: null texts are empty; rows with a null conversation or turn are kept as threads of their own and link to
nothing; rows that repeat a turn share its links; a quote of nothing in the conversation, or of a later turn, stays
unlinked and is still taken out; blank quotes are not passages. Empty tables give no rows. Only the four named
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirpmill.session import stage

QUOTED = r"^[ \t]*>[> \t]*"
ANNOUNCED = r"^.*\b(wrote|writes|said|schrieb|escribió|a écrit)[ \t]*:[ \t]*$"


def normal(text: Column) -> Column:
    """What two passages must share to be the same."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _key(text: Column) -> Column:
    return F.md5(text)


def line_keys(text: Column) -> Column:
    """Hashes of the normalised lines of a text, without blank ones."""
    return F.transform(F.filter(F.transform(F.split(text, "\n", -1), normal), lambda x: x != ""), lambda x: F.xxhash64(x))


def power(n: str) -> str:
    """The largest k with ``2 ** k <= n``."""
    return f"length(bin({n})) - 1"


def doubled(keys: str, k: str) -> str:
    """Hashes of all runs of ``2 ** k`` lines (k from 1), by hashing neighbouring runs of half that many k times over."""
    half = "shiftleft(1, j - 1)"
    return (f"aggregate(sequence(1, {k}), {keys}, (a, j) -> transform(slice(a, 1, size(a) - {half}), (x, i) -> xxhash64(x, a[i + {half}])))")


def _run_key(n: Column, first: Column, last: Column) -> Column:
    """What two runs of lines must share: their number and the hashes of the longest runs of ``2 ** k`` lines at both ends.

    Never what ``_key`` gives for a text of one passage.
    """
    return _key(F.concat_ws("\n", F.lit(""), n.cast("string"), first.cast("string"), last.cast("string")))


def parsed(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``row, conv_id, turn, role, runs``: the text of each message as runs of lines of one quote level (0: its own)."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n", -1)
    levels = F.transform("lines", lambda line: F.regexp_count(F.regexp_extract(line, QUOTED, 0), F.lit(">")))
    bodies = F.transform("lines", lambda line: F.regexp_replace(line, QUOTED, ""))
    begins = F.expr("filter(sequence(1, size(levels)), i -> i = 1 or levels[i - 1] <> levels[i - 2])")
    runs = F.expr(
        "transform(begins, (b, k) -> struct(levels[b - 1] as level,"
        " array_join(slice(bodies, b, coalesce(get(begins, k + 1), size(levels) + 1) - b), '\n') as body))")
    return (
        messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), lines.alias("lines"))
        .select("conv_id", "turn", "role", levels.alias("levels"), bodies.alias("bodies"))
        .select("conv_id", "turn", "role", "levels", "bodies", begins.alias("begins"))
        .select("conv_id", "turn", "role", runs.alias("runs"))
        .select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", unannounced(F.col("runs")).alias("runs"))
    )


def unannounced(runs: Column) -> Column:
    """Runs without the line that announces a deeper quote right after them."""
    announced = lambda r, i: F.coalesce(F.get(runs, i + 1)["level"] > r["level"], F.lit(False))
    return F.transform(runs, lambda r, i: F.struct(
        r["level"].alias("level"),
        F.when(announced(r, i), F.regexp_replace(r["body"], "(?m)" + ANNOUNCED[:-1] + r"\s*\z", "")).otherwise(r["body"]).alias("body")))


def own_text(runs: Column) -> Column:
    """A message without its quotes."""
    kept = F.transform(F.filter(runs, lambda r: r["level"] == 0), lambda r: r["body"])
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\A\s+|\s+\z", ""))


def originals(rows: DataFrame) -> DataFrame:
    """``conv_id, key, turn``: the passages that messages say, whole or as a line or paragraph."""
    said = F.array_distinct(F.concat(
        F.array(normal(F.col("own"))), F.transform(F.split("own", "\n", -1), normal),
        F.transform(F.split("own", r"\n[ \t]*\n", -1), normal)))
    return (
        rows.select("conv_id", "turn", F.explode(said).alias("passage")).where("passage <> ''")
        .select("conv_id", _key(F.col("passage")).alias("key"), "turn")
    )


def line_runs(rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """``conv_id, key, turn``: where messages hold, as lines that follow each other, what quotes of the conversation hold.

    ``quotes`` has ``conv_id, n_lines, k, first, last`` of each quote. Two runs of ``2 ** k`` lines, one at each end, cover any
    run of up to ``2 ** (k + 1)``: messages give their runs of such lengths as quotes of the conversation have, which is lines
    times the logarithm of the longest quote, those that no quote opens or ends with go, and the rest meet by their distance.
    Equal quotes count once and equal sayings are for the caller to shrink, so pairs of a quote and a saying are never made.
    """
    asked = quotes.where("n_lines > 1").select(
        F.col("conv_id").alias("asked_id"), F.col("k").alias("asked_k"), "n_lines", "first", "last").distinct()
    ends = asked.select("asked_id", "asked_k", F.explode(F.array("first", "last")).alias("end")).distinct()
    said = (
        rows.select("row", "conv_id", "turn", line_keys(F.col("own")).alias("keys")).where("size(keys) > 1")
        .join(asked.select("asked_id", F.col("asked_k").alias("k")).distinct(), F.expr("conv_id = asked_id and size(keys) >= shiftleft(1, k)"))
        .select("row", "conv_id", "turn", "k", F.posexplode(F.expr(doubled("keys", "k"))).alias("at", "run"))
    )
    said = stage(said.join(ends, F.expr("conv_id = asked_id and k = asked_k and run = end"), "left_semi"), "chat-line-runs")
    opened = asked.select("asked_id", "asked_k", "n_lines", F.col("first").alias("opens")).distinct()
    closing = said.select("row", "k", "at", F.col("run").alias("last"))
    return (
        said.join(opened, F.expr("conv_id = asked_id and k = asked_k and run = opens"))
        .select("row", "conv_id", "turn", "k", "n_lines", "run", F.expr("at + n_lines - shiftleft(1, k)").alias("at"))
        .join(closing, ["row", "k", "at"])
        .select("conv_id", _run_key(F.col("n_lines"), F.col("run"), F.col("last")).alias("key"), "turn")
    )


def linked(rows: DataFrame) -> DataFrame:
    """``row, level, source``: each quoted passage with the turn it comes from, null where there is none."""
    quotes = (
        rows.select("row", "conv_id", "turn", F.posexplode("runs").alias("place", "q")).where("q.level > 0")
        .select("row", "place", "conv_id", "turn", F.col("q.level").alias("level"), normal(F.col("q.body")).alias("passage"),
                line_keys(F.col("q.body")).alias("lines"))
        .where("passage <> ''")
        .withColumn("n_lines", F.size("lines")).withColumn("k", F.expr(power("n_lines")))
        .withColumn("ends", F.expr(f"if(n_lines > 1, {doubled('lines', 'k')}, lines)"))
        .select("row", "place", "conv_id", "turn", "level", F.length("passage").alias("size"), "n_lines", "k",
                _key(F.col("passage")).alias("whole"), F.get("ends", F.lit(0)).alias("first"), F.expr("get(ends, size(ends) - 1)").alias("last"))
        .withColumn("keys", F.when(F.col("n_lines") > 1, F.array("whole", _run_key(F.col("n_lines"), F.col("first"), F.col("last"))))
                    .otherwise(F.array("whole")))
    )
    quotes = stage(quotes, "chat-quotes")
    keyed = quotes.withColumn("key", F.explode("keys"))
    # only conversations that quote need an index of what they say
    asked = keyed.select("conv_id", "key").distinct()
    known = rows.where("conv_id is not null and turn is not null")
    found = (
        originals(known).unionByName(line_runs(known, quotes)).groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
        .join(asked, ["conv_id", "key"], "left_semi")
    )
    # a quote has one key or two
    return (
        keyed.join(found, ["conv_id", "key"], "left")
        .groupBy("row", "place", "level", "size").agg(F.min(F.when(F.col("source") < F.col("turn"), F.col("source"))).alias("source"))
        .select("row", "level", "size", "source")
    )


def threads(parents: DataFrame) -> DataFrame:
    """``conv_id, turn, root, depth`` of answering turns, given ``conv_id, turn, parent``; written after each doubling."""
    now = stage(parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "reply-links")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        step = stage(
            now.join(up, ["conv_id", "root"], "left").select(
                "conv_id", "turn", F.coalesce("above", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "reply-links")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def placed(rows: DataFrame) -> DataFrame:
    """Add ``position`` (from 0) by thread and turn inside each conversation."""
    order = ["conv_id", "root_turn", "turn", "row"]
    laid = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("range", F.spark_partition_id()).withColumn("mark", F.monotonically_increasing_id()), "reply-order")
    # a row for each range, that is for each task of the sort
    ranges = laid.groupBy("range").agg(F.count("*").alias("n"), F.min("mark").alias("low"))
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("range", "low", F.coalesce(upto, F.lit(0)).alias("before"))
    numbered = laid.join(F.broadcast(ranges), "range").withColumn("number", F.col("before") + F.col("mark") - F.col("low"))
    starts = numbered.groupBy("conv_id").agg(F.min("number").alias("start")).withColumnRenamed("conv_id", "start_id")
    return (
        numbered.join(starts, F.expr("conv_id <=> start_id")).withColumn("position", F.col("number") - F.col("start"))
        .drop("range", "mark", "low", "before", "number", "start", "start_id")
    )


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """A row for each message: ``conv_id, position, turn, role, root_turn, parent_turn, depth, n_quotes, n_linked, text``.

    ``position`` orders a conversation by replies; ``text`` is the message without quotes.
    """
    rows = stage(parsed(messages, conv, turn, role, text).withColumn("own", own_text(F.col("runs"))), "chat-lines")
    links = stage(linked(rows), "chat-links")
    best = links.groupBy("row").agg(
        F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"),
        F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("size")).alias("less"), "source"))).alias("best"),
    ).select("row", "n_quotes", "n_linked", F.col("best.source").alias("parent_turn"))
    told = stage(rows.drop("runs").join(best, "row", "left"), "chat-parents")
    parents = told.where("parent_turn is not null").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("parent"))
    roots = threads(parents).withColumnRenamed("conv_id", "root_conv").withColumnRenamed("turn", "root_of").withColumnRenamed("root", "root_turn")
    whole = (
        told.join(roots, F.expr("conv_id = root_conv and turn = root_of"), "left")
        .select("row", "conv_id", "turn", "role", F.coalesce("root_turn", "turn").alias("root_turn"), "parent_turn",
                F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
                F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("text"))
    )
    return placed(whole).select(
        "conv_id", "position", "turn", "role", "root_turn", "parent_turn", "depth", "n_quotes", "n_linked", "text")
