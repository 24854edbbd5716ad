"""Records of CSV files whose quoted fields may hold line breaks, read by many tasks a file.

Whether a line break ends a record depends on all quotes before it, so a reader for such files takes a file as a whole. Here
the text source cuts files into blocks as usual. Each task walks its lines under both suppositions, that its block starts
outside or inside a quoted field, and notes for both where every line begins and ends and how many records have begun
(``lines``). What a block does to the state is one of four functions of one bit; a scan over the blocks of a file composes
them and so picks the right supposition for each. A line that begins and ends outside of quotes is a record; only parts of
longer records are shuffled, to be put together by the place where the record began.

A field is quoted if it starts with a quote; a doubled quote inside stands for one, and what follows the closing quote up to
the next delimiter belongs to the field. A quote inside an unquoted field means nothing. Records end with a line feed, with
or without a carriage return before it; empty lines are no records. Files may be empty, have no last line feed, or end inside
a quoted field, which then is the last one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

_LINES = ("file string, block bigint, place bigint, line string, "
          "opens_out boolean, opens_in boolean, ends_out boolean, ends_in boolean, begun_out bigint, begun_in bigint")


def _states(delimiter: str):
    """What ``mapInArrow`` does with the lines of a task; a closure, so that it travels to the workers by value."""
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*"(?:[^"{d}][^{d}]*)?|[^"{d}][^{d}]*)?'
    whole = rf"(?s)\A{field}(?:{d}{field})*\z"
    names = ["file", "block", "place", "line", "opens_out", "opens_in", "ends_out", "ends_in", "begun_out", "begun_in"]

    def ends_inside(lines: pa.Array) -> np.ndarray:
        return ~pc.match_substring_regex(lines, whole).to_numpy(zero_copy_only=False)

    def walked(before: bool, out: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The state behind each line: the last line that fixes it, turned by those that turn it since."""
        turns = np.cumsum(out & ~into)
        fixed = np.maximum.accumulate(np.where(out == into, np.arange(len(out)), -1))
        since = turns - np.where(fixed >= 0, turns[fixed], 0)
        return np.where(fixed >= 0, out[fixed], before) ^ (since % 2 == 1)

    def run(batches):
        at, place, state, begun = None, 0, [False, True], [0, 0]
        for batch in batches:
            line, file, block = (batch.column(i) for i in range(3))
            n = len(line)
            if not n:
                continue
            out, into = np.zeros(n, bool), np.ones(n, bool)
            quoted = np.flatnonzero(pc.match_substring(line, '"').to_numpy(zero_copy_only=False))
            if len(quoted):
                some = line.take(pa.array(quoted))
                out[quoted] = ends_inside(some)
                into[quoted] = ends_inside(pc.binary_join_element_wise(pa.scalar('"'), some, ""))
            blank = pc.is_in(line, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            files, blocks = file.dictionary_encode().indices.to_numpy(), block.to_numpy()
            cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, n]):
                key = (file[int(a)].as_py(), int(blocks[a]))
                if key != at:
                    at, place, state, begun = key, 0, [False, True], [0, 0]
                columns = []
                for i in (0, 1):
                    ends = walked(state[i], out[a:b], into[a:b])
                    opens = np.append(state[i], ends[:-1])
                    columns.append((opens, ends, begun[i] + np.cumsum(~opens & ~blank[a:b])))
                    state[i], begun[i] = bool(ends[-1]), int(columns[i][2][-1])
                yield pa.RecordBatch.from_arrays([
                    file.slice(a, b - a), block.slice(a, b - a), pa.array(np.arange(place, place + b - a)), line.slice(a, b - a),
                    *(pa.array(columns[i][j]) for j in range(3) for i in (0, 1))], names=names)
                place += int(b - a)

    return run


def lines(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """Lines of all files under both suppositions, written once so that later passes see the same blocks."""
    source = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return stage(source.mapInArrow(_states(delimiter), _LINES), "csv-lines")


def block_states(found: DataFrame) -> DataFrame:
    """``file, block, inside, open_block, open_begun, head_block``: how each block starts, which record is then open, and in
    which block the first record of the file begins."""
    blocks = found.groupBy("file", "block").agg(
        F.max_by("ends_out", "place").alias("out"), F.max_by("ends_in", "place").alias("into"),
        F.max("begun_out").alias("begun_out"), F.max("begun_in").alias("begun_in"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    behind = (
        blocks.withColumn("turns", F.sum(F.expr("if(out and not into, 1, 0)")).over(upto))
        .withColumn("fixed", F.last(F.when(F.col("out") == F.col("into"), F.struct("out", "turns")), ignorenulls=True).over(upto))
        .withColumn("ends", F.expr("coalesce(fixed.out, false) != ((turns - coalesce(fixed.turns, 0)) % 2 = 1)"))
    )
    order = Window.partitionBy("file").orderBy("block")
    return (
        behind.withColumn("inside", F.lag("ends", 1, False).over(order))
        .withColumn("begun", F.expr("if(inside, begun_in, begun_out)"))
        .withColumn("open", F.last(F.when(F.col("begun") > 0, F.struct("block", "begun")), ignorenulls=True).over(before))
        .withColumn("head_block", F.min(F.when(F.col("begun") > 0, F.col("block"))).over(Window.partitionBy("file")))
        .select("file", "block", "inside", F.col("open.block").alias("open_block"), F.col("open.begun").alias("open_begun"), "head_block"))


def records(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """``file, header, record``: every record; ``header`` marks the first one of a file."""
    found = lines(spark, path, delimiter)
    states = stage(block_states(found), "csv-blocks")
    placed = found.join(states, ["file", "block"]).select(
        "file", "block", "place", "line", F.expr("if(inside, opens_in, opens_out)").alias("opens"),
        F.expr("if(inside, ends_in, ends_out)").alias("ends"), F.expr("if(inside, begun_in, begun_out)").alias("begun"),
        "open_block", "open_begun", "head_block")
    # a file does not start inside quotes, so an open record has begun in this block or in one before
    single = placed.where("not opens and not ends").select(
        "file", F.expr("block = head_block and begun = 1").alias("header"), F.col("line").alias("record"))
    began = [F.expr("if(begun > 0, block, open_block)").alias("began"), F.expr("if(begun > 0, begun, open_begun)").alias("number")]
    parts = placed.where("opens or ends").select("file", "head_block", *began, F.struct("block", "place", "line").alias("part"))
    joined = parts.groupBy("file", "began", "number").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.min("head_block").alias("head_block")).select(
        "file", F.expr("began = head_block and number = 1").alias("header"), F.array_join("parts.line", "\n").alias("record"))
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", r"\r\z", "")).where("record <> ''")
