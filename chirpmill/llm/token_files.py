"""Token ids in files: ranked by frequency and written byte-aligned with separate control bytes.

Texts are dealt into ranges of ascending ids, tokenized once, and kept as blocks of some hundred thousand token
ids. Ids are then renumbered by frequency over the whole corpus, so that the common ones take one byte. Each number is
written in 1 to 4 bytes; two bits say in how many, four of them to a control byte, and all control bytes of a block stand
before all data bytes. Decoding looks up the four lengths of each control byte in a table of 256 rows and gathers the
bytes with numpy, a whole block at once.

Layout below the given path: ``blocks`` (``shard, block, before, doc_ids, sizes, control, data``; ``before`` counts ids
in earlier blocks of the shard, and shards are in ascending order of their ids) and ``vocabulary`` (``id, rank``, at most
one row for each token of the tokenizer). Both are Parquet, so a lost task never leaves half a file.

Edge cases: null and empty texts are the end id alone; rows that repeat an id follow each other in order of their
text; null ids come first; an empty table gives empty files. Only the two named columns are read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirpmill.session import work_path

BLOCK_IDS = 1 << 18
#: Bytes of text that are cut into parts at once.
CHUNK_BYTES = 16 << 20
#: Letter runs, and other parts of texts, remembered with their ids by each worker, and the longest that is.
REMEMBERED, OTHERS, LONGEST = 1_000_000, 250_000, 48
#: Marks that end a part without touching the letters before them; the apostrophe can (it opens contractions).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_worker: dict[tuple[str, type], tuple] = {}


def _tokenizer(path: str, kind: type):
    """The tokenizer of this worker, and the ids of the letter runs and of the other parts that it has seen."""
    if (path, kind) not in _worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _worker[path, kind] = (Tokenizer.from_file(path), {}, {})
    return _worker[path, kind]


def _runs(tokenizer, runs: list[str], kind: type) -> list[bytes]:
    """Ids of letter runs, many to a call: each is one word to the tokenizer, or they are encoded one by one."""
    out, wide = [], kind().itemsize
    for a in range(0, len(runs), 500):
        some = runs[a:a + 500]
        made = tokenizer.encode(" ".join(some), add_special_tokens=False)
        cuts = np.flatnonzero(np.diff(np.array(made.word_ids))) + 1
        if len(cuts) + 1 == len(some) and made.ids:
            ids, edges = np.array(made.ids, kind).tobytes(), [0, *(cuts * wide).tolist()]
            out += [ids[i:j] for i, j in zip(edges, [*edges[1:], len(ids)])]
        else:
            out += _others(tokenizer, some, kind)
    return out


def _others(tokenizer, parts: list[str], kind: type) -> list[bytes]:
    """Ids of parts that are tokenized one by one."""
    return [np.array(e.ids, kind).tobytes() for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def _plain(run: str) -> bool:
    """Is it letters that stay letters in lower case?

    A part that is such a run and then marks has the ids of the run followed by the ids of the marks, and A-Z in the run may
    be lower-cased before, for a tokenizer that lower-cases, splits letters from marks and has no special token in the part.
    """
    return run.isalpha() and run.lower().isalpha()


def _remembered(seen: dict[str, bytes], parts: list[str], encode, limit: int, fits=None) -> list[bytes | None]:
    """Ids of different parts, by ``encode`` where they are not in ``seen``; None for new ones that ``fits`` does not take.

    Short ones are kept in ``seen``, up to ``limit`` or as many as are new.
    """
    ids = list(map(seen.get, parts))
    new = [i for i, known in enumerate(ids) if known is None and (not fits or fits(parts[i]))]
    made = encode([parts[i] for i in new])
    if len(seen) + len(new) > limit:
        seen.clear()
    for i, x in zip(new, made):
        ids[i] = x
        if len(parts[i]) <= LONGEST:
            seen[parts[i]] = x
    return ids


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _cut(strings: pa.Array, start: np.ndarray) -> pa.Array:
    """Each string from a byte of its own on."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, 8 * strings.offset)
    size = offsets[1:] - offsets[:-1] - start
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] + start - ends[:-1], size)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[at]
    return pa.LargeStringArray.from_buffers(len(strings), pa.py_buffer(ends), pa.py_buffer(data))


def encode_column(path: str, texts: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts behind each other, and where each text starts and ends in them; null is empty.

    White space never joins or changes tokens of this kind of tokenizer, so texts are cut at blanks and line ends. Each
    different part is looked at once, as letters and the marks behind them, and each different run of letters, or other
    part, is tokenized once.
    """
    tokenizer, runs, others = _tokenizer(path, kind)
    split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " "), " ")
    parts = split.flatten().dictionary_encode()
    words = parts.dictionary
    heads = pc.ascii_rtrim(words, MARKS)
    lower = pc.ascii_lower(heads).dictionary_encode()
    binary = pa.large_binary()
    of_runs = pa.array(_remembered(runs, _strings(lower.dictionary), lambda new: _runs(tokenizer, new, kind), REMEMBERED, _plain), binary)
    of_heads = of_runs.take(lower.indices)
    size = pc.if_else(of_heads.is_valid(), pc.binary_length(heads), 0).to_numpy()
    rest = _cut(words, size).dictionary_encode()
    of_rest = pa.array(_remembered(others, _strings(rest.dictionary), lambda new: _others(tokenizer, new, kind), OTHERS), binary)
    of_words = pc.binary_join_element_wise(of_heads.fill_null(b""), of_rest.take(rest.indices), pa.scalar(b"", binary))
    ids = of_words.take(parts.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[split.offsets.to_numpy()] // kind().itemsize
    return np.frombuffer(ids.buffers()[2] or b"", kind), ends


def encode_texts(path: str, texts: list[str], kind: type) -> list[bytes]:
    """Ids of each text."""
    ids, ends = encode_column(path, pa.array(texts, pa.string()), kind)
    return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def _chunks(texts: pa.Array):
    """``(first, count)`` of rows that hold some ``CHUNK_BYTES`` together, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield first, last - first
        first = last


_INTS = pa.list_(pa.int32())


def _token_blocks(path: str, end_id: int, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches):
        end, block, before, held = kind(end_id).tobytes(), 0, 0, []

        def flush():
            nonlocal block, before, held
            ids = b"".join(x for _, _, x in held)
            sizes = np.array([len(x) // kind().itemsize for _, _, x in held], np.int32)
            made = pa.RecordBatch.from_arrays(
                [pa.array([held[0][0]], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays([x for _, x, _ in held])),
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.array(sizes)), pa.array([ids], pa.binary())],
                names=["shard", "block", "before", "doc_ids", "sizes", "ids"])
            block, before, held = block + 1, before + int(sizes.sum()), []
            return made

        size = 0
        for batch in batches:
            names = batch.column(1)
            for first, count in _chunks(batch.column(2)):
                shard = batch.column(0)[first].as_py()
                found, ends = encode_column(path, batch.column(2).slice(first, count), kind)
                for i in range(count):
                    ids = found[ends[i]:ends[i + 1]].tobytes()
                    held.append((shard, names.slice(first + i, 1), ids + end))
                    size += len(ids) + len(end)
                    if size >= BLOCK_IDS * len(end):
                        yield flush()
                        size = 0
        if held:
            yield flush()
    return run


def _counts(wide: bool):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                now = np.bincount(np.frombuffer(ids.as_buffer(), np.uint32 if wide else np.uint16))
                if len(now) > len(total):
                    now, total = total, now
                total[:len(now)] += now
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])
    return run


def pack_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[:len(values)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


#: The four sizes that each control byte stands for.
_SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpack_numbers(control, data, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack_numbers`` packed."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    data = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = data[at]
    for j in (1, 2, 3):
        more = np.flatnonzero(size > j)
        out[more] |= data[at[more] + j] << np.uint32(8 * j)
    return out


def _packed(ranks, wide: bool):
    def run(batches):
        rank = ranks.value
        for batch in batches:
            packed = [pack_numbers(rank[np.frombuffer(x.as_buffer(), np.uint32 if wide else np.uint16)]) for x in batch.column(5)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())],
                names=["shard", "block", "before", "doc_ids", "sizes", "control", "data"])
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize all texts with the file ``tokenizer`` and write their ids, each text followed by ``end_id``.

    ``tokenizer`` must be a file that executors can open at the same path, and drop white space.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    wide = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) > 1 << 16
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    )
    staged = work_path(spark, "token-blocks")
    ordered.mapInArrow(
        _token_blocks(tokenizer, end_id, wide),
        f"shard int, block bigint, before bigint, doc_ids array<{kind}>, sizes array<int>, ids binary",
    ).write.option("compression", "zstd").parquet(staged)
    blocks = spark.read.parquet(staged)
    # as many rows as the tokenizer has tokens, whatever the corpus
    counts = blocks.select("ids").mapInArrow(_counts(wide), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranks = {r["id"]: k for k, r in enumerate(sorted(counts, key=lambda r: (-r["n"], r["id"])))}
    spark.createDataFrame(list(ranks.items()), "id bigint, rank bigint").coalesce(1).write.parquet(f"{path}/vocabulary")
    table = np.zeros(max(ranks, default=0) + 1, np.uint32)
    table[list(ranks)] = list(ranks.values())
    held = spark.sparkContext.broadcast(table)
    blocks.mapInArrow(
        _packed(held, wide),
        f"shard int, block bigint, before bigint, doc_ids array<{kind}>, sizes array<int>, control binary, data binary",
    ).write.option("compression", "zstd").parquet(f"{path}/blocks")


def _unpacked(ids):
    def run(batches):
        table = ids.value
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(4)[i].values.to_numpy()
                ends = np.cumsum(sizes, dtype=np.int64)
                got = table[unpack_numbers(batch.column(5)[i].as_buffer(), batch.column(6)[i].as_buffer(), int(ends[-1]))]
                raw, starts = memoryview(got.astype("<u4")).cast("B"), ends - sizes
                names = batch.column(3)[i].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), batch.column(0)[i].as_py()), pa.int32()), names,
                     pa.array(starts + batch.column(2)[i].as_py()), pa.array(sizes.astype(np.int64)),
                     pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                     pa.array([bytes(raw[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.binary())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from written files; ``ids`` are little-endian 32-bit numbers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()
    held = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.select("shard", "block", "before", "doc_ids", "sizes", "control", "data").mapInArrow(
        _unpacked(held), f"shard int, doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    sizes = blocks.groupBy("shard").agg(
        F.sum(F.expr("aggregate(sizes, 0L, (a, n) -> a + n)")).alias("size"))
    # a row for each shard, that is for each task that wrote
    upto = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", F.coalesce(upto, F.lit(0)).alias("shard_start"))
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "ids")
