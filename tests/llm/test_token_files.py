import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chirpmill.llm import token_files
from chirpmill.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


def plain(rows, end=1):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, {}
    for i, text in sorted(rows):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_numbers_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        values = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack_numbers(values)
        assert len(control) == -(-n // 4)
        assert np.array_equal(token_files.unpack_numbers(control, data, n), values)


def test_words_by_parts_equal_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["İ. x", "ΣΑΣ!! a's don't <|endoftext|>. a<|endoftext|>.", "é.é é. é x̸= a̸", "a\tb c d.", "K. ﬁ. ß! ǅ. ª. ²!", " ", "\n\n..",
             "THE. The, the'll the!!!", "a b. c d", "x" * 5000 + "!", "", "가. 각!", "…a…. b…"]
    got = token_files.encode_texts(PATH, texts, np.uint32) + token_files.encode_texts(PATH, texts, np.uint32)
    for text, ids in zip(texts + texts, got):
        assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_columns_by_parts_equal_whole_texts():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["skipped", "The the THE. don't!", None, "", "J\u030c h. 12 \n ..", "naïve, NAÏVE", "a" * 60 + " b" * 500 + ".", "İ"]
    for column in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string())):
        for first, count in token_files._chunks(column.slice(1)):
            ids, ends = token_files.encode_column(PATH, column.slice(1).slice(first, count), np.uint16)
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [
                tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[1 + first:1 + first + count]]


def test_chunks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 10)
    column = pa.array(["", "x" * 4, "é" * 3, "x" * 40, None, None, "x" * 10, "x", None])
    found = list(token_files._chunks(column))
    assert [i for first, count in found for i in range(first, first + count)] == list(range(len(column)))
    assert found == [(0, 3), (3, 1), (4, 3), (7, 2)]
    assert list(token_files._chunks(column.slice(0, 0))) == []


def test_few_remembered(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 4)
    monkeypatch.setattr(token_files, "OTHERS", 2)
    monkeypatch.setitem(token_files._worker, (PATH, np.uint16), (Tokenizer.from_file(PATH), {}, {}))
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("one two three", "two four, 5", "six seven one 5 6 7!", "one"):
        ids = token_files.encode_texts(PATH, [text, text + "."], np.uint16)
        assert [np.frombuffer(x, np.uint16).tolist() for x in ids] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (text, text + ".")]
        assert len(token_files._worker[PATH, np.uint16][1]) <= 4 and len(token_files._worker[PATH, np.uint16][2]) <= 4


def test_runs_of_many_texts_are_tokenized_together(monkeypatch):
    class Counting:
        def __init__(self):
            self.made, self.calls = Tokenizer.from_file(PATH), 0

        def encode(self, *given, **named):
            self.calls += 1
            return self.made.encode(*given, **named)

        def encode_batch_fast(self, *given, **named):
            return self.made.encode_batch_fast(*given, **named)

    counting = Counting()
    monkeypatch.setitem(token_files._worker, (PATH, np.uint16), (counting, {}, {}))
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:03d}") for i in range(400)]
    texts = [f"{words[i % 400]} {words[i * 7 % 400]}. the" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 1000, pa.int32()), pa.array(range(1000)), pa.array(texts)], names=["shard", "doc_id", "text"])
    made = list(token_files._token_blocks(PATH, 1, False)([batch]))
    assert counting.calls == 1
    assert sum(len(b.column(3)[0]) for b in made) == 1000


def test_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["The", "a.", "zzqx", "é", "12", "!"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, "long word " * 60000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("shard", F.lit("s")).withColumn("ids", F.lit(1))
    token_files.write_ids(docs, f"{tmp_path}/ids", PATH, 1)
    got = token_files.read_ids(spark, f"{tmp_path}/ids").collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == plain(rows)
    one = next(r for r in got if r["doc_id"] == rows[0][0])
    assert zlib.crc32(one["ids"]) == one["ids_crc32"]


def test_repeated_and_missing_ids(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (2, "a"), (None, "c d"), (2, "a")], SCHEMA)
    token_files.write_ids(docs, f"{tmp_path}/ids", PATH, 1)
    got = sorted(token_files.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 2, 2] and [r["start"] for r in got] == [0, 3, 5, 7]
    token_files.write_ids(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none", PATH, 1)
    assert token_files.read_ids(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_equals_plain_encoding(spark, name):
    folder = f"/root/testdata/{name}"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_token_files"](spark, folder).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == plain(rows)
