"""CSV, inventory, reports, the shared folder."""

import random
from pathlib import Path

import pandas as pd
import pytest

from chirpmill.catalog.literals import literal_posts
from chirpmill.session import shared_dir, stage
from chirpmill.sources import csv_records, files


def test_csv_reads_like_pandas(spark, tmp_path):
    texts = ['a "quoted", text', "line\nbreak", "  outer  ", "NA", "", "None", "null", " NA", "x,y", " ", "1.5", "'single'", "back\\slash"]
    pdf = pd.DataFrame({"post_id": range(len(texts)), "text": texts})
    path = tmp_path / "posts.csv"
    pdf.to_csv(path, index=False)
    back = pd.read_csv(path, dtype={"text": str})
    expected = [None if pd.isna(v) else v for v in back["text"]]
    schema = spark.createDataFrame([], "post_id bigint, text string").schema
    got = {r[0]: r[1] for r in files.scan_csv(spark, str(path), schema).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_csv_round_trip(spark, tmp_path):
    rows = literal_posts(spark)
    files.write_csv(rows, str(tmp_path / "csv"))
    back = {r["post_id"]: r["text"] for r in files.scan_csv(spark, str(tmp_path / "csv"), rows.schema).collect()}
    expected = {r["post_id"]: r["text"] for r in rows.collect()}
    expected[-10] = None
    assert back == expected


def test_inventory_lists_files_below(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("1234")
    (tmp_path / "sub" / "b.txt").write_text("12")
    found = files.file_inventory(spark, str(tmp_path))
    assert sorted((Path(r["path"]).name, r["length"]) for r in found.collect()) == [("a.txt", 4), ("b.txt", 2)]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("Output")[-1]


def test_stage_writes_below_the_shared_folder(spark):
    df = stage(spark.range(5), "probe")
    assert df.count() == 5
    assert all(shared_dir(spark).split("://")[-1] in f for f in df.inputFiles())


def test_types_are_inferred_past_missing_markers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,x,b,t,none\n1,1.5,true,"a, b",NA\nNA,NA,,NA,\n3,2.5,false,2,\n')
    df = files.scan_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "t": "string", "none": "string"}
    assert [r["x"] for r in df.collect()] == [1.5, None, 2.5]


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "250", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rng, ends):
    text = "".join(rng.choice(["a", "é", " ", ",", ends, '"', "long " * 12]) for _ in range(rng.randint(0, 6)))
    if any(c in text for c in ',"\n') or rng.random() < .3:
        return '"' + text.replace('"', '""') + '"'
    return text


def whole_file_reader(spark, path, schema):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_of_a_file_give_the_records_of_the_whole(spark, tmp_path, small_blocks, seed):
    rng = random.Random(seed)
    for i in range(3):
        ends = rng.choice(["\n", "\r\n"])  # one kind a file, as the other reader settles on the first it meets
        rows = [f'n,"a{ends}name",b'] + [f"{j},{field(rng, ends)},{field(rng, ends)}" for j in range(rng.choice([0, 40, 90]))]
        rows += ["", "1000,plain\"quote,x", '1001,"closed" and more,y'] + ['1002,z,"open' if i else "1003,z,"]
        (tmp_path / f"{i}.csv").write_bytes(ends.join(rows).encode() + (b"" if i else ends.encode()))
    kind = "n string, a string, b string"
    expected = [tuple(r) for r in whole_file_reader(spark, str(tmp_path), kind).collect()]
    found = [tuple(r) for r in csv_records.records(spark, str(tmp_path)).where("not header").selectExpr(
        f"from_csv(record, '{kind}', map('quote', '\"', 'escape', '\"')) r").select("r.*").collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f'{i},"some\ntext, {i}"\n' for i in range(60)))
    found = csv_records.lines(spark, str(tmp_path / "a.csv"))
    blocks = found.select("block").distinct().count()
    assert blocks > 4
    read = files.scan_csv(spark, str(tmp_path / "a.csv"))
    assert sorted((r["id"], r["text"]) for r in read.collect()) == [(i, f"some\ntext, {i}") for i in range(60)]


def test_blank_lines_before_the_header_and_files_without_rows(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("\n" * 600 + '"id","","t"\n\n7,x,"\n"\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("id,,t")
    df = files.scan_csv(spark, str(tmp_path))
    assert df.dtypes == [("id", "bigint"), ("_c1", "string"), ("t", "string")]
    assert [tuple(r) for r in df.collect()] == [(7, "x", "\n")]
