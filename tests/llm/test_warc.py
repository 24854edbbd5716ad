import glob

import pytest
from pyspark.sql import functions as F
from sql import same_as_sql, write

from chirpmill.llm import warc

SCHEMA = "page_id long, url string, html string"
FAKE = ("<p>WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nWARC-Payload-Digest: sha256:00\r\n"
        "Content-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\n\r\n0123456789a\r\n\r\n") + "é" * 80
SAME = "<html>" + "same " * 40


def rows():
    out = [(i, f"http://a/{i} x\r\ny", f"<p>{i}</p>" + "z" * (i % 7) * 30) for i in range(40)]
    out += [(50, "u", SAME), (41, None, SAME), (60, "u", SAME), (61, "u", None), (62, "u", ""), (63, "u", "short"), (64, "u", "short"),
            (65, "http://w", FAKE), (66, "http://w", FAKE + "2"), (67, "http://w", "WARC/1.0\r\n" * 200), (68, "v", "é\r\n\r\n" * 50000),
            (70, "WARC/1.0", "WARC/1.0"), (71, "u", "\r\n\r\n"), (72, "u", FAKE)]
    return out


def test_equals_sql(spark, tmp_path):
    folder = write(spark, tmp_path, pages=(rows(), SCHEMA))
    assert same_as_sql(spark, folder, "op10_warc", "pages") == "ok"


def test_files_are_warc(spark, tmp_path):
    path = str(tmp_path / "archive")
    pages = spark.createDataFrame(rows(), SCHEMA).withColumn("size", F.lit("s")).withColumn("digest", F.lit(1))
    warc.write_archive(pages, path)
    seen = {}
    for name in glob.glob(path + "/part-*"):
        data, at = open(name, "rb").read(), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            seen[int(fields[b"WARC-Record-ID"][10:-1])] = (fields[b"WARC-Type"], rest[:size].partition(b"\r\n\r\n")[2])
            at += len(head) + 4 + size + 4
    for page, _, html in rows():
        kind, payload = seen.pop(page)
        assert payload == ((html or "").encode() if kind == b"response" else b"")
    assert not seen


def test_cut_file_is_told(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows(), SCHEMA).coalesce(1), path)
    name = glob.glob(path + "/part-*")[0]
    data = open(name, "rb").read()
    with open(name, "wb") as f:
        f.write(data[:len(data) // 2])
    for crc in glob.glob(path + "/.*.crc"):
        open(crc, "wb").close()
    with pytest.raises(Exception):
        warc.read_archive(spark, path).collect()


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, "u", SAME), (1, "u", SAME), (None, "u", SAME), (None, "u", "a")], SCHEMA)
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archived(odd).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.archived(spark.createDataFrame([], SCHEMA)).collect() == []
