"""WARC archives: written by Spark's text sink, read back through verified record boundaries.

Writing: each page is one record, a string whose end mark ``CR LF CR LF`` is the line separator of the sink, so the
archives are plain WARC files and are committed like any other output. Of pages with equal payloads of at least
``MIN_BYTES`` the one with the smallest id is a ``response``; the rest are ``revisit`` records, which keep the HTTP
head and name that page. A file takes ``RECORDS`` records at most, which bounds what a reading task holds.

Reading, by boundary-chain verification: tasks look for the magic line in the files and emit every candidate record
as an edge from its offset to that of its successor (head plus ``Content-Length`` plus end mark). Payloads may hold the
magic, even whole records, so a candidate proves nothing; pointer jumping doubles the reach from offset 0 of each file
in every round, and only candidates on that chain are records. A file whose chain does not reach its end raises.

Edge cases: null html is an empty payload; null urls are written as an empty target; white space and control
characters in a url are dropped from the head; rows that repeat the smallest id of a group stay responses, and rows
with a null id revisit; when every id of a group is null all are responses; an empty table gives an archive without
records. Only the three named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirpmill.session import stage, work_path

MIN_BYTES = 100
RECORDS = 1024
END = "\r\n\r\n"
MAGIC = b"WARC/1.0\r\n"


def _labelled(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """``page_id, url, html, size, digest, refers_to``."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    keys = stage(rows.select("page_id", "size", "digest"), "page-digests")
    shared = keys.where(F.col("size") >= MIN_BYTES).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = keys.join(shared, "digest").where("not (page_id <=> refers_to)").select(
        F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct()
    # as a written table its true size decides whether it is broadcast or the pages are shuffled
    return rows.join(stage(revisits, "page-revisits"),
                     F.expr("page_id <=> revisit_id and digest = revisit_digest"), "left").drop("revisit_id", "revisit_digest")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` as WARC files below ``path``; ``date`` is the capture date put into every head."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    new = F.col("refers_to").isNull()
    http = F.concat(
        line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"),
        line("Content-Length: ", F.col("size").cast("string")), F.lit("\r\n"))
    head = F.concat(
        line("WARC/1.0"), line("WARC-Type: ", F.when(new, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID: ", uri("page_id")), line("WARC-Date: ", date),
        line("WARC-Target-URI: ", F.regexp_replace("url", r"[\x00-\x20\x7F]", "")),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        F.when(new, F.lit("")).otherwise(F.concat(
            line("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            line("WARC-Refers-To: ", uri("refers_to")))),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length("block").cast("string")))
    (
        _labelled(pages, page_id, url, html).withColumn("http", http)
        .withColumn("block", F.when(new, F.concat("http", "html")).otherwise(F.col("http")))
        .select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))
        .write.option("lineSep", END).option("maxRecordsPerFile", RECORDS).text(path)
    )


_HEAD = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _record(content: bytes, start: int):
    """Successor and fields of the record that would start at ``start``, or None if no whole record can."""
    stop = content.find(b"\r\n\r\n", start)
    if stop < 0:
        return None
    head = {k.lower(): v for k, v in _HEAD.findall(content[start + len(MAGIC):stop + 2])}
    length = head.get(b"content-length", b"")
    if not length.isdigit():
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if content[end:end + 4] != b"\r\n\r\n":
        return None
    return end + 4, head, begin, end


def _candidates(batches):
    names = ["file", "at", "next", "kind", "page_id", "refers_to", "payload_bytes", "digest", "sound"]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            content, rows = content.as_buffer().to_pybytes(), []
            at = content.find(MAGIC)
            while at >= 0:
                if found := _record(content, at):
                    following, head, begin, end = found
                    number = lambda k: int(m[1]) if (m := _ID.fullmatch(head.get(k, b""))) else None
                    kind = head.get(b"warc-type", b"").decode("ascii", "replace")
                    said = head.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
                    body = content.find(b"\r\n\r\n", begin, end) + 4
                    size = dict((k.lower(), v) for k, v in _HEAD.findall(content[begin:body])).get(b"content-length", b"")
                    size = int(size) if size.isdigit() else -1
                    sound = body > 3
                    if kind == "response":
                        digest = hashlib.sha256(memoryview(content)[body:end]).hexdigest()
                        sound, said, size = sound and digest == said and size == end - body, digest, end - body
                    rows.append((path, at, following, kind, number(b"warc-record-id"), number(b"warc-refers-to"), size, said, sound))
                at = content.find(MAGIC, at + 1)
            # an edge into the end of the file: the mark that the chain has come through
            rows.append((path, len(content), len(content), "end", None, None, 0, "", True))
            if rows[0][1] != 0:
                rows.append((path, 0, -1, "gap", None, None, 0, "", False))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archive where a record could start, with the offset of what would follow it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(
        _candidates, "file string, at bigint, next bigint, kind string, page_id bigint, refers_to bigint,"
                     " payload_bytes bigint, digest string, sound boolean")


def on_chain(edges: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that can be reached from offset 0 of their file.

    Round k knows for each candidate the one 2**k records on, and those of the first 2**k that are reached; every
    round is written, so a lost executor costs one round.
    """
    most = edges.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    now = edges.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("reached"))
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        far = now.select("file", F.col("at").alias("jump"), F.col("jump").alias("further"))
        met = now.where("reached").select("file", F.col("jump").alias("at"), F.lit(True).alias("met")).distinct()
        now = stage(
            now.join(met, ["file", "at"], "left").join(far, ["file", "jump"], "left")
            .select("file", "at", F.coalesce("further", F.lit(-1)).alias("jump"),
                    (F.col("reached") | F.coalesce("met", F.lit(False))).alias("reached")), "warc-chain")
    return now.where("reached").select("file", "at")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    edges = stage(candidates(spark, path), "warc-candidates")
    kept = stage(edges.join(on_chain(edges.select("file", "at", "next")), ["file", "at"], "left_semi"), "warc-records")
    broken = kept.where("kind = 'gap' or not sound").select("file", "at")
    cut = edges.where("kind = 'end'").select("file", "at").exceptAll(kept.where("kind = 'end'").select("file", "at"))
    if bad := broken.unionByName(cut).head():
        raise ValueError(f"{bad['file']} is broken at or before byte {bad['at']}")
    return kept.where("kind in ('response', 'revisit')").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back."""
    path = work_path(pages.sparkSession, "warc")
    write_archive(pages, path, page_id, url, html)
    return read_archive(pages.sparkSession, path)
