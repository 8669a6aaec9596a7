"""WARC archives: written with revisits, read back by verified chains of record boundaries.

Writing. A page is a ``response`` record (HTTP head and payload) or, where an equal payload of at least
``LEAST`` bytes has a smaller page_id, a ``revisit`` record that refers to that page. Files are written by
Spark's text writer, so they appear only when a task commits. Long pages are written apart, by ``LONG``: a file has
so many records that it stays near ``FILE_BYTES`` even if all of its class were as long as the longest of it.

Reading. Payloads may hold the magic of a record. Each task lists, for every magic in its files, the offset of
the record and of its successor, where header, length and closing blank lines agree. From offset 0 of
each file pointers are then followed by pointer jumping: in each round the reached offsets double, and the
pointers jump twice as far. Only records that are reached count; a magic inside a payload never is. A chain that
does not end at the end of its file is an error. Heads may have any length.

Defined results. Null html is an empty payload. Pages of equal page_id are records of their own; of equal
payloads all that have the smallest page_id are responses. A page without an id is a response only if no page
with that payload has one. Line ends in a URL become spaces. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import small_batches, stored

LEAST = 100
#: Bytes of payload and URL up to which pages share files; a longer page than the last has a file to itself.
LONG = (1 << 18, 1 << 23)
FILE_BYTES, MOST_RECORDS = 1 << 26, 4096
SMALL_JOIN = 100_000
DATE = "2024-01-01T00:00:00Z"
#: At the start of a file or after the blank lines of the record before: heads of candidates don't overlap, so all are read once.
_MAGIC = re.compile(rb"(?:\A|(?<=\r\n\r\n))WARC/1\.[01]\r\n")


def write(pages: DataFrame, path: str) -> None:
    """Write the archives of ``pages`` (page_id, url, html) into a new folder."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", r"[\r\n]+", " "), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html")})
    slim = stored(rows.select("page_id", "digest", "size", F.octet_length("url").alias("url_size")), "payloads")
    of_page = F.col("size") + F.col("url_size")
    classes = [F.max(F.when((of_page > lo) & (of_page <= hi), of_page)) for lo, hi in itertools.pairwise((-1, *LONG, 1 << 40))]
    longest = slim.agg(*classes).first()
    first = slim.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    refs = slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull())
    refs = stored(refs.select(F.col("page_id").alias("ref_id"), F.col("digest").alias("ref_digest"), "refers_to").distinct(), "references")
    side = F.broadcast(refs) if refs.limit(SMALL_JOIN).count() < SMALL_JOIN else refs  # beyond, a shuffled join
    rows = rows.join(side, F.col("page_id").eqNullSafe(F.col("ref_id")) & (F.col("digest") == F.col("ref_digest")), "left")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("\r\n"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    is_ref = F.col("refers_to").isNotNull()
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", F.col("size").cast("string")), line(""))
    block = F.concat(http, F.when(is_ref, "").otherwise(F.col("html")))
    record = F.concat(
        line("WARC/1.1"), line("WARC-Type: ", F.when(is_ref, "revisit").otherwise("response")), line("WARC-Record-ID: <urn:page:", name("page_id"), ">"),
        line("WARC-Date: ", DATE), line("WARC-Target-URI: ", F.col("url")), line("WARC-Payload-Digest: sha256:", F.col("digest")),
        F.when(is_ref, F.concat(line("WARC-Refers-To: <urn:page:", name("refers_to"), ">"), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"), line("Content-Length: ", F.octet_length(block).cast("string")), line(""), block, F.lit("\r\n\r"),
    )  # the writer adds the last line feed
    bytes_ = F.col("size") + F.octet_length("url")
    for most, lo, hi in zip(longest, (-1, *LONG), (*LONG, 1 << 40), strict=True):
        if most is not None or lo < 0:  # the first class is written even if empty, so there is a folder
            records = max(1, min(MOST_RECORDS, FILE_BYTES // ((most or 0) + 1024)))
            some = rows.where((bytes_ > lo) & (bytes_ <= hi)) if longest[1] is not None or longest[2] is not None else rows
            some.select(record.alias("value")).write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]+", text) else None


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(.*)>", name or "")
    return _number(found[1]) if found else None


_CANDIDATE = pa.schema([
    ("file", pa.string()), ("at", pa.int64()), ("next", pa.int64()), ("type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
])
_CANDIDATE_SQL = "file string, at bigint, next bigint, type string, page_id bigint, refers_to bigint, url string, stated_digest string, stated_bytes bigint, payload_digest string, payload_bytes bigint"


def _fields(head: bytes) -> dict[str, str]:
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines if k}


def _candidates(file: str, content: bytes) -> Iterator[dict]:
    """Each magic of a file that a whole record can begin with."""
    for m in _MAGIC.finditer(content):
        end = content.find(b"\r\n\r\n", m.end() - 2)
        if end < 0:
            continue
        fields = _fields(content[m.start() : end])
        length = _number(fields.get("content-length"))
        if length is None or length < 0:
            continue
        body, after = end + 4, end + 8 + length
        if after > len(content) or content[after - 4 : after] != b"\r\n\r\n":
            continue
        http = content.find(b"\r\n\r\n", body, body + length)
        payload = http + 4 if http >= 0 else body
        stated = _number(_fields(content[body:http]).get("content-length")) if http >= 0 else None
        is_response = fields.get("warc-type") == "response"
        yield {
            "file": file, "at": m.start(), "next": after, "type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to")),
            "url": fields.get("warc-target-uri"), "stated_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha256:"), "stated_bytes": stated,
            "payload_digest": hashlib.sha256(memoryview(content)[payload : body + length]).hexdigest() if is_response else None, "payload_bytes": body + length - payload if is_response else None,
        }


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records of all files: offset, successor and what the record says."""
    small_batches(spark)
    files = archives(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                yield pa.RecordBatch.from_pylist(list(_candidates(file, content.as_py())), schema=_CANDIDATE)

    return files.select("path", "content").mapInArrow(run, _CANDIDATE_SQL)


def reachable(edges: DataFrame) -> DataFrame:
    """(file, at) of the records that pointers reach from offset 0, by pointer jumping over (file, at, next)."""
    here = edges.select("file", "at")
    jump = stored(edges.join(here.withColumnRenamed("at", "next"), ["file", "next"]).select("file", "at", "next"), "jumps")
    reached = stored(here.where("at = 0"), "reached")
    while not jump.isEmpty():
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = stored(reached.unionAll(ahead), "reached")
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = stored(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jumps")
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the archives: page_id, url, type, payload size and digest (those of the page referred to, for revisits)."""
    found = stored(candidates(spark, path), "candidates")
    kept = stored(found.join(reachable(found.select("file", "at", "next")), ["file", "at"]), "records")
    ends = kept.groupBy(F.col("file").alias("path")).agg(F.max("next").alias("end"))
    broken = archives(spark, path).select("path", "length").join(ends, "path", "left").where(F.coalesce("end", F.lit(0)) != F.col("length")).head(3)
    if broken:
        raise ValueError("records can't be followed to the end of " + ", ".join(f"{r.path} ({r.end or 0} of {r.length} bytes)" for r in broken))
    responses = kept.where("type = 'response'")
    revisits = kept.where("type = 'revisit'")
    named = responses.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    resolved = revisits.drop("payload_digest", "payload_bytes").join(named, (F.col("refers_to") == F.col("of")) & (F.col("stated_digest") == F.col("of_digest")), "left")
    columns = ["page_id", "url", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    resolved = resolved.withColumns({"payload_bytes": F.coalesce("of_bytes", "stated_bytes"), "payload_digest": F.coalesce("of_digest", "stated_digest")})
    return responses.select(*columns).unionByName(resolved.select(*columns))
