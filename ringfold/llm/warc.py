"""WARC archives written by Spark, and read back along verified record boundaries.

Writing: each page becomes one record; Spark's text writer puts the records into archives with a
blank line after each. Pages with equal payloads become one response, that with the largest id, and
revisits of it.

Reading: tasks look for the magic anywhere in an archive and emit from each candidate the offset of
its successor, which the candidate's own length gives. Pointer jumping from offset 0 then keeps
what is reachable, so magic inside a payload is no record. The chain must end at the archive's end.

Defined results: a null payload is empty; a null id gives a record whose id reads back as null, and
such rows are revisits where another row has the payload; several rows of the largest id are all
responses; line breaks are dropped from urls; an empty table gives archives without records.
Pages are written by classes of size, so that an archive has 256 MB at most, or one page that is larger
than 4 MB; a reader holds one archive at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, stored

#: Fixed values of the format (WARC 1.1, RFC 4648).
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_BREAK = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of up to so many bytes, and how many of them an archive holds at most.
CLASSES: tuple[tuple[int, int], ...] = ((64 << 10, 4096), (4 << 20, 64), (1 << 62, 1))
_LENGTH = re.compile(rb"(?i)\r\n[ \t]*content-length[ \t]*:[ \t]*(\d+)[ \t]*(?=\r\n)")
_EDGES = T.StructType().add("path", "string").add("at", "long").add("next", "long").add("length", "long")
_TEXTS = ("record_id", "url", "record_type", "refers_to", "payload_digest")
_CANDIDATE = pa.schema(
    [("path", pa.string()), *((k, pa.int64()) for k in ("at", "next", "length"))]
    + [(k, pa.string()) for k in _TEXTS]
    + [(k, pa.int64()) for k in ("payload_at", "payload_end", "payload_bytes")]
)
_CANDIDATE_SQL = (
    "path string, at long, next long, length long, record_id string, url string, record_type string, refers_to string, "
    "payload_digest string, payload_at long, payload_end long, payload_bytes long"
)


def base32(digest: Column) -> Column:
    """Of a SHA-1 digest in hex the upper-case base32: of each 20 bits four digits of five."""
    digits = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*digits)


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    compressor = zstandard.ZstdCompressor(level=9)
    return pa.array([compressor.compress(t.as_buffer()) for t in texts.cast(pa.large_binary())], pa.binary())


@F.arrow_udf(T.StringType())
def unpacked(data: pa.Array) -> pa.Array:
    decompressor = zstandard.ZstdDecompressor()
    return pa.array([decompressor.decompress(d.as_buffer()) for d in data], pa.binary()).cast(pa.string())


def write(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    classes: tuple[tuple[int, int], ...] = CLASSES,
) -> None:
    """Write a record for each of pages to archives under path; payloads from least_bytes up are revisited."""
    rows = pages.select(
        pages[page_id].cast("long").alias("id"),
        F.regexp_replace(F.coalesce(pages[url].cast("string"), F.lit("")), "[\r\n]", "").alias("url"),
        F.coalesce(pages[html].cast("string"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    sizes = rows.select("bytes")
    first = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("first"))
    # Payloads meet the answer compressed, as they are most of what moves.
    rows = rows.withColumn("payload", packed(F.col("payload"))).join(first, "sha1", "left")
    rows = rows.withColumn("payload", unpacked(F.col("payload"))).withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    )

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit(_BREAK))

    def urn(of: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(of).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}"),
        line("Content-Length", F.col("bytes").cast("string")),
        F.lit(_BREAK),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    record = F.concat(
        F.lit(f"WARC/1.1{_BREAK}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.lit("sha1:"), base32(F.col("sha1"))),
        F.when(
            F.col("revisit"), F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", urn("first")))
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(_BREAK),
        F.col("block"),
    )
    lower = [-1, *(upper for upper, _ in classes[:-1])]
    inside = [(F.col("bytes") > a) & (F.col("bytes") <= b) for a, (b, _) in zip(lower, classes)]
    counts = sizes.agg(*(F.count(F.when(x, 1)) for x in inside)).first()
    for part, n, (_, most) in zip(inside, counts, classes):
        if n or part is inside[0]:  # an empty table has an archive, too
            (
                rows.where(part)
                .withColumn("block", block)
                .select(record.alias("value"))
                .write.mode("append")
                .option("lineSep", 2 * _BREAK)
                .option("maxRecordsPerFile", most)
                .text(path)
            )


def _head(content: bytes, at: int, limit: int) -> tuple[dict[str, str], int] | None:
    """The fields of the head at that offset, which ends before limit, and where; None if it is no head."""
    end = content.find(b"\r\n\r\n", at, limit)
    if end < 0:
        return None
    lines = content[at:end].decode("utf-8", "replace").split(_BREAK)[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _heads(data: bytes) -> dict[int, tuple[int, int]]:
    """Of each offset with the magic and a head, however long, the stated length and where the head ends."""
    found = {}
    end, length_at, length = -1, -1, 0
    for m in _MAGIC.finditer(data):
        at = m.start()
        if at > end:  # magics before the same blank line share it and the last length before it
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                break
            length_at = -1
            for stated in _LENGTH.finditer(data, at, end + 2):
                length_at, length = stated.start(), int(stated[1])
        if length_at >= at:
            found[at] = length, end + 4
    return found


def _record(path: str, data: bytes, at: int, end: int) -> dict:
    """What the record at that offset says; its payload's digest is computed, and must be the stated one."""
    fields, body = _head(data, at, len(data))
    http = _head(data, body, end)
    start = http[1] if http else body
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    size = end - start
    if kind == "revisit":
        start = end = None
        size = int(http[0]["content-length"]) if http else None
    else:
        found = base64.b32encode(hashlib.sha1(memoryview(data)[start:end]).digest()).decode()
        if digest and found != digest:
            size = None  # told apart in read(): only then is it known to be a record
        digest = digest or found
    return {
        "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": fields.get("warc-refers-to"), "payload_digest": digest,
        "payload_at": start, "payload_end": end, "payload_bytes": size,
    }


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads are only digested where the successor is a candidate too or the archive's end."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py()
            heads = _heads(data)
            rows = []
            for at, (length, body) in heads.items():
                following = min(body + length + 4, 1 << 62)
                row = {"path": path, "at": at, "next": following, "length": len(data)}
                if following in heads or following == len(data):
                    row |= _record(path, data, at, body + length)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_CANDIDATE)


def reachable(edges: DataFrame) -> DataFrame:
    """The (path, at) that a chain of edges (path, at, next, length) from offset 0 reaches.

    Pointer jumping: in a round all reached offsets jump and all pointers double, so that a chain
    of n records takes log2(n) rounds. A round's new offsets lie behind all that were reached.
    """
    known = edges.select("path", "at")
    pointers = edges.select("path", "at", "next")
    reached = known.where("at = 0")
    while True:
        jumped = reached.join(pointers, ["path", "at"]).select("path", F.col("next").alias("at"))
        ahead = stored(jumped.join(known, ["path", "at"], "left_semi"), "reached")
        if ahead.isEmpty():
            return reached
        reached = reached.union(ahead)
        hop = pointers.select("path", F.col("at").alias("next"), F.col("next").alias("after"))
        pointers = stored(pointers.join(hop, ["path", "next"]).select("path", "at", F.col("after").alias("next")), "pointers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under path, with where in the archive their payloads lie."""
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    candidates = stored(archives.mapInArrow(_candidates, _CANDIDATE_SQL), "boundaries")
    # While pointers jump, an archive is known by a 64-bit hash of its path.
    candidates = candidates.withColumn("archive", F.xxhash64("path"))
    kept = stored(reachable(candidates.select(F.col("archive").alias("path"), "at", "next")), "records")
    records = candidates.join(kept.withColumnRenamed("path", "archive"), ["archive", "at"], "left_semi")
    # The files themselves say which archives there are: one without a candidate is broken, too.
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = files.join(records.groupBy("path").agg(F.max("next").alias("next")), "path", "left")
    if broken := last.where("length > 0 and (next is null or next != length)").first():
        raise ValueError(f"{broken.path}: the chain of records does not end at the archive's end")
    if wrong := records.where("record_type != 'revisit' and payload_bytes is null").first():
        raise ValueError(f"{wrong.path}: the payload at {wrong['at']} does not have the digest in its record")
    return records.drop("next", "length", "archive").withColumnRenamed("at", "offset")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "offset", "payload"]
    for batch in batches:
        for path, content, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = content.as_py()
            for start in range(0, len(spans), 256):
                rows = [(path, s["offset"], data[s["a"] : s["b"]]) for s in spans[start : start + 256]]
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def payloads(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """(path, offset, payload) of records from read(path) that have one; archives move to their records."""
    spans = records.where("payload_at is not null").groupBy("path").agg(
        F.collect_list(F.struct("offset", F.col("payload_at").alias("a"), F.col("payload_end").alias("b"))).alias("spans")
    )  # bounded by the archive
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.join(spans, "path").select("path", "content", "spans").mapInArrow(
        _cut, "path string, offset long, payload binary"
    )


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's rows: write pages, read the archives back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path).select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p JOIN m USING (h)
"""
