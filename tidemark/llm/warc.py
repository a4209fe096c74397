"""WARC archives: written one transaction a page, read back and assembled through concurrent-to identifiers.

Writing: every page gives a request, a response or revisit, and a metadata record that name each other by
WARC-Concurrent-To.  Of equal payloads of some size, the page with the smallest id is stored and the others revisit it.
Files are made by Spark's own writer (text with CRLF CRLF behind each record, gzip), below a number of records a file.

Reading: each file is one row; records are cut by Content-Length, so nothing in a payload can end one.  Then request
and metadata records are joined to the record they are concurrent to, and one nested row comes out for each capture.

Cases: a null html is an empty payload; payloads below ``least`` bytes are never revisits; repeated pages are captures of
their own, and of equal payloads all rows with the smallest page_id are responses; a null page_id is never referred to;
a null url is left out of the header; extra columns are not stored; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import scratch_path

LEAST = 100
#: Records in a file at most, so that a file fits in a task.
RECORDS_PER_FILE = 3000
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _record(kind: Column, ident: Column, block: Column, content: str, *lines: Column) -> Column:
    size = F.octet_length(block)
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", ident), F.lit("WARC-Date: 2024-01-01T00:00:00Z" + CRLF),
        *lines, F.lit(f"Content-Type: {content}{CRLF}"), _line("Content-Length", size), F.lit(CRLF), block,
    )


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header_safe(url: Column) -> Column:
    return F.regexp_replace(url, "[\r\n]+", " ")


def write(pages: DataFrame, path: str, least: int = LEAST, records_per_file: int = RECORDS_PER_FILE) -> str:
    """One request, response or revisit, and metadata record for each row of (page_id, url, html)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _header_safe(F.col("url").cast("string")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    large = F.col("size") >= least
    first = rows.where(large & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n"))
    first = first.where("n > 1 OR kept.page_id IS NULL").select(F.col("digest").alias("_digest"), "kept")
    # Rows that can't be revisits get a key of their own, so that they spread.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.col("page_id").cast("string"), F.lit("-"), F.xxhash64("url").cast("string")))
    joined = rows.withColumn("_digest", F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("url").cast("string")))).join(first, "_digest", "left")
    again = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("kept.page_id") < F.col("page_id")))
    rows = joined.withColumn("again", again).withColumn("row", F.monotonically_increasing_id())
    main, ask, about = (_urn(F.lit(kind), F.col("row"), F.col("page_id"), F.col("digest")) for kind in ("main", "request", "metadata"))
    target = _line("WARC-Target-URI", F.col("url"))
    digest = _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record(F.lit("response"), main, F.concat(F.lit(HTTP), F.col("html")), "application/http; msgtype=response", target, digest)
    revisit = _record(
        F.lit("revisit"), main, F.lit(HTTP), "application/http; msgtype=response", target, digest,
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
        _line("WARC-Refers-To-Target-URI", F.col("kept.url")), _line("X-Refers-To-Page", F.col("kept.page_id")),
    )
    request = _record(F.lit("request"), ask, F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)), "application/http; msgtype=request", target, _line("WARC-Concurrent-To", main))
    facts = F.concat(_line("page-id", F.col("page_id")), _line("payload-bytes", F.col("size")))
    metadata = _record(F.lit("metadata"), about, facts, "application/warc-fields", target, _line("WARC-Concurrent-To", main))
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def members(raw: bytes) -> bytes:
    """Content of a gzip file of any number of members; other bytes as they are."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        out.append(unzip.decompress(raw) + unzip.flush())
        raw = unzip.unused_data
    return b"".join(out) if out else raw


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while True:
        while archive[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(archive):
            return
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if at > len(archive):
            raise ValueError("the last record is cut off")
        yield headers, archive[start:at]


RECORD = "type string, id string, concurrent_to string, url string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record below the path."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def rows_of(archive: bytes):
        for h, block in parse(archive):
            page = size = digest = payload = None
            if h["warc-type"] == "metadata":
                fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
                page, size = number(fields.get("page-id")), number(fields.get("payload-bytes"))
            elif h["warc-type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2] if h["content-type"].startswith("application/http") else block
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if h.get("warc-payload-digest", f"sha256:{digest}") != f"sha256:{digest}":
                    raise ValueError(f"payload of {h['warc-record-id']} doesn't have its digest")
            elif h["warc-type"] == "revisit":
                digest = h["warc-payload-digest"].removeprefix("sha256:")
            yield (h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), page, size, digest, number(h.get("x-refers-to-page")), payload if with_payload else None)

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                found = list(rows_of(members(raw.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit with the request and metadata concurrent to it."""
    whole = lambda kind: records.where(F.col("type") == kind)
    main = records.where(F.col("type").isin("response", "revisit")).select("id", F.struct(*records.columns).alias("main"))
    ask = whole("request").select(F.col("concurrent_to").alias("id"), F.struct("id", "url").alias("request"))
    about = whole("metadata").select(F.col("concurrent_to").alias("id"), F.struct("id", "page_id", "payload_bytes").alias("metadata"))
    return main.join(ask, "id", "left").join(about, "id", "left").select("main", "request", "metadata")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives, reads them back and gives the digest of each capture."""
    spark = pages.sparkSession
    path = write(pages, path or scratch_path(spark, "warc"))
    found = captures(read(spark, path, with_payload=False))
    return found.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("main.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        F.col("main.refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""
