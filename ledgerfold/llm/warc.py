"""WARC archives of web pages: writing with segments, reading with reassembly.

A page becomes a response record whose block is an HTTP response in chunked
transfer framing; a block longer than a segment goes on in continuation records.
A payload that another, larger page id has as well becomes a revisit record. The
reader groups segments by the identifier of their origin, orders them by number,
verifies the total length and takes the chunks apart.

A record ends with two line breaks, which here are the text writer's separator:
files come from Spark's writer, so a lost executor leaves no half archive.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import new_path, stage
from .common import KEY, left_join_few, named, with_row_key
from .queries import ORACLES, QUERIES, table

# Fixed values of the format.
VERSION = b"WARC/1.1"
BREAK = b"\r\n"
CLOSE = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN_AT = b"2000-01-01T00:00:00Z"
LEAST_REVISIT = 1000
# Parameters: bytes of a segment, of a transfer chunk, and of payload per archive file (about).
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
FILE_BYTES = 32 * 1024 * 1024
RECORD = (
    "record_id string, record_type string, origin string, segment int, total long, page_id string, "
    "refers_to string, digest string, block binary"
)


def chunked(payload: bytes, chunk: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i:i + chunk] for i in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of chunked transfer framing, also with extensions and trailers; broken framing is an error."""
    out, at = [], 0
    while True:
        end = data.index(BREAK, at)
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size:at + size + 2] != BREAK:
            raise ValueError(f"broken transfer chunk at {at}")
        out.append(data[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(CLOSE)
    framing = [x for x in head.lower().split(BREAK) if x.startswith(b"transfer-encoding:") and b"chunked" in x]
    return unchunked(body) if framing else body


def record(fields: dict[bytes, bytes], block: bytes) -> bytes:
    """A record without its two closing line breaks."""
    lines = [VERSION, *(k + b": " + v for k, v in fields.items()), b"Content-Length: %d" % len(block)]
    return BREAK.join(lines) + CLOSE + block


def records(data: bytes):
    """(header fields by lower-cased name, block) of each record of a file; a damaged one is an error."""
    at = 0
    while at < len(data):
        end = data.index(CLOSE, at)
        first, *lines = data[at:end].split(BREAK)
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        start = end + len(CLOSE)
        stop = start + int(fields[b"content-length"])
        if data[stop:stop + len(CLOSE)] != CLOSE:
            raise ValueError(f"damaged record at {at}")
        yield fields, data[start:stop]
        at = stop + len(CLOSE)


def _write(segment: int, chunk: int):
    def page(row) -> list[bytes]:
        name = b"<urn:page:%s>" % row.name.encode()
        page_id = [] if row.page_id is None else [(b"X-Page-Id", str(row.page_id).encode())]
        fields = {
            b"WARC-Type": b"response", b"WARC-Record-ID": name, b"WARC-Date": WRITTEN_AT,
            b"WARC-Target-URI": b" ".join((row.url or "").encode().split()), **dict(page_id),
            b"WARC-Payload-Digest": b"sha1:" + row.digest.encode(),
        }
        if row.is_revisit:
            origin = b"<urn:page:%s>" % row.origin.encode()
            return [record(fields | {
                b"WARC-Type": b"revisit", b"WARC-Refers-To": origin, b"WARC-Profile": REVISIT_PROFILE}, b"")]
        block = HTTP_HEAD + chunked(row.html.encode(), chunk)
        parts = [block[i:i + segment] for i in range(0, len(block), segment)]
        if len(parts) == 1:
            return [record(fields, block)]
        out = [record(fields | {b"WARC-Segment-Number": b"1"}, parts[0])]
        for number, part in enumerate(parts[1:], 2):
            total = {b"WARC-Segment-Total-Length": b"%d" % len(block)} if number == len(parts) else {}
            out.append(record({
                b"WARC-Type": b"continuation", b"WARC-Record-ID": name[:-1] + b":%d>" % number,
                b"WARC-Date": WRITTEN_AT, b"WARC-Segment-Origin-ID": name,
                b"WARC-Segment-Number": b"%d" % number, **total}, part))
        return out

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 500):
                out = [r for row in batch.iloc[i:i + 500].itertuples(index=False) for r in page(row)]
                yield pd.DataFrame({"record": out})

    return run


def write_archives(
    pages: DataFrame, folder: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
    least_revisit: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write a record per row of `pages` to new archive files in `folder`.

    Of rows with equal payloads of at least `least_revisit` bytes, one with the
    largest id is the response (of several, the first in the stored input; a null
    id is smallest) and the others revisit it. A null html is an empty payload.
    Rows are told apart by their place in the input, so ids may be null or
    repeat. An empty table gives a folder without records. Other columns are
    ignored.
    """
    rows = with_row_key(pages).select(
        *KEY, named(id_col).cast("string").alias("page_id"), named(id_col).alias("rank"),
        named(url_col).cast("string").alias("url"), F.coalesce(named(html_col), F.lit("")).alias("html"))
    marks = stage(rows.select(
        *KEY, "rank", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("content")), "payloads")
    later_first = F.struct("rank", *(F.bitwise_not(k).alias(k) for k in KEY))
    origins = (
        marks.filter(F.col("bytes") >= least_revisit).groupBy("content")
        .agg(F.count("*").alias("n"), F.max(later_first).alias("top")).filter("n > 1")
        .select("content", *(F.bitwise_not(f"top.{k}").alias(f"origin{k}") for k in KEY))
    )
    same = (F.col(KEY[0]) == F.col(f"origin{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"origin{KEY[1]}"))
    revisits = stage(
        marks.join(origins, "content").filter(~same).select(*KEY, *(f"origin{k}" for k in KEY)), "revisits")
    typed = left_join_few(rows.drop("rank").withColumn("digest", F.sha1("html")), revisits)
    name = lambda key: F.concat_ws(":", F.lower(F.hex(key[0])), key[1])
    written = typed.select(
        name(KEY).alias("name"), "page_id", "url", "digest",
        F.col(f"origin{KEY[1]}").isNotNull().alias("is_revisit"), name([f"origin{k}" for k in KEY]).alias("origin"),
        F.when(F.col(f"origin{KEY[1]}").isNull(), F.col("html")).alias("html"),
    ).mapInPandas(_write(segment, chunk), "record binary")
    # the text writer puts out the bytes of a string as they are, and the separator after each
    written.select(F.col("record").cast("string")).write.option("lineSep", CLOSE.decode()).option(
        "maxRecordsPerFile", max(1, FILE_BYTES // segment)).text(folder)


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode()


def _verified(payload: bytes, digest: str) -> bytes:
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return payload


def _parse(segments: bool):
    """The segments of all archives, or their other records."""

    def row(fields: dict[bytes, bytes], block: bytes) -> tuple:
        name, number = fields[b"warc-record-id"], fields.get(b"warc-segment-number")
        total = fields.get(b"warc-segment-total-length")
        digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
        if number is None:
            block = _verified(payload_of(block), digest) if fields[b"warc-type"] == b"response" else None
        return (
            _text(name), _text(fields[b"warc-type"]), _text(fields.get(b"warc-segment-origin-id", name)),
            int(number or 0), int(total or 0), _text(fields.get(b"x-page-id")), _text(fields.get(b"warc-refers-to")),
            digest, block)

    def run(batches):
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                out = [row(*x) for x in records(data) if (b"warc-segment-number" in x[0]) == segments]
                for i in range(0, len(out), 500):
                    yield pd.DataFrame(out[i:i + 500], columns=names)

    return run


def _assemble(batches):
    for batch in batches:
        payloads = []
        for segments, digest in zip(batch["segments"], batch["digest"]):
            numbers = [s["segment"] for s in segments]
            block = b"".join(s["block"] for s in segments)
            if numbers != list(range(1, len(numbers) + 1)) or segments[-1]["total"] != len(block):
                raise ValueError(f"segments {numbers} with {len(block)} bytes aren't a whole record")
            payloads.append(_verified(payload_of(block), digest))
        yield batch.drop(columns="segments").assign(payload=payloads)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, record_type, page_id, refers_to, digest and payload of all records of `folder`.

    A record in segments is one row again; its segments may be in several files.
    Revisit records have no payload. Missing, repeated or short segments, broken
    framing and payloads that differ from their digest end the job. A folder
    without records gives no rows.
    """
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    columns = ["record_id", "record_type", "page_id", "refers_to", "digest"]
    whole = content.mapInPandas(_parse(False), RECORD).select(*columns, F.col("block").alias("payload"))
    segments = content.mapInPandas(_parse(True), RECORD)
    first = lambda name: F.max(F.when(F.col("segment") == 1, F.col(name))).alias(name)
    grouped = segments.groupBy("origin").agg(
        *map(first, columns), F.sort_array(F.collect_list(F.struct("segment", "total", "block"))).alias("segments"))
    fields = ", ".join(f"{c} string" for c in columns)
    return whole.unionByName(grouped.select(*columns, "segments").mapInPandas(_assemble, f"{fields}, payload binary"))


def resolved(found: DataFrame) -> DataFrame:
    """Records without payloads: record_id, record_type, page_id, payload_bytes, payload_digest, refers_to (a page id).

    A revisit has the figures of the response that it refers to.
    """
    facts = stage(found.select(
        "record_id", "record_type", "page_id", F.col("refers_to").alias("origin"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")),
        "records")
    responses = facts.filter("record_type = 'response'")
    revisits = facts.filter("record_type = 'revisit'").select("record_id", "record_type", "page_id", "origin").join(
        responses.select(
            F.col("record_id").alias("origin"), F.col("page_id").alias("refers_to"), "payload_bytes",
            "payload_digest"), "origin").drop("origin")
    return responses.drop("origin").withColumn("refers_to", F.lit(None).cast("string")).unionByName(revisits)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), folder)
    return resolved(read_archives(spark, folder)).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


QUERIES["op7_warc"] = op7_warc
ORACLES["op7_warc"] = """
SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html FROM pages) WINDOW g AS (PARTITION BY html)
"""
