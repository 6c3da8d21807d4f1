"""Operator 5, WARC: writing archives, and reading them with segment reassembly.

Writing: one record for each page, as a chunked HTTP response; a payload that another page with a
smaller id already has becomes a revisit, which names the response's record. A block longer than `segment_bytes` is written
as a first segment and continuation records. Archives are gzip files of WARC/1.1 records and about `archive_bytes` of payload, made by
Spark's own text writer (records are valid UTF-8, the record separator is the line separator), so they go to any
file system that Spark can write, and a lost task's file is written again whole. That writer makes one gzip member of a
file, not one of each record.

Only ids and digests are compared to find equal payloads; pages are joined with the result by their own key, so a payload
that many pages share is no task's alone.

Reading: records are cut by Content-Length; continuation records are grouped by origin identifier,
ordered by segment number, checked against the total length, and the chunked framing is decoded. A revisit must name a
response that is there and has its digest.

Defined cases: a null payload is empty; a null url has no WARC-Target-URI; a null id is larger than
any other; rows that repeat a response's id and payload are responses themselves; other rows are records of their own, also
where page_ids repeat; a very long payload is held alone, in segments; an empty table gives an archive without records; other
columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches, keyed
from tabulon.sources.shared import new_folder, written

SEPARATOR = "\r\n\r\n"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing with chunks of about size bytes that end at whole characters."""
    out, at = [], 0
    while at < len(payload):
        end = whole(payload, min(len(payload), at + size), at)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def whole(data: bytes, end: int, start: int) -> int:
    """The last place up to end, but after start, where a character of UTF-8 begins."""
    cut = end
    while cut > start and cut < len(data) and data[cut] & 0xC0 == 0x80:
        cut -= 1
    if cut > start:
        return cut
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    return end


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        if len(out[-1]) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + size


def head(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: 2000-01-01T00:00:00Z"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()


def record_name(page_id: int | None, row_key: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{row_key}"


def page_records(page_id: int | None, row_key: int, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, without the closing separator. A revisit needs no payload, but its size, its digest and the response's record."""
    record_id = record_name(page_id, row_key)
    common = {"WARC_Target_URI": None if url is None else " ".join(url.split()), "WARC_Payload_Digest": f"sha256:{digest}"}
    start = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = f"{start}Content-Length: {size}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield head("revisit", record_id, block, **common, WARC_Profile=profile, WARC_Refers_To=f"<{refers_to}>") + block
        return
    block = f"{start}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield head("response", record_id, block, **common) + block
        return
    at, number = 0, 1
    while at < len(block):
        end = whole(block, min(len(block), at + segment_bytes), at)
        part, total = block[at:end], str(len(block)) if end == len(block) else None
        own = record_id if number == 1 else f"{record_id}:{number}"
        more = common if number == 1 else {"WARC_Segment_Origin_ID": f"<{record_id}>"}
        yield head("response" if number == 1 else "continuation", own, part, **more, WARC_Segment_Number=str(number), WARC_Segment_Total_Length=total) + part
        at, number = end, number + 1


def write_archives(pages: DataFrame, path: str, least: int = 100, segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, archive_bytes: int = 64 << 20) -> None:
    """Pages (page_id, url, html) as gzipped archives in the folder path; payloads from `least` bytes on are written once."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages, _ = keyed(pages, "page_id", "html")
    slim = written(pages.select("row_key", "page_id", F.octet_length("html").alias("__size"), F.sha2("html", 256).alias("__sha")), "digests")
    # row_keys are in the order of page_ids
    firsts = slim.filter(F.col("__size") >= least).groupBy("__sha").agg(F.min("row_key").alias("__key"), F.count("*").alias("__n")).filter("__n > 1")
    firsts = firsts.join(slim.select(F.col("row_key").alias("__key"), F.col("page_id").alias("__page")), "__key").select("__sha", "__key", "__page")
    again = slim.filter(F.col("__size") >= least).join(firsts, "__sha").filter(~F.col("page_id").eqNullSafe(F.col("__page")))
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("__page").cast("string"), F.lit("")), F.col("__key").cast("string"))
    again = again.select("row_key", name.alias("refers_to"))
    decided = pages.join(slim.drop("page_id").join(again, "row_key", "left"), "row_key")
    decided = decided.select("page_id", "row_key", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "__size", "__sha", "refers_to")
    facts = slim.agg(F.sum("__size").alias("bytes"), F.count("*").alias("n")).first()
    mean = (facts["bytes"] or 0) / max(1, facts["n"]) + 500

    def records(batches):
        for batch in batches:
            out, held = [], 0
            for row in zip(*batch.columns, strict=True):
                page_id, row_key, url, html, size, digest, refers_to = (x.as_py() for x in row)
                for r in page_records(page_id, row_key, url, (html or "").encode(), size, digest, refers_to, segment_bytes, chunk_bytes):
                    out.append(r.decode())
                    held += len(r)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    writer = decided.transform(in_batches(records, "value string")).write.option("lineSep", SEPARATOR).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, int(archive_bytes / min(mean, segment_bytes)))).text(path)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, cut by Content-Length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        if len(block := stream.read(size)) != size:
            raise ValueError("a record is cut short")
        yield fields, block


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    top, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in top.lower() else body


def verified(payload: bytes, digest: str) -> tuple[int, str]:
    found = hashlib.sha256(payload).hexdigest()
    if found != digest.rpartition(":")[2]:
        raise ValueError(f"a payload's digest is {found}, not {digest}")
    return len(payload), found


ROW = "record_id string, page_id long, record_type string, refers_to string, payload_bytes long, payload_digest string, segment int, total long, data binary"


DONE = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id) of each response and revisit in the folder path."""

    def page(urn: str) -> int | None:
        number = urn.strip("<>").split(":")[2]
        return int(number) if number else None

    def rows(batches):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in ROW.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                out: list[tuple] = []
                held = 0
                for fields, block in parsed(gzip.GzipFile(fileobj=raw) if raw.getvalue()[:2] == b"\x1f\x8b" else raw):
                    kind, own = fields["warc-type"], fields["warc-record-id"].strip("<>")
                    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                    origin = fields.get("warc-segment-origin-id", own).strip("<>")
                    digest = fields.get("warc-payload-digest")
                    if number:
                        first = kind == "response"
                        out.append((origin, page(own) if first else None, kind if first else None, None, None, digest, int(number), int(total) if total else None, block))
                        held += len(block)
                    elif kind == "revisit":
                        http = dict(x.lower().split(b": ", 1) for x in block.split(b"\r\n")[1:] if b": " in x)
                        out.append((own, page(own), kind, fields["warc-refers-to"].strip("<>"), int(http[b"content-length"]), digest.rpartition(":")[2], None, None, None))
                    elif kind == "response":
                        out.append((own, page(own), kind, None, *verified(payload_of(block), digest), None, None, None))
                    if held > 8 << 20 or len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(9)], names=names)
                        out, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(9)], names=names)

    def joined(batches):
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                size, digest = row["payload_bytes"], row["payload_digest"]
                if parts := row["parts"]:
                    numbers = [p["segment"] for p in parts]
                    block = b"".join(p["data"] for p in parts)
                    if numbers != list(range(1, len(parts) + 1)) or row["total"] != len(block):
                        raise ValueError(f"segments {numbers} of {row['record_id']} hold {len(block)} of {row['total']} bytes")
                    size, digest = verified(payload_of(block), digest)
                done.append((row["record_id"], row["page_id"], size, digest, row["record_type"], row["refers_to"]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds[i]) for i in range(6)], names=[x.split()[0] for x in DONE.split(", ")])

    found = spark.read.format("binaryFile").load(path).select("content").transform(in_batches(rows, ROW))
    first = [F.max(c).alias(c) for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "total")]
    parts = F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "data")))).alias("parts")
    found = written(found.groupBy("record_id").agg(*first, parts).transform(in_batches(joined, DONE)), "records")
    targets = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"))
    both = found.join(targets, "refers_to", "left")
    lost = (F.col("record_type") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("__digest"))
    kind = F.when(lost, F.raise_error(F.concat(F.lit("no response with its digest for the revisit "), "record_id"))).otherwise(F.col("record_type"))
    return both.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), F.col("__page").alias("refers_to"))


def warc_round_trip(pages: DataFrame, least: int = 100, segment_bytes: int = 32 << 10) -> DataFrame:
    """Write pages to archives in the shared folder, then read them back."""
    path = new_folder(pages.sparkSession, "warc")
    write_archives(pages, path, least, segment_bytes)
    return read_archives(pages.sparkSession, path)
