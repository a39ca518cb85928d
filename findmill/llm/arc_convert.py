"""Legacy web archives: ARC files are parsed and rewritten as WARC files, and WARC files read back.

An ARC file begins with a version block that names the fields of its header lines (version 1 has five,
version 2 ten); each record is a header line, a block of the declared length and a line feed. Records are
found by declared lengths alone, so payloads may hold anything. Each becomes a WARC record with a
synthetic identifier (from archive and offset, so a repeated task makes the same one), timestamp, type
and SHA-1 digests. Of records with equal payloads one is the response; the others become revisits.

Files are written by Spark's own text writer, one archive a row and a file: any shared store works, and a
lost executor only repeats its tasks. No group of equal payloads is gathered: digests are aggregated before
the shuffle, and what each archive has to change goes back to it as one short list. While these lists are
below Spark's broadcast threshold archives are not shuffled; beyond it each (compressed) archive moves once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.llm.common import arrow_map, beside, read_table, utf8, work_path, written

ARCHIVE_BYTES = 1 << 23
#: The header fields of both versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ROW_HEADER = b"X-Archive-Row"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:findmill:arc")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC ---------------------------------------------------------------------------------------------


def arc_header(version: int, url: bytes, date: bytes, mime: bytes, length: int) -> bytes:
    """One header line; what version 2 adds is written as unknown ('-')."""
    middle = b" 200 - - 0 -" if version == 2 else b""
    return b"%s 0.0.0.0 %s %s%s %d\n" % (_UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url), date, mime, middle, length)


def arc_start(version: int, name: bytes, date: bytes) -> bytes:
    body = b"%d 0 findmill\n%s\n" % (version, FIELDS[version].encode())
    return arc_header(version, b"filedesc://" + name, date, b"text/plain", len(body)) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """(offset, header fields, block) of each record, the version block included."""
    at, fields = 0, FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} does not end")
        parts = data[at:end].strip().split(b" ")
        length = int(parts[-1])
        block = data[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        if at == 0:
            if not parts[0].startswith(b"filedesc://"):
                raise ValueError("an ARC file begins with filedesc://")
            fields = block.split(b"\n")[1].decode().split()
        # A URL with spaces has more parts: the other fields count from the right.
        extra = len(parts) - len(fields)
        if extra < 0 and at:
            raise ValueError(f"header line at {at} has {len(parts)} of {len(fields)} fields")
        header = dict(zip(fields[1:], parts[extra + 1 :])) if extra >= 0 else {"Archive-date": parts[2]}
        header["URL"] = b"%20".join(parts[: extra + 1]) if extra >= 0 else parts[0]
        yield at, header, block
        at = end + 1 + length
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its empty line, payload) of an HTTP response; None for other blocks."""
    if not block.startswith(b"HTTP/"):
        return None
    head, gap, payload = block.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else None


def _head_value(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else None


def _row_of(head: bytes) -> int | None:
    value = _head_value(head, ROW_HEADER)
    return int(value) if value else None


def write_arc(
    pages: DataFrame, path: str, id_col: str, url_col: str, body_col: str, date: str = "20240101000000",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """ARC files of about ``archive_bytes``, versions 1 and 2 by turns, with an HTTP response a row.

    A null body is empty, a null URL is replaced by one made of the id. The id goes into the HTTP head.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        task = TaskContext.get().partitionId()  # so that small runs write both versions too
        size = n = 0
        stamp = date.encode()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for row, url, body in zip(*batch.columns):
                row, body = row.as_py(), body.as_py()
                url = (url.as_py() or f"urn:page:{row}").encode()
                version = 1 + (task + n) % 2
                if not parts:
                    parts.append(arc_start(version, b"part-%d.arc" % n, stamp))
                own = b"" if row is None else b"%s: %d\r\n" % (ROW_HEADER, row)
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), own)
                record = [arc_header(version, url, stamp, b"text/html", len(head) + len(body)), head, body, b"\n"]
                parts += record
                size += sum(map(len, record))
                if size >= archive_bytes:
                    yield flush()
                    parts.clear()
                    size, n = 0, n + 1
        if parts:
            yield flush()

    given = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), utf8(F.col(body_col)))
    _write_archives(given.mapInArrow(run, "value binary"), path)


def _write_archives(archives: DataFrame, path: str) -> None:
    """One file for each row; the writer's line end is the last byte of the archive."""
    (
        archives.select(F.col("value").cast("string"))
        .write.option("maxRecordsPerFile", 1)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path)
    )


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the archive files below ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _opened(content: bytes) -> bytes:
    return gzip.decompress(content) if content.startswith(b"\x1f\x8b") else content


def record_id(path: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{path}#{offset}')}"


def scan_arc(found: DataFrame) -> DataFrame:
    """(path, offset, record, row_id, url, date, bytes, digest) of the HTTP responses in ARC files."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, content in zip(*batch.columns):
            path = path.as_py()
            for offset, header, block in parse_arc(_opened(content.as_py())):
                if http := split_http(block):
                    date, url = header["Archive-date"].decode(), header["URL"].decode("utf-8", "replace")
                    rows.append((path, offset, record_id(path, offset), _row_of(http[0]), url, date, len(http[1]), digest_of(http[1])))
        names = ["path", "offset", "record", "row_id", "url", "date", "bytes", "digest"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "path string, offset long, record string, row_id long, url string, date string, bytes long, digest string"
    return arrow_map(found, schema, per_batch)


# --- WARC --------------------------------------------------------------------------------------------


def _timestamp(date: str) -> str:
    date = (date + "00000101000000"[len(date) :])[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_arc(path: str, data: bytes, revisits: dict[int, tuple[str, str, str]]) -> bytes:
    """The WARC equivalent of one ARC file. ``revisits``: offset to (record, URL, date) of the response."""
    out = []
    for offset, header, block in parse_arc(data):
        url, date = header["URL"].decode("utf-8", "replace"), _timestamp(header["Archive-date"].decode())
        fields = [("WARC-Record-ID", f"<{record_id(path, offset)}>"), ("WARC-Date", date)]
        http = split_http(block)
        if offset == 0:
            body = b"software: findmill\r\nformat: WARC File Format 1.1\r\nconverted-from: " + header["URL"] + b"\r\n"
            out.append(warc_record([("WARC-Type", "warcinfo"), *fields, ("Content-Type", "application/warc-fields")], body))
            continue
        fields.append(("WARC-Target-URI", url))
        if http is None:
            mime = header.get("Content-type", b"application/octet-stream").decode("latin-1")
            fields += [("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", mime)]
            out.append(warc_record([("WARC-Type", "resource"), *fields], block))
            continue
        head, payload = http
        fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response")]
        if offset in revisits:
            record, target, seen = revisits[offset]
            fields += [
                ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{record}>"),
                ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", _timestamp(seen)),
            ]
            out.append(warc_record([("WARC-Type", "revisit"), *fields, ("WARC-Block-Digest", f"sha1:{digest_of(head)}")], head))
        else:
            out.append(warc_record([("WARC-Type", "response"), *fields, ("WARC-Block-Digest", f"sha1:{digest_of(block)}")], block))
    return b"".join(out)


def arc_to_warc(found: DataFrame, path: str, min_bytes: int = 0) -> None:
    """WARC files at ``path`` for the ARC files (path, content) of ``found``, one for each.

    Of responses with equal payloads of at least ``min_bytes``, the one with the largest row number (then
    the largest record identifier) stays a response and the others become revisits of it.
    """
    records = written(scan_arc(found), "arc-records").where(F.col("bytes") >= min_bytes)
    first = F.max(F.struct("row_id", "record", "url", "date")).alias("first")
    kept = records.groupBy("digest").agg(first, F.count("*").alias("degree")).where("degree > 1")
    again = (
        beside(records, kept, "digest", records.count())
        .where(F.col("record") != F.col("first.record"))
        .groupBy("path")
        .agg(F.collect_list(F.struct("offset", "first.record", "first.url", "first.date")).alias("revisits"))
    )

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for source, content, revisits in zip(*batch.columns):
            listed = {x["offset"]: (x["record"], x["url"], x["date"]) for x in revisits.as_py() or ()}
            if made := convert_arc(source.as_py(), _opened(content.as_py()), listed):
                out.append(made[:-1])
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # A written table has a known size: Spark broadcasts it below its threshold and else shuffles
    # whole (compressed) archives by their path, of which each has one row.
    changed = found.join(written(again, "revisits"), "path", "left")
    _write_archives(arrow_map(changed.select("path", "content", "revisits"), "value binary", per_batch), path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        yield fields, block
        at = end + 4 + length
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def read_warc(found: DataFrame) -> DataFrame:
    """(row_id, record, type, url, date, payload_bytes, payload_digest, refers_record) of HTTP records.

    A revisit has no payload of its own: its size is what the kept HTTP head declares, its digest what
    the record declares. A response whose payload does not have the declared digest is an error.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for content in batch.column(0):
            for fields, block in parse_warc(_opened(content.as_py())):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, payload = split_http(block) or (b"", block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response":
                    size = len(payload)
                    if digest_of(payload) != digest:
                        raise ValueError(f"{fields['warc-record-id']}: payload digest does not match")
                else:
                    size = int(_head_value(head, b"Content-Length") or 0)
                refers = fields.get("warc-refers-to")
                rows.append((
                    _row_of(head), fields["warc-record-id"][1:-1], fields["warc-type"], fields["warc-target-uri"],
                    fields["warc-date"], size, digest, refers and refers[1:-1],
                ))
        names = ["row_id", "record", "type", "url", "date", "payload_bytes", "payload_digest", "refers_record"]
        text = pa.string()
        kinds = [pa.int64(), text, text, text, text, pa.int64(), text, text]
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = "row_id long, record string, type string, url string, date string, payload_bytes long, payload_digest string, refers_record string"
    return arrow_map(found.select("content"), schema, per_batch)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(``id_col``, payload_bytes, payload_digest, record_type, refers_to) as read back from WARC files.

    Null bodies are empty payloads and take part in the search for equal ones. Repeated rows are records
    of their own. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, body_col)
    arc_to_warc(archives(spark, arc), warc)
    records = written(read_warc(archives(spark, warc)), "warc-records")
    revisits = records.where("type = 'revisit'")
    counts = revisits.groupBy("refers_record").agg(F.count("*").alias("degree"))
    responses = records.where("type = 'response'")
    target = responses.select(F.col("record").alias("refers_record"), F.col("row_id").alias("refers_to")).join(counts, "refers_record")
    # Responses refer to nothing: they stay out of the join, where they would all have one key.
    none = F.lit(None).cast("long").alias("refers_to")
    found = responses.withColumn("refers_to", none).unionByName(beside(revisits, target, "refers_record", records.count()))
    return found.select(
        F.col("row_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return convert_pages(read_table(spark, sf_dir, "pages"))
