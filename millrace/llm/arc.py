"""Conversion of legacy ARC archives to WARC, and archives in WARC written and read.

An ARC archive is a run of records, each a header line, as many bytes as the line declares, and a line
feed. A first record named filedesc:// holds the version on which the fields of later header lines depend
(five in version 1, ten in version 2). The converter reads header lines by the version in force, takes
the declared bytes, and makes a WARC record of each: an identifier from its address and date, a timestamp
in ISO form, a type, and digests of block and payload. A record whose payload another record holds
becomes a revisit of that one.

Nulls: a null payload is empty, a null address is written as ``unknown:``, a null page_id stays null (and
sorts below all others). Rows that repeat the largest page_id of a payload are all responses. Empty tables
give archives without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import join_small, new_path, stored, table

#: Fields of a header line, by version of the archive; fixed by the format.
FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"),
}
SPACE_NAMES = str.maketrans({c: f"%{ord(c):02X}" for c in "\0\t\n\x0b\x0c\r "})
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"


@dataclass
class ArcRecord:
    version: bytes
    fields: dict[str, str]
    content: bytes


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(version: bytes, url: str, date: str, kind: str, length: int, code: int = 200, offset: int = 0) -> bytes:
    if version == b"1":
        return f"{url} 0.0.0.0 {date} {kind} {length}\n".encode()
    return f"{url} 0.0.0.0 {date} {kind} {code} - - {offset} part.arc {length}\n".encode()


def arc_opening(version: bytes, date: str) -> bytes:
    """The version block of an archive: its own record, which describes the fields of later header lines."""
    names = {b"1": "URL IP-address Archive-date Content-type Archive-length", b"2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = version + b" 0 millrace\n" + names.encode() + b"\n"
    return arc_line(version, "filedesc://part.arc", date, "text/plain", len(body)) + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an archive, or of archives one after the other, without the version blocks."""
    at, version = 0, b"1"
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].split(b" ")
        begins = line[0].startswith(b"filedesc://")
        if begins:  # its own line has the fields of its own version, so the length is the last of the line
            size = int(line[-1])
            version = data[stop + 1 : stop + 1 + size].split(b" ", 1)[0]
            if version not in FIELDS:
                raise ValueError(f"unknown archive version {version!r}")
        else:
            names = FIELDS[version]
            if len(line) != len(names):
                raise ValueError(f"header line of {len(line)} fields; version {version.decode()} has {len(names)}")
            size = int(line[-1])
        body = data[stop + 1 : stop + 1 + size]
        if len(body) != size:
            raise ValueError("the archive ends inside a record")
        at = stop + 1 + size
        if not begins:
            yield ArcRecord(version, dict(zip(names, (x.decode() for x in line), strict=True)), body)


def warc_head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(key: str) -> str:
    """Of a page by its page_id, so that others can refer to it; of other records by address and date."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(key.encode()).digest()[:16], version=5)}>"


def to_warc(record: ArcRecord, revisits: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the end of record. revisits: page_id of the record that holds
    the same payload."""
    f = record.fields
    head, gap, payload = record.content.partition(END)
    http = record.content.startswith(b"HTTP/") and bool(gap)
    payload = payload if http else record.content
    key = next((x[11:].decode() for x in head.split(b"\r\n") if x.startswith(b"X-Page-Id: ")), "") if http else ""
    block = head + END if revisits else record.content
    fields = [
        ("WARC-Type", "revisit" if revisits else "response" if http else "resource"),
        ("WARC-Target-URI", f["url"]),
        ("WARC-Date", warc_date(f["date"])),
        ("WARC-Record-ID", record_id(key or f"{f['url']} {f['date']}")),
        ("WARC-IP-Address", f["ip"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response" if http else f["type"]),
    ]
    if revisits:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(revisits)), ("X-Refers-To-Page-Id", revisits)]
    return warc_head([*fields, ("Content-Length", str(len(block)))]) + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        lines = data[at:stop].decode().split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        at = stop + 4 + size + 4
        if data[at - 4 : at] != END:
            raise ValueError("a record doesn't end where its length says")
        yield fields, data[stop + 4 : stop + 4 + size]


def legacy(page_id, url: str | None, html: str | None, version: bytes, date: str) -> bytes:
    """An ARC record of a page, as a crawler would have stored it."""
    payload = (html or "").encode()
    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n".encode() + payload
    return arc_line(version, (url or "unknown:").translate(SPACE_NAMES), date, "text/html", len(content)) + content + b"\n"


def convert_pages(pages: DataFrame, version: str = "1", date: str = "19960101000000", min_bytes: int = 0, records_per_file: int = 5000) -> str:
    """Stores each page in a legacy archive, converts the archives, writes WARC files; returns their folder.

    Only digests and identifiers are shuffled to find equal payloads. The table of payloads that come more than once
    is broadcast if it is counted to be small; else pages are joined with it by a shuffle.
    """
    mine = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    sums = mine.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    sizes = sums.select("page_id", "sha", F.octet_length("html").alias("n")).filter(F.col("n") >= min_bytes)
    shared = sizes.groupBy("sha").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("times")).filter("times > 1 and holder is not null")
    shared = stored(shared.select(F.col("sha").alias("sha_of"), "holder"), "payloads")
    n = shared.count()
    marked = join_small(sums, shared, F.col("sha") == F.col("sha_of"), "left", n)
    marked = marked.withColumn("holder", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("holder")), F.col("holder")))
    which = version.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts, holders = (batch.column(i) for i in range(4))
            out: list[bytes] = []
            size = 0
            for i in range(batch.num_rows):
                page_id, holder = ids[i].as_py(), holders[i].as_py()
                # One archive per record keeps memory to a page; read_arc takes any number of them.
                archive = arc_opening(which, date) + legacy(page_id, urls[i].as_py(), texts[i].as_py(), which, date)
                for record in read_arc(archive):
                    out.append(to_warc(record, None if holder is None else str(holder)))
                    size += len(out[-1])
                if size > 16_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    path = new_path(pages.sparkSession, "warc")
    records = marked.select("page_id", "url", "html", "holder").mapInArrow(run, "record binary")
    # A record ends with two line ends: the separator of the text writer, which writes bytes as they are.
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", records_per_file).option("compression", "none").text(path)
    return path


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files in a folder. A response's payload is digested again and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for fields, block in read_warc(content.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(END)
                    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(payload) != said:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page, holder = http.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), int(http["Content-Length"]) if revisit else len(payload), said, fields["WARC-Type"], holder and int(holder)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_index(spark, convert_pages(table(spark, sf_dir, "pages")))


QUERIES = {"op7_arc": op7_arc}
ORACLE: dict[str, str] = {}
