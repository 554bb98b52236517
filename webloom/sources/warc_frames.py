"""Crawl files read by length (S4, P7): records framed by their Content-Length, payloads as bytes, rejects kept.

A task walks each file from header to header, without reading payloads, and
emits ranges of whole records of about ``RANGE_BYTES``; other tasks read the
ranges. So a large file is read in parallel, and text inside a payload that
looks like a record start is payload. A record is good if its length leads to
the blank lines that close a record, or to the end of the file; anything else is a
reject, and the walk goes on at the next line that starts a record.
Executors open files with Arrow's file systems.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from webloom.sources.tables import materialized

# Fixed values of the WARC format.
MAGIC = re.compile(rb"WARC/1\.[01]\r?\n")
CLOSING = re.compile(rb"\r?\n\r?\n")
HEADER_END = re.compile(rb"\r?\n\r?\n")
#: Bytes of records that one task reads at once.
RANGE_BYTES = 1 << 24
#: Bytes read to find a header, at first and at most.
PEEK, MAX_HEADER = 1 << 12, 1 << 20
#: Bytes of a reject that are kept.
SAMPLE = 200
#: Bytes of a page in which a charset declaration counts.
SNIFF = 1024

RECORD = ("path string, offset long, reject string, sample binary, trec_id string, record_type string, url string, "
          "warc_date string, http_headers string, charset string, html string, payload binary")


class _File:
    """Byte ranges of a file; reads ahead a little, so that hops between headers stay cheap."""

    def __init__(self, path: str):
        scheme, colon, name = path.partition(":")  # Spark names files unescaped
        if not colon or scheme == "file":
            system, name = fs.LocalFileSystem(), "/" + (name if colon else path).lstrip("/")
        else:
            system, name = fs.FileSystem.from_uri(f"{scheme}:{quote(name)}")
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)

    def after_breaks(self, at: int) -> int:
        """The first position from ``at`` that holds no line break."""
        while at < self.size:
            some = self.read(at, 64)
            rest = some.lstrip(b"\r\n")
            at += len(some) - len(rest)
            if rest:
                break
        return at

    def next_start(self, at: int) -> int:
        """The next position behind ``at`` at which a line starts a record, or the end."""
        while at < self.size:
            some = self.read(at, 1 << 20)
            hit = re.search(rb"\n" + MAGIC.pattern, some)
            if hit:
                return at + hit.start() + 1
            if at + len(some) >= self.size:
                break
            at += len(some) - 16
        return self.size


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _frame(file: _File, at: int) -> tuple[int, int, dict[str, str], str | None]:
    """``(payload start, end, headers, reject)`` of what stands at ``at``."""
    head, n = file.read(at, PEEK), PEEK
    if not MAGIC.match(head):
        return at, file.next_start(at), {}, "no record header"
    while not (end := HEADER_END.search(head)) and n < MAX_HEADER and at + n < file.size:
        n *= 4
        head = file.read(at, n)
    if not end:
        return at, file.next_start(at), {}, "no end of header"
    headers, start = _headers(head[:end.start()]), at + end.end()
    length = headers.get("content-length")
    if length is None or not (length.isascii() and length.isdigit()):
        return at, file.next_start(at), headers, "no length" if length is None else "length is no number"
    stop = start + int(length)
    if stop > file.size:
        return at, file.next_start(at), headers, "cut off"
    if not CLOSING.match(file.read(stop, 4)) and file.after_breaks(stop) < file.size:
        return at, file.next_start(at), headers, "length leads to no record end"
    return start, stop, headers, None


def _ranges(path: str, range_bytes: int) -> Iterator[tuple[str, int, int]]:
    """Ranges of whole records, from one record's start to another's."""
    file = _File(path)
    first = at = file.after_breaks(0)
    while at < file.size:
        at = file.after_breaks(_frame(file, at)[1])
        if at - first >= range_bytes or at >= file.size:
            yield path, first, at
            first = at


#: Encodings by their labels on the web that differ from Python's.
WEB_LABELS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252",
              "iso8859-1": "cp1252", "x-sjis": "shift_jis", "utf8": "utf-8"}
_DECLARED = re.compile(r"(?i)content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_.:-]+)")
_META = re.compile(rb"(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_.:-]+)")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def _codec(label: str | None) -> str | None:
    label = (label or "").strip().lower()
    try:
        return codecs.lookup(WEB_LABELS.get(label, label)).name if label else None
    except LookupError:
        return None


def decode_page(body: bytes, http_headers: str = "") -> tuple[str, str]:
    """``(charset, text)`` of a page: by its byte order mark, else by the declared charset of the header, else by that of the page,
    else UTF-8 if it is valid, else windows-1252. Bytes that the charset lacks become replacement characters."""
    for mark, name in _MARKS:
        if body.startswith(mark):
            return name, body[len(mark):].decode(name, "replace")
    declared, meta = _DECLARED.search(http_headers or ""), _META.search(body[:SNIFF])
    name = _codec(declared and declared[1])
    if name is None and meta:  # a page whose declaration can be read as ASCII is not UTF-16
        name = _codec(meta[1].decode("ascii"))
        name = "utf-8" if name and name.startswith("utf-16") else name
    if name:
        return name, body.decode({"utf-16": "utf-16-le"}.get(name, name), "replace")
    try:
        return "utf-8", body.decode("utf-8")
    except UnicodeDecodeError:
        return "cp1252", body.decode("cp1252", "replace")


def _record(path: str, file: _File, at: int) -> tuple[int, tuple]:
    start, stop, h, reject = _frame(file, at)
    http, charset, html, payload = None, None, None, None
    if reject is None:
        payload = file.read(start, stop - start)
        kind = h.get("warc-type")
        if kind is None:
            reject = "no type"
        elif kind == "response":
            end = HEADER_END.search(payload)
            if not end or not payload.startswith(b"HTTP/"):
                reject = "no HTTP header"
            else:
                http, payload = payload[:end.start()].decode("latin-1"), payload[end.end():]
                charset, html = decode_page(payload, http)
    sample = None if reject is None else file.read(at, SAMPLE)
    row = (path, at, reject, sample, h.get("warc-trec-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"),
           http, charset, html, None if reject else payload)
    return file.after_breaks(stop), row


def read_frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the files under ``path``, and every reject with its reason (``reject``) and first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                for r in _ranges(name, range_bytes):
                    yield pa.record_batch([[x] for x in r], names=["path", "start", "stop"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), *[pa.string()] * 7, pa.binary()]
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        for b in batches:
            for name, at, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                file = _File(name)
                while at < stop:
                    at, row = _record(name, file, at)
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    # one file a task, then one range a task at most
    ranges = materialized(files.repartition("path").mapInArrow(walk, "path string, start long, stop long"), "warc-ranges")
    return ranges.repartition("path", "start").mapInArrow(read, RECORD)


def read_warc_files(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """S4 + P7 in one pass: the crawl table, the table of rejects, and the counts of records and of rejects by reason.

    ``crawl(path, trec_id, record_type, url, warc_date, http_headers, charset, html, payload)``;
    ``html`` is null for records that are no responses. The counts are observed while the records are written.
    """
    reasons = ("no record header", "no end of header", "no length", "length is no number", "cut off", "length leads to no record end",
               "no type", "no HTTP header")
    seen = Observation("warc")
    observed = read_frames(spark, path, range_bytes).observe(
        seen, F.count_if(F.col("reject").isNull()).alias("records"),
        *(F.count_if(F.col("reject") == r).alias(r) for r in reasons))
    table = materialized(observed, "warc-records")
    crawl = table.filter("reject IS NULL").select(
        "path", "trec_id", "record_type", "url", F.try_to_timestamp("warc_date").alias("warc_date"), "http_headers", "charset", "html", "payload")
    rejects = table.filter("reject IS NOT NULL").select("path", "offset", F.col("reject").alias("reason"), "trec_id", "sample")
    return crawl, rejects, {k: v for k, v in seen.get.items() if v or k == "records"}


def format_records(pages: DataFrame, charset: str | None = None, id_prefix: str = "clueweb12-") -> DataFrame:
    """One response record (binary, without the closing blank line) per page (page_id, url, html).

    ``charset`` names a column of ``pages`` with the page's encoding, declared in its header: UTF-8, ISO-8859-1 or UTF-16 with a byte order mark.
    """
    label = F.col(charset) if charset else F.lit("UTF-8")
    body = F.encode("html", "UTF-8")
    if charset:
        body = F.when(label == "ISO-8859-1", F.encode("html", "ISO-8859-1")).when(label == "UTF-16", F.encode("html", "UTF-16")).otherwise(body)

    def text(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary")

    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=", label, "\r\nContent-Length: ",
                F.octet_length(body).cast("string"), "\r\n\r\n")
    payload = F.concat(http, body)
    head = text("WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: 2012-02-12T09:08:06Z\r\nWARC-TREC-ID: ", id_prefix,
                F.col("page_id").cast("string"), "\r\nWARC-Target-URI: ", F.coalesce("url", F.lit("")),
                "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ",
                F.octet_length(payload).cast("string"), "\r\n\r\n")
    return pages.select("page_id", F.concat(head, payload).alias("record"))


def write_records(records: DataFrame, out: str) -> None:
    """Write ``record`` bytes as crawl files, one per task: the text sink writes a string's bytes as they are."""
    records.select(F.concat("record", F.encode(F.lit("\r\n"), "UTF-8")).cast("string").alias("value")).write.option(
        "lineSep", "\r\n").text(out)
