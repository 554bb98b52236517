"""WARC archives: writing pages as records, and reading them back by boundary-chain verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import written

#: Bytes of an archive whose records are chained at once, and how many such chunks a task looks through.
CHUNK_BYTES = 1 << 20
CHUNKS_PER_TASK = 4
#: Payloads of fewer bytes are written again rather than referred to.
MIN_REVISIT_BYTES = 100
CRAWL_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes after which a reading task hands on the records it holds.
FLUSH_BYTES = 8 << 20

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC_BYTES = 10
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")
TRAILER = b"\r\n\r\n"

RECORD = ("path string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
          "digest string, http_length long, payload binary")


def records(pages: DataFrame, min_revisit: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(value)``: the record of each row of ``pages(page_id, url, html)``, without its trailing blank lines.

    Of the rows whose payloads are equal and have at least ``min_revisit``
    bytes, those with the smallest page_id are responses, the others revisits
    that refer to it and carry no payload. A null html is an empty payload, a
    null url is written as ``about:blank``; rows without page_id come after all
    others. Repeated rows each give a record. Shared digests are written first, so
    that Spark knows their size before it shuffles payloads to meet them.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]", "").alias("url"),
                        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
                        F.octet_length(html).alias("size"))
    shared = written(rows.filter(F.col("size") >= min_revisit).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared-payloads")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))

    def line(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    line("Content-Length", F.col("size").cast("string")), F.lit("\r\n"))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        line("WARC-Date", F.lit(CRAWL_DATE)), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")),
                                 line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("html"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT_BYTES) -> None:
    """Writes ``records`` as archive files under ``path``."""
    records(pages, min_revisit).write.option("lineSep", TRAILER.decode()).text(path)


class Archive:
    """Ranged reads of one archive file, of any file system that Arrow knows."""

    def __init__(self, uri: str):
        fs, name = pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        self.file = fs.open_input_file(name)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start)

    def header(self, at: int) -> tuple[dict[bytes, bytes], int] | None:
        """Fields by lower-case name and the offset of the block of a record at ``at``, or None if it is none."""
        data, step = b"", 4096
        fields: dict[bytes, bytes] = {}
        pos = None
        while True:
            data += self.read(at + len(data), step)
            if pos is None:
                if not MAGIC.match(data):
                    return None
                pos = MAGIC_BYTES
            while (end := data.find(b"\r\n", pos)) >= 0:
                if end == pos:
                    return fields, at + end + 2
                found = FIELD.fullmatch(data, pos, end)
                if not found:
                    return None
                fields[found[1].lower()] = found[2].strip()
                pos = end + 2
            if at + len(data) >= self.size or not FIELD.match(data, pos) and len(data) - pos > step:
                return None
            step *= 2

    def record(self, at: int) -> tuple[dict[bytes, bytes], int, int] | None:
        """Fields, block offset and the offset after the trailing blank lines of a whole record at ``at``."""
        head = self.header(at)
        if not head or not head[0].get(b"content-length", b"").isdigit():
            return None
        length = int(head[0][b"content-length"])
        after = head[1] + length + len(TRAILER)
        if after > self.size or self.read(after - len(TRAILER), len(TRAILER)) != TRAILER:
            return None
        return head[0], head[1], after


def _chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    return files.select("path", F.col("length").alias("size"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))).alias("start"))


def _spread(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(max(1, min(math.ceil(n / CHUNKS_PER_TASK), 100_000)))


def candidates(chunks: DataFrame, chunk: int) -> DataFrame:
    """``(path, size, offset, successor, leaves)`` of everything in a chunk that looks like a whole record.

    ``leaves`` is where the chain of successors from the record first leaves
    the chunk; records whose chain breaks off inside the chunk are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive = Archive(path)
                data = archive.read(start, chunk + MAGIC_BYTES - 1)
                offsets = [start + m.start() for m in MAGIC.finditer(data) if m.start() < chunk]
                after = {at: r[2] for at in offsets if (r := archive.record(at))}
                leaves: dict[int, int] = {}
                for at in reversed(offsets):
                    if at in after:
                        to = after[at]
                        leaves[at] = to if to >= start + chunk or to >= size else leaves.get(to, -1)
                rows = [(path, size, at, after[at], leaves[at]) for at in offsets if leaves.get(at, -1) >= 0]
                if rows:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)],
                                          names=["path", "size", "offset", "successor", "leaves"])

    return chunks.select("path", "size", "start").mapInArrow(
        run, "path string, size long, offset long, successor long, leaves long")


def entries(found: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """``(path, offset)`` of the first reachable record of every chunk that holds one, by pointer jumping.

    Chunks are linked by their boundaries: only records that some chunk's
    chain arrives at, and file starts, count. Every round doubles the length of
    the jumps, so a file of ``most`` chunks takes log2(most) rounds.
    """
    starts = chunks.filter("start = 0").select("path", F.col("start").alias("offset"))
    arrivals = found.filter("leaves < size").select("path", F.col("leaves").alias("offset"))
    jump = written(found.join(arrivals.unionByName(starts).distinct(), ["path", "offset"], "left_semi")
                   .filter("leaves < size").select("path", "offset", F.col("leaves").alias("to")), "jumps")
    reached = written(starts, "reached")
    for _ in range(math.ceil(math.log2(max(1, most)))):
        ahead = reached.join(jump, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        reached = written(reached.unionByName(ahead).distinct(), "reached")
        twice = jump.select("path", F.col("to").alias("via"), F.col("offset").alias("o")).join(
            jump.select("path", F.col("offset").alias("via"), "to"), ["path", "via"])
        jump = written(twice.select("path", F.col("o").alias("offset"), "to"), "jumps")
    return reached


def _http_length(block: bytes) -> tuple[int | None, int]:
    """The declared length in a block's HTTP header, and where its payload begins."""
    end = block.find(TRAILER)
    if not block.startswith(b"HTTP/") or end < 0:
        return None, 0
    found = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]+)", block[:end])
    return (int(found[1]) if found else None), end + len(TRAILER)


def read_records(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The records of the archive files under ``path``.

    A first pass looks for record starts in all chunks of all files at once and
    chains every candidate to its successor by its Content-Length; pointer
    jumping from the file starts then tells which chunk entries are reachable,
    and a second pass reads only the records chained to those. Text that looks
    like a record inside a payload is never reached. What follows a damaged
    record in its file is not reachable and not returned. Empty files and
    folders give no rows.
    """
    pieces = _chunks(spark, path, chunk)
    sizes = pieces.groupBy("path").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    n, most = sizes.n or 0, sizes.most or 0
    found = written(candidates(_spread(pieces, n), chunk), "candidates")
    first = entries(found, pieces, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        schema = pa.schema(list(zip(names, [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()], strict=True)))
        rows, held = [], 0
        for batch in batches:
            for uri, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                archive, end = Archive(uri), (at // chunk + 1) * chunk
                while at < min(end, archive.size) and (record := archive.record(at)):
                    head, begin, after = record
                    block = archive.read(begin, after - len(TRAILER) - begin)
                    told, skip = _http_length(block)
                    text = {k: v.decode("utf-8", "replace") for k, v in head.items()}
                    rows.append((uri, at, *(text.get(k) for k in (
                        b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest")),
                        told, block[skip:]))
                    held += after - at
                    at = after
                    if held > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _spread(first.select("path", "offset"), n).mapInArrow(run, RECORD)


def page_records(read: DataFrame) -> DataFrame:
    """What the records that ``write_archives`` wrote tell about their pages: payload size and digest, kind, origin."""
    revisit = F.col("record_type") == "revisit"

    def page(name: str) -> Column:
        return F.regexp_extract(name, "urn:page:(-?[0-9]+)", 1).try_cast("long")

    return read.select(
        page("record_id").alias("page_id"),
        F.when(revisit, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", F.when(revisit, page("refers_to")).alias("refers_to"))
