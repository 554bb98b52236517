"""Crawl records (S4-S7, P4, P7): WARC files as a table.

``read_warc`` reads files with the record separator ``WARC/1.0\\r\\n`` as the
line separator, so a large WARC file is split across tasks like any text
file; each record is parsed with regular expressions into
``crawl(path, trec_id, record_type, url, warc_date, http_headers, html)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the WARC format.
RECORD_SEPARATOR = "WARC/1.0\r\n"
HEADER_END = "\r\n\r\n"
#: A record starts with a header line, whichever its name.
HEADER_LINE = r"^[A-Za-z][A-Za-z0-9-]*[ \t]*:"


def _header(block: Column, name: str) -> Column:
    v = F.regexp_extract(block, r"(?im)^" + name + r":[ \t]*([^\r\n]*)", 1)
    return F.when(v != "", v)


def read_warc_raw(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Raw record texts (value, path); the text between two separators."""
    reader = spark.read.option("lineSep", RECORD_SEPARATOR)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("path"))


def parse_warc_records(raw: DataFrame, value_col: str = "value", path_col: str | None = "path") -> DataFrame:
    """Parse record texts; pieces that do not start with a header line
    (e.g. the empty piece before the first separator) are left to
    ``warc_rejects``. A date that is none is null."""
    v = F.col(value_col)
    ok = raw.where(v.rlike(HEADER_LINE))
    parts = F.split(v, HEADER_END, 3)
    warc_h = parts.getItem(0)
    rec_type = _header(warc_h, "WARC-Type")
    has_http = (F.size(parts) >= 3) & (rec_type.isin("response", "request"))
    http_h = F.when(has_http, parts.getItem(1))
    body = F.when(has_http, parts.getItem(2)).otherwise(F.when(F.size(parts) >= 2, parts.getItem(1)))
    body = F.regexp_replace(body, r"(\r\n)+\z", "")
    cols = [
        (F.col(path_col) if path_col else F.lit(None).cast("string")).alias("path"),
        _header(warc_h, "WARC-TREC-ID").alias("trec_id"),
        rec_type.alias("record_type"),
        _header(warc_h, "WARC-Target-URI").alias("url"),
        F.try_to_timestamp(_header(warc_h, "WARC-Date")).alias("warc_date"),
        http_h.alias("http_headers"),
        body.alias("html"),
    ]
    return ok.select(*cols)


def warc_rejects(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Pieces that are not WARC records (kept for inspection, not parsed)."""
    v = F.col(value_col)
    return raw.where(~v.rlike(HEADER_LINE) & (F.length(F.trim(v)) > 0))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Crawl table of all WARC files under ``path``, read by length (``warc_frames``).

    Pieces between separators (``read_warc_raw``) are for streams, whose files are read by Spark's text source.
    """
    from webloom.sources.warc_frames import read_warc_files
    return read_warc_files(spark, path)[0].select("path", "trec_id", "record_type", "url", "warc_date", "http_headers", "html")


def responses(crawl: DataFrame) -> DataFrame:
    """Response records only."""
    return crawl.where(F.col("record_type") == "response")


def charset(http_headers: Column) -> Column:
    """Declared charset of the HTTP Content-Type header (lower case) or null."""
    c = F.lower(F.regexp_extract(http_headers, r"(?i)content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_.:-]+)", 1))
    return F.when(c != "", c)


def format_warc_records(pages: DataFrame, id_prefix: str = "clueweb12-", id_col: str = "page_id",
                        url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (one string each, separator included) for pages."""
    body = F.col(html_col)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
                          "Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    payload = F.concat(http, body)
    head = F.concat(
        F.lit(RECORD_SEPARATOR + "WARC-Type: response\r\nWARC-Date: 2012-02-12T09:08:06Z\r\nWARC-TREC-ID: "),
        F.lit(id_prefix), F.col(id_col).cast("string"),
        F.lit("\r\nWARC-Target-URI: "), F.col(url_col),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit(HEADER_END))
    return pages.select(F.concat(head, payload, F.lit(HEADER_END)).alias("value"))


def write_warc(pages: DataFrame, out: str, mode: str = "overwrite", **kw) -> None:
    """Write pages as WARC files (one per task)."""
    recs = format_warc_records(pages, **kw)
    # each record ends with CRLF CRLF; the writer adds the last CRLF itself
    recs.select(F.expr("substring(value, 1, length(value) - 2)").alias("value")) \
        .write.mode(mode).option("lineSep", "\r\n").text(out)


def record_fields(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """(trec_id, url) of raw record texts."""
    v = F.col(value_col)
    return raw.select(_header(v, "WARC-TREC-ID").alias("trec_id"), _header(v, "WARC-Target-URI").alias("url"))


def extract_header_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Stripped lines naming a record id (``kind='id'``) or a target URI
    (``kind='uri'``)."""
    t = F.trim(F.col(value_col))
    kind = (F.when(t.contains("WARC-TREC-ID") | t.contains("WARC-Record-ID"), F.lit("id"))
            .when(t.contains("WARC-Target-URI"), F.lit("uri")))
    return lines.select(kind.alias("kind"), t.alias("line")).where(F.col("kind").isNotNull())
