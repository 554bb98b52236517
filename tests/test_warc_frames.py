"""Crawl files by length: separators and blank lines in pages, ranges, charsets, rejects."""

import gzip
import os
import tempfile

import pytest

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def _record(page_id, body, kind="response", http="HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", length=None, end=b"\r\n\r\n"):
    payload = http.encode() + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-TREC-ID: t{page_id}\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n"
    return head.encode() + payload + end


def _files(*contents):
    d = tempfile.mkdtemp(prefix="webloom-warc-")
    for k, c in enumerate(contents):
        os.makedirs(f"{d}/sub{k}", exist_ok=True)
        with open(f"{d}/sub{k}/f {k}.warc", "wb") as f:
            f.write(c)
    return d


@pytest.mark.parametrize("range_bytes", [1, 500, 1 << 24])
def test_payloads_come_back_whole_in_ranges_of_any_size(spark, range_bytes):
    from webloom.sources.warc_frames import read_warc_files
    bodies = ["", "plain", FAKE, "x" + "\r\n" + FAKE + FAKE, "ends in breaks\r\n\r\n\r\n", "\r\n\r\nstarts with them", "é" * 5000, "a" * 300_000]
    first = b"\r\n" + b"".join(_record(i, b.encode()) for i, b in enumerate(bodies))
    info = _record(90, b"software: x", kind="warcinfo", http="")
    crawl, rejects, counts = read_warc_files(spark, _files(first, info + _record(91, b"last", end=b""), b"", b"\r\n\r\n"), range_bytes)
    got = {r.trec_id: r for r in crawl.collect()}
    assert rejects.count() == 0 and counts == {"records": len(bodies) + 2}
    assert [got[f"t{i}"].html for i in range(len(bodies))] == bodies
    assert got["t90"].html is None and bytes(got["t90"].payload) == b"software: x" and got["t91"].html == "last"
    assert got["t0"].http_headers.startswith("HTTP/1.1 200") and "f 0.warc" in got["t0"].path


def test_rejects_have_reasons_and_do_not_take_their_neighbours(spark):
    from webloom.sources.warc_frames import read_warc_files
    good = [_record(i, b"good " * i) for i in range(6)]
    bad = [b"garbage\r\nmore garbage\r\n\r\n", _record(11, b"b", length="many"), _record(12, b"hello there", length=5),
           _record(13, b"no http", http=""), b"WARC/1.0\r\nWARC-Type: response\r\nno end of header"]
    content = b"".join(g + b for g, b in zip(good, [*bad, b""], strict=True))
    missing = _record(20, b"x").replace(b"Content-Length: ", b"Content-Size: ").replace(b"WARC-Type: response\r\n", b"")
    untyped = _record(22, b"x").replace(b"WARC-Type: response\r\n", b"")
    crawl, rejects, counts = read_warc_files(spark, _files(content, missing + untyped + _record(21, b"y" * 50, length=9_999_999)), 64)
    assert sorted(r.trec_id for r in crawl.collect()) == [f"t{i}" for i in range(6)]
    found = sorted((r.reason, r.trec_id) for r in rejects.fillna("", ["trec_id"]).collect())
    assert ("length is no number", "t11") in found and ("length leads to no record end", "t12") in found
    assert ("no HTTP header", "t13") in found and ("no length", "t20") in found and ("no type", "t22") in found and ("cut off", "t21") in found
    assert [r for r, _ in found].count("no record header") == 1
    assert counts.pop("records") == 6 and sum(counts.values()) == len(found)
    assert all(r.sample and len(r.sample) <= 200 for r in rejects.collect())


def test_charsets_by_mark_header_page_and_content():
    from webloom.sources.warc_frames import decode_page
    text = "<p>Größe, déjà vu</p>"
    plain, latin, utf16 = "Content-Type: text/html", "Content-Type: text/html; charset=ISO-8859-1", "content-type: text/html; charset=\"utf-16\""
    assert decode_page(text.encode(), plain) == ("utf-8", text)
    assert decode_page(text.encode("latin-1"), latin) == ("cp1252", text)
    assert decode_page("“quoted”".encode("cp1252"), latin) == ("cp1252", "“quoted”")
    assert decode_page(text.encode("utf-16"), plain) == ("utf-16-le", text)
    assert decode_page(b"\xfe\xff" + text.encode("utf-16-be"), latin) == ("utf-16-be", text)
    assert decode_page(text.encode("utf-16-le"), utf16)[1] == text
    assert decode_page(text.encode("utf-8-sig"), latin) == ("utf-8", text)
    page = '<head><META http-equiv="x" content="text/html; charset=Shift_JIS">日本'
    assert decode_page(page.encode("shift_jis"), plain) == ("shift_jis", page)
    assert decode_page(text.encode("latin-1"), "Content-Type: text/html; charset=no-such") == ("cp1252", text)
    assert decode_page(b"\x81\xff", plain) == ("cp1252", "�ÿ") and decode_page(b"", "") == ("utf-8", "")
    assert decode_page(b"bad \xff byte", "Content-Type: text/html; charset=utf-8") == ("utf-8", "bad � byte")


def test_no_file_and_compressed_file(spark):
    from webloom.sources.warc_frames import read_warc_files
    crawl, rejects, counts = read_warc_files(spark, _files(gzip.compress(_record(1, b"x"))))
    assert crawl.count() == 0 and [r.reason for r in rejects.collect()] == ["no record header"] and counts["records"] == 0
