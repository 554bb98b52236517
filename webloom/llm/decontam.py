"""Benchmark decontamination: Wu-Manber search of test windows in documents, over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices, written

WINDOW = 13
#: Consecutive words that make a block of the shift table.
BLOCK = 3
#: Bytes of windows that one broadcast search table holds; more windows make more tables, searched one after another.
TABLE_BYTES = 16 << 20

#: A-Z to a-z; other ASCII than letters and digits to a blank; bytes of other characters stay.
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))

RESULT = "n_hit long, items array<string>"


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split()


@dataclass
class SearchTable:
    """Wu-Manber tables of the windows of one length: how far each block lets the search move on, and the windows by
    the block they end with."""

    length: int
    block: int
    shift: dict = field(default_factory=dict)
    ends: dict = field(default_factory=dict)

    def add(self, window: list[bytes], items: list[str]) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = tuple(window[end - b:end])
            self.shift[key] = min(self.shift.get(key, m - b + 1), m - end)
        self.ends.setdefault(tuple(window[m - b:]), []).append((window, items))

    def search(self, text: list[bytes], hit: bytearray, found: set[str]) -> None:
        m, b, shift, far = self.length, self.block, self.shift, self.length - self.block + 1
        at, n = m, len(text)
        while at <= n:
            key = tuple(text[at - b:at])
            move = shift.get(key, far)
            if move:
                at += move
                continue
            for window, items in self.ends[key]:
                if text[at - m:at] == window:
                    hit[at - m:at] = b"\x01" * m
                    found.update(items)
            at += 1


def search_tables(windows: list[tuple[list[str], list[str]]], block: int = BLOCK) -> list[SearchTable]:
    """One table for each window length; ``windows`` holds (words, item ids)."""
    tables: dict[int, SearchTable] = {}
    for window, items in windows:
        own = [w.encode() for w in window]
        tables.setdefault(len(own), SearchTable(len(own), min(block, len(own)))).add(own, items)
    return list(tables.values())


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(words, items)``: each distinct window of the test texts with the ids of its items, as sorted strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, grams = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [w.decode() for w in words(text or b"")]
                for i in range(max(1, len(own) - window + 1) if own else 0):
                    ids.append(item)
                    grams.append(own[i:i + window])
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(grams, pa.list_(pa.string()))],
                                  names=["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "item string, words array<string>").groupBy("words").agg(
        F.sort_array(F.collect_set("item")).alias("items"))


def _scan(docs: DataFrame, table: Broadcast, block: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs(text, ...)`` with ``n_words``, ``n_hit``, ``items`` and the hit mask, if any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = search_tables(table.value, block)
        for batch in slices(batches):
            n_words, masks, n_hit, items = [], [], [], []
            for text in batch.column(0).to_pylist():
                own = words(text or b"")
                hit, found = bytearray(len(own)), set()
                for t in tables:
                    t.search(own, hit, found)
                n_words.append(len(own))
                n_hit.append(hit.count(1))
                masks.append(bytes(hit) if n_hit[-1] else None)
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(masks, pa.binary())],
                names=[*keep, "n_words", "n_hit", "items", "__mask"])

    rows = docs.select(F.col("text").cast("binary").alias("__text"), *keep)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*kept, "n_words long", RESULT, "__mask binary"]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK,
                  table_bytes: int = TABLE_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs(text, ...)`` with ``n_words``, ``n_hit`` and ``items``, for every
    row, against ``benchmark(item_id, text)``.

    ``n_hit`` counts the words inside any occurrence of any window of
    ``window`` consecutive item words (a shorter item is one window); ``items``
    are the ids with an occurring window, as sorted strings. The search moves
    through a document by Wu-Manber shifts over blocks of ``block`` words. The
    windows are searched in tables of at most ``table_bytes``: what is
    broadcast is bounded, and a larger benchmark takes more passes, whose hits
    meet by document.

    A null or wordless text has no words and no hits; a wordless item has no
    window; windows of an item without id are hit but name no item. Items that
    share a text or an id share windows. Repeated documents each give a row. An
    empty table gives no rows or no hits. Other columns are not read; those named
    like a result give way to it, and names that begin with two underscores are taken.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items")]
    grams = written(windows_of(benchmark, window), "windows")
    weight = F.sum(F.length(F.concat_ws(" ", "words")) + F.length(F.concat_ws(" ", "items")) + F.lit(64))
    total = grams.agg(weight).first()[0] or 0
    n = max(1, -(-total // table_bytes))
    part = F.pmod(F.xxhash64(F.concat_ws(" ", "words")), F.lit(n))

    def table(k: int) -> Broadcast:
        return spark.sparkContext.broadcast([(r.words, r.items) for r in grams.filter(part == k).toLocalIterator()])

    if n == 1:
        return _scan(docs, table(0), block, keep).drop("__mask")
    # more tables than one: a document's hit masks meet by its text
    keyed = docs.withColumn("__key", F.sha2(F.coalesce("text", F.lit("")), 256))
    hits = None
    for k in range(n):
        own = table(k)
        found = written(_scan(keyed, own, block, ["__key"]).filter("__mask is not null").distinct(), "hits")
        own.unpersist()
        hits = found if hits is None else hits.unionByName(found)

    def meet(group: pa.Table) -> pa.Table:
        mask, items = 0, set()
        for m, i in zip(group.column("__mask").to_pylist(), group.column("items").to_pylist(), strict=True):
            mask |= int.from_bytes(m, "big")
            items.update(i)
        return pa.table({"__key": group.column("__key")[:1], "n_hit": pa.array([mask.bit_count()], pa.int64()),
                         "items": pa.array([sorted(items)], pa.list_(pa.string()))})

    met = hits.groupBy("__key").applyInArrow(meet, f"__key string, {RESULT}")
    counted = _scan(keyed, spark.sparkContext.broadcast([]), block, [*keep, "__key"])
    return counted.select(*keep, "__key", "n_words").join(met, "__key", "left").select(
        *keep, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """The counts of ``contamination``, a digest of the items, and the verdict: hit, and in at least a twentieth."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        is_contaminated().alias("contaminated"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
