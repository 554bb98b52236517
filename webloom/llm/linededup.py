"""Line deduplication: an exact set-similarity join of all lines, and removal of the later matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import id_filter, possibly_in, written

SIMILARITY = Fraction(4, 5)
#: Counters of the rarity order; words that share one are held equally rare. Fixes the size of what is broadcast.
COUNTERS = 1 << 18
#: Line sets that hold a word in their prefix from which they are spread over more tasks, in pairs of blocks of about this size.
BLOCK_ROWS = 2_000_000
#: Candidates that a line is given of each prefix word in the first round; lines that have more are asked again.
FIRST_ASK = 8
#: By how much each further round raises that.
RAISE = 16
#: Prefix words beyond the first that a pair must share, where its sizes force that many.
FURTHER = 1
#: Text that a task parses at once; its words and their hashes should fit a core's cache.
PARSE_BYTES = 1 << 20

#: Words of all texts for each bucket in which lines, and then their prefix words, are gathered.
BUCKET_WORDS = 2_000_000
#: Rows that a task packs into blocks at once.
PACK_ROWS = 1 << 18
#: Line sets of a written block, at most.
SET_ROWS = 1 << 14
#: Bits of a filter over places or words, at least and at most; it has 32 to 64 a key between.
PLACE_BITS = (1 << 16, 1 << 26)

#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.append((np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), np.uint64(2 ** 64 - 1))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Columns of a line in its block, and of a prefix word in its: h1 and h2 are of its word set, size of its prefix.
LINE = {"h1": "i8", "h2": "i8", "doc": "i8", "part": "i8", "line": "i4", "n": "i4", "sig": "i8", "size": "i4"}
POSTING = {"g": "i8", "side": "i1", "doc": "i8", "part": "i8", "line": "i4", "n": "i4", "sig": "i8", "at": "i4", "ask": "?"}
#: Columns of a line set in its block; ``size`` is 0 for a line that equals an earlier one.
SET = {c: k for c, k in LINE.items() if c not in ("h1", "h2")}
BLOCK = "bucket long, rows long, block binary, prefix binary"


def _pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``PARSE_BYTES`` of text each (one text at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + PARSE_BYTES, "right")))
            yield batch.slice(start, end - start)
            start = end


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _MIX[by]
    h ^= h >> np.uint64(29)
    return h


def _hashes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of ``left`` bytes at ``at``, eight bytes of all of them at a time; ``data`` has eight bytes more."""
    eight = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    h = left.astype(np.uint64)
    h *= _MIX[1]
    todo = None
    while len(left):
        new = eight[at]
        new &= _FIRST.take(left, mode="clip")
        new ^= h if todo is None else h[todo]
        new = _mixed(_mixed(new, 0), 1)
        if todo is None:
            h = new
        else:
            h[todo] = new
        more = np.flatnonzero(left > 8)
        todo, at, left = more if todo is None else todo[more], at[more] + 8, left[more] - 8
    return h


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)``: the bytes of all texts, nulls empty, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of the words: what ASCII white space and the ends of texts part, with A-Z lower-cased."""
    space = np.ones(len(data) + 2, bool)
    np.logical_or(data == 32, data - np.uint8(9) <= 4, out=space[1:-1])
    edges = np.flatnonzero(space[1:] != space[:-1])
    at, end = edges[::2], edges[1::2]
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    inner = inner[~space[inner] & ~space[inner + 1]]  # texts that meet without white space between
    at, end = np.insert(at, np.searchsorted(at, inner), inner), np.insert(end, np.searchsorted(end, inner), inner)
    lower = np.zeros(len(data) + 8, np.uint8)
    np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=lower[:-8])
    return at, _hashes(lower, at, end - at)


class Parsed:
    """The lines of some texts, their words as codes into a list of distinct word hashes.

    A line ends at ``\\n``; words are what ASCII white space parts, with A-Z
    lower-cased. A null text is empty: one line without words.
    """

    def __init__(self, texts: pa.Array, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """``wanted(doc, no)`` tells the lines, by the index of their text and their number, whose words are read (all if None)."""
        data, offsets = _text_bytes(texts)
        ends = np.flatnonzero(data == 10)
        self.per_doc = 1 + np.diff(np.searchsorted(ends, offsets))
        self.doc = np.repeat(np.arange(len(texts)), self.per_doc)
        first = np.cumsum(self.per_doc) - self.per_doc
        self.no = np.arange(len(self.doc)) - np.repeat(first, self.per_doc)
        starts = np.empty(len(self.doc), np.int64)
        starts[self.no == 0] = offsets[:-1]
        starts[self.no > 0] = ends + 1
        lines = np.arange(len(starts))
        if wanted is not None:  # their bytes only, each line a text of its own
            lines = np.flatnonzero(wanted(self.doc, self.no))
            last = self.no == np.repeat(self.per_doc, self.per_doc) - 1
            size = np.append(starts[1:], len(data))[lines] - starts[lines] - np.where(last[lines], 0, 1)  # less the line feed
            data = data[_spread(starts[lines], size)]
            offsets = np.append(0, np.cumsum(size))
            starts = offsets[:-1]
        at, hashes = _words(data, offsets)
        self.line = np.repeat(lines, np.diff(np.searchsorted(at, starts), append=len(at)))
        coded = pa.array(hashes).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.hash = coded.dictionary.to_numpy(zero_copy_only=False)

    def sets(self, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, start, hash): lines that have words, where each one's distinct words begin, and those, rarest first."""
        u = max(1, len(self.hash))
        rare = counts[self.hash & np.uint64(COUNTERS - 1)] if counts is not None else np.zeros(len(self.hash))
        both = (rare.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (self.hash >> np.uint64(32))
        order = np.argsort(both)
        if (both[order][1:] == both[order][:-1]).any():
            order = np.lexsort((self.hash, both))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bits = int(u).bit_length()
        key = np.sort((self.line << bits) + rank[self.code])
        key = key[np.append(True, key[1:] != key[:-1])[:len(key)]]
        line = key >> bits
        start = np.nonzero(np.diff(line, prepend=-1))[0]
        return line[start], start, self.hash[order[key & ((1 << bits) - 1)]]


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids as numbers; rows without one stand before all others."""
    return pc.fill_null(column.cast(pa.int64()), -2 ** 63).to_numpy(zero_copy_only=False)


def _id(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(-2 ** 63))


def text_key() -> Column:
    """What tells apart the texts of rows without doc_id, or of one doc_id: a hash of the text, in which ids count by their presence."""
    return F.xxhash64("text", F.col("doc_id").isNull())


def with_part(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with ``__part``, which with the id names each distinct (doc_id, text): 0, or the text's key where ids are null or repeat.

    ``repeated`` is ``repeated_ids``; an id that its filter lets through for
    another's bits has the text's key too, in all its rows.
    """
    marked = possibly_in(docs, repeated, _id())
    part = F.when(F.col("doc_id").isNull() | F.col("__in"), text_key()).otherwise(F.lit(0).cast("long"))
    return marked.withColumn("__part", part).drop("__in")


def repeated_ids(docs: DataFrame) -> DataFrame:
    """Bit filter of the ids under which different texts stand; -2^63, which stands for no id, is always in it.

    Only texts of ids that stand in several rows are hashed.
    """
    known = docs.filter("doc_id is not null")
    ids = docs.sparkSession.range(1).select(F.lit(-2 ** 63).cast("long").alias("id"))
    often = id_filter(known.select(_id().alias("id")).groupBy("id").count().filter("count > 1"), "id")
    if often.limit(1).count():
        seen = possibly_in(known, often, _id()).filter("__in").select(_id().alias("id"), text_key().alias("h")).groupBy("id").agg(
            F.min("h").alias("low"), F.max("h").alias("high"))
        ids = ids.unionByName(seen.filter("low <> high").select("id"))
    return id_filter(ids, "id")


def _signature(start: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Sixteen counters of four bits: how many words of each set fall to each, 15 at most."""
    n = np.diff(np.append(start, len(hashes)))
    cell = np.repeat(np.arange(len(start)), n) * 16 + (_mixed(hashes, 0) >> np.uint64(60)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=16 * len(start)), 15).astype(np.uint8).reshape(-1, 16)
    return (counts[:, ::2] | (counts[:, 1::2] << 4)).view(np.uint64).ravel()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that are in one of two sets only, at least, by their signatures."""
    low, one = np.uint64(0x0F0F0F0F0F0F0F0F), np.uint64(0x0101010101010101)
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(4)):
        x, y = ((s.view(np.uint64) >> shift) & low for s in (a, b))
        d = (x | (one << np.uint64(4))) - y  # 16 + x - y in each byte
        less = ~(d >> np.uint64(4)) & one
        d = ((d & low) ^ (less * np.uint64(15))) + less
        total += ((d * one) >> np.uint64(56)).view(np.int64)  # the sum of the bytes
    return total


def _place(doc: np.ndarray, part: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    h = _mixed(doc.astype(np.int64).view(np.uint64) + _MIX[0], 0) ^ part.astype(np.int64).view(np.uint64)
    return _mixed(_mixed(h, 1) + line.astype(np.uint64), 0)


def _bits(keys: DataFrame, key: Callable[[pa.RecordBatch], np.ndarray], n: int) -> Broadcast:
    """Bit filter, two bits a key, over the hashes that ``key`` gives for the batches of ``keys``, about ``n``."""
    size = min(PLACE_BITS[1], max(PLACE_BITS[0], 1 << (32 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = key(batch)
            for shift in (0, 32):
                yield pa.record_batch([pa.array((h >> np.uint64(shift) & np.uint64(size - 1)).astype(np.int64))], names=["b"])

    found = keys.mapInArrow(run, "b long").groupBy(F.shiftright("b", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(table)


def _in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), np.uint64)
    for shift in (0, 32):
        b = h >> np.uint64(shift) & np.uint64(64 * len(table) - 1)
        hit &= table[b >> np.uint64(6)] >> (b & np.uint64(63))
    return hit == 1


def _ranges(buckets: np.ndarray) -> np.ndarray:
    """Bucket numbers in two bytes where they fit, which sort faster."""
    return buckets.astype(np.uint16) if len(buckets) and 0 <= buckets.min() and buckets.max() < 1 << 16 else buckets


def _by_place(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The order of rows by place; in one number where it holds all places."""
    doc, line = rows["doc"], rows["line"]
    if len(doc) and not rows["part"].any():
        low, lines = int(doc.min()), int(line.max()) + 1
        if (int(doc.max()) - low + 1) * lines < 1 << 62:
            return np.argsort((doc - low) * lines + line)
    return np.lexsort((line, rows["part"], doc))


def _codes(values: np.ndarray) -> np.ndarray:
    """The number of each value among the distinct ones, in their order."""
    order = np.argsort(values)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.diff(values[order], prepend=values[order][:1]) != 0)
    return out


def _packed(rows: dict[str, np.ndarray], kinds: dict[str, str]) -> bytes:
    """Columns as one compressed string, byte by byte of each."""
    raw = [np.ascontiguousarray(rows[c], k).view(np.uint8).reshape(-1, np.dtype(k).itemsize).T.tobytes() for c, k in kinds.items()]
    return pa.compress(b"".join(raw), "zstd", asbytes=True)


def _unpacked(block: bytes, n: int, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    sizes = {c: np.dtype(k).itemsize for c, k in kinds.items()}
    raw, out, at = np.frombuffer(pa.decompress(block, n * sum(sizes.values()), "zstd"), np.uint8), {}, 0
    for c, size in sizes.items():
        out[c] = np.ascontiguousarray(raw[at:at + n * size].reshape(size, n).T).view(kinds[c]).ravel()
        at += n * size
    return out


def _blocks(rows: dict[str, np.ndarray], bucket: np.ndarray, kinds: dict[str, str], sizes: np.ndarray | None = None,
            prefix: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``BLOCK``, one for each bucket of the rows; ``prefix`` holds ``sizes`` numbers of each."""
    order = np.argsort(_ranges(bucket), kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order][:1] - 1))
    begin = None if sizes is None else np.cumsum(sizes) - sizes
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        at = order[a:b]
        flat = b"" if sizes is None else prefix[_spread(begin[at], sizes[at])].tobytes()
        yield pa.record_batch([pa.array([int(bucket[at[0]])]), pa.array([len(at)]), pa.array([_packed({c: rows[c][at] for c in kinds}, kinds)]),
                               pa.array([flat], pa.binary())], names=["bucket", "rows", "block", "prefix"])


def _spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices ``begin``, ``begin + 1``... of runs of the given sizes."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _by_bucket(blocks: DataFrame, buckets: int, kinds: dict[str, str], each: Callable[[dict[str, np.ndarray], np.ndarray], Iterator[pa.RecordBatch]],
               schema: str) -> DataFrame:
    """``each(rows, prefix)`` of every bucket of a table of blocks, a bucket at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from each({c: np.concatenate([r[c] for r, _ in held]) for c in kinds}, np.concatenate([p for _, p in held]))

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, n, block, prefix = (batch.column(c)[i].as_py() for c in range(4))
                if bucket != now:
                    yield from done()
                    held, now = [], bucket
                held.append((_unpacked(block, n, kinds), np.frombuffer(prefix, np.int32)))
        yield from done()

    return blocks.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _totals(rows: DataFrame, count: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sums in ``COUNTERS`` counters, ``count`` giving the counters of a batch and what each gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counter, n = count(batch)
            total += np.bincount(counter, n, COUNTERS).astype(np.int64)
        for k, part in enumerate(total.reshape(256, -1)):
            if part.any():
                yield pa.record_batch([pa.array([k]), pa.array([_packed({"n": part}, {"n": "i8"})])], names=["k", "n"])

    def added(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS // 256, np.int64)
        for b in parts:
            for x in b.column("n"):
                total += _unpacked(x.as_py(), len(total), {"n": "i8"})["n"]
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([total.tobytes()])], names=["k", "n"])

    out = np.zeros((256, COUNTERS // 256), np.int64)
    for r in rows.mapInArrow(run, "k long, n binary").groupBy("k").applyInArrow(added, "k long, n binary").collect():  # 2 MB
        out[r.k] = np.frombuffer(r.n, np.int64)
    return out.ravel()


def word_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of words over all documents, in ``COUNTERS`` counters by hash."""
    def count(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros(COUNTERS, np.int64)
        held, n = [], 0

        def add() -> None:
            nonlocal total
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)

        for piece in _pieces([batch], 0):
            held.append((_words(*_text_bytes(piece.column(0)))[1] & np.uint64(COUNTERS - 1)).astype(np.int32))
            n += len(held[-1])
            if n >= 4 * COUNTERS:
                add()
                held, n = [], 0
        if held:
            add()
        return np.arange(COUNTERS), total

    return _totals(docs.select("text"), count)


ID = ("doc", "part", "line", "n")
SETS = "doc long, part long, line int, n int, prefix array<int>"
PAIR = ", ".join(f"{s}_{c} {t}" for s in "yx" for c, t in zip(ID, ("long", "long", "int", "int"), strict=True)) + ", more boolean"


def _firsts(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, first, later)``: rows by set and place, whether each is its set's first, and whether it has a place other than that."""
    by_place = _by_place(rows)
    bits = len(by_place).bit_length()
    order = by_place[np.sort((_codes(rows["h1"])[by_place] << bits) + np.arange(len(by_place))) & ((1 << bits) - 1)]
    h1, h2 = rows["h1"][order], rows["h2"][order]
    if ((h1[1:] == h1[:-1]) & (h2[1:] != h2[:-1])).any():
        order = np.lexsort((rows["line"], rows["part"], rows["doc"], rows["h2"], rows["h1"]))
        h1, h2 = rows["h1"][order], rows["h2"][order]
    first = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[:len(order)]
    of = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    return order, first, np.any([rows[c][order] != rows[c][of] for c in ("doc", "part", "line")], axis=0)


def set_blocks(docs: DataFrame, counts: Broadcast, buckets: int, t: Fraction = SIMILARITY) -> DataFrame:
    """Every line that has words, in blocks of ``SET``, those that equal an earlier one in blocks of their own without prefix.

    The prefix holds half the hashes of as many of the rarest words as two sets
    of the similarity must share one of. A task compares its own lines first,
    then all that are left meet in the buckets of a hash of their word sets, so
    that a line with many copies is sent once by a task.
    """
    a, b = t.numerator, t.denominator

    def parsed(piece: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p = Parsed(piece.column(1))
        line, start, h = p.sets(counts.value)
        n = np.diff(np.append(start, len(h)))
        at = np.arange(len(h)) - np.repeat(start, n)
        size = n - (a * n + b - 1) // b + 1
        two = [np.add.reduceat(_mixed(h, k), start).view(np.int64) if len(line) else np.zeros(0, np.int64) for k in (0, 1)]
        return dict(zip(LINE, [
            *two, _ids(piece.column(0))[p.doc[line]], piece.column(2).to_numpy(zero_copy_only=False)[p.doc[line]], p.no[line], n,
            _signature(start, h).view(np.int64), size], strict=True)), h[at < np.repeat(size, n)].astype(np.uint32).view(np.int32)

    def packed(held: list[tuple[dict[str, np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([r[c] for r, _ in held]) for c in LINE}
        prefix = np.concatenate([p for _, p in held])
        begin = np.cumsum(rows["size"]) - rows["size"]
        order, first, later = _firsts(rows)
        size = np.where(first, rows["size"][order], 0)
        keep = first | later
        order, size = order[keep], size[keep]
        rows = {c: v[order] for c, v in rows.items()} | {"size": size}
        bucket = (rows["h1"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        yield from _blocks(rows, bucket, LINE, size, prefix[_spread(begin[order], size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in _pieces(batches, 1):
            held.append(parsed(piece))
            n += len(held[-1][0]["n"])
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if n:
            yield from packed(held)

    def distinct(rows: dict[str, np.ndarray], prefix: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.cumsum(rows["size"]) - rows["size"]
        copies = {c: v[rows["size"] == 0] for c, v in rows.items()}
        whole = np.flatnonzero(rows["size"])
        order, first, later = _firsts({c: v[whole] for c, v in rows.items()})
        gone, at = whole[order[~first & later]], whole[order[first]]
        at = at[_by_place({c: rows[c][at] for c in ID})]
        copies = {c: np.append(copies[c], rows[c][gone]) for c in SET} | {"size": np.zeros(len(copies["n"]) + len(gone), np.int32)}
        bucket = rows["h1"][:1].view(np.uint64) % np.uint64(buckets)
        for i in range(0, len(at), SET_ROWS):
            k = at[i:i + SET_ROWS]
            yield from _blocks({c: rows[c][k] for c in SET}, np.repeat(bucket, len(k)).astype(np.int64), SET, rows["size"][k],
                               prefix[_spread(begin[k], rows["size"][k])])
        for i in range(0, len(copies["n"]), SET_ROWS):
            k = slice(i, i + SET_ROWS)
            yield from _blocks({c: v[k] for c, v in copies.items()}, np.repeat(bucket, len(copies["n"][k])).astype(np.int64), SET)

    blocks = docs.select("doc_id", "text", "__part").mapInArrow(run, BLOCK)
    return written(_by_bucket(blocks, buckets, LINE, distinct, BLOCK), "line-sets")


def _each_block(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """``(rows, prefix)`` of the blocks of a batch of ``set_blocks``."""
    for i in range(batch.num_rows):
        _, n, block, prefix = (batch.column(c)[i].as_py() for c in range(4))
        yield _unpacked(block, n, SET), np.frombuffer(prefix, np.int32)


def set_rows(blocks: DataFrame) -> DataFrame:
    """The lines of ``set_blocks``: place, size and prefix (null for lines that equal an earlier one)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, prefix in _each_block(batch):
                ends = np.append(0, np.cumsum(rows["size"])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix), mask=pa.array(rows["size"] == 0))
                yield pa.record_batch([*(pa.array(rows[c]) for c in ID), lists], names=[*ID, "prefix"])

    return blocks.mapInArrow(run, SETS)


def line_sets(docs: DataFrame, counts: Broadcast, buckets: int, t: Fraction = SIMILARITY) -> DataFrame:
    """The lines of ``set_blocks`` as rows."""
    return set_rows(set_blocks(docs, counts, buckets, t))


def hot_counters(sets: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Blocks that the lines with a prefix word of each counter are compared in: 1, or more if over ``BLOCK_ROWS`` line sets share it.

    The counters are those of ``word_counts``, which bound how many share a word.
    """
    if counts.max(initial=0) >= BLOCK_ROWS:
        counts = _totals(sets.select("prefix"), lambda b: (
            np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32).astype(np.int64) & (COUNTERS - 1), None))
    return 1 + np.where(counts >= BLOCK_ROWS, counts // BLOCK_ROWS, 0)


def _postings(rows: dict[str, np.ndarray], of: np.ndarray, at: np.ndarray, word: np.ndarray, blocks: np.ndarray,
              buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a row for each prefix word, the ``at``-th of row ``of``, and for each pair of blocks that its word's lines are compared in."""
    word = word.astype(np.int64) & 0xFFFFFFFF
    k = blocks[word & (COUNTERS - 1)]
    g, side = word, np.zeros(len(word), np.int8)
    bucket = (_mixed(word.astype(np.uint64), 1) % np.uint64(buckets)).astype(np.int64)
    if k.max(initial=1) > 1:
        other = _spread(np.zeros(len(k), np.int64), k)
        of, at, word, bucket, k = (np.repeat(x, k) for x in (of, at, word, bucket, k))
        own = (_place(rows["doc"], rows["part"], rows["line"])[of] % k.astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(own, other), np.maximum(own, other)
        pair = _mixed(word.astype(np.uint64) + _mixed(low.astype(np.uint64) + _MIX[0], 0) + _mixed(high.astype(np.uint64) + _MIX[1], 1), 0)
        g = np.where(k == 1, word, (pair | np.uint64(1 << 63)).view(np.int64))
        bucket = np.where(k == 1, bucket, g)  # a bucket for each pair of blocks
        side = np.where(low == high, 0, np.where(own == low, 1, 2))
    order = np.argsort(_ranges(bucket), kind="stable")
    out = {c: rows[c][of[order]] for c in (*ID, "sig", "ask")}
    out |= {"g": g[order], "at": at[order], "side": side[order]}
    yield from _blocks(out, bucket[order], POSTING)


def _size_classes(n: np.ndarray, t: Fraction) -> tuple[np.ndarray, int]:
    """Classes of set sizes, from 1, and how many numbers they take; sizes that the similarity allows are at most one class apart."""
    bounds = [1]
    while bounds[-1] <= n.max(initial=1):
        bounds.append(bounds[-1] * t.denominator // t.numerator + 1)
    if n.max(initial=1) > 1 << 16:
        return np.searchsorted(np.array(bounds), n, "right"), len(bounds) + 1
    return np.searchsorted(np.array(bounds), np.arange(n.max(initial=1) + 1), "right")[n], len(bounds) + 1


def _matched(rows: dict[str, np.ndarray], t: Fraction, ask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(later, earlier, more)``: rows of pairs of a group that pass the filters.

    Length, position and signature bound the words that two lines can share or
    differ in; the position allows for ``FURTHER`` shared words before this one.
    A group is sorted by size class, then place, and a row looks back in its
    own class and the two beside it. Each later row gets at most ``ask`` of the
    earlier ones, the nearest of each class; ``more`` marks rows that may have others.
    """
    a, b = t.numerator, t.denominator
    size = len(rows["g"])
    kind, kinds = _size_classes(rows["n"], t)
    by_place = _by_place(rows)
    bits = size.bit_length()
    key = np.sort(((_codes(rows["g"]) * kinds + kind)[by_place] << bits) + np.arange(size))  # a run for each class of a group
    rank, run = key & ((1 << bits) - 1), key >> bits
    order = by_place[rank]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    runs, of = run[first], np.cumsum(np.diff(run, prepend=-1) != 0) - 1
    n = rows["n"][order].astype(np.int64)
    small = np.int32 if n.max(initial=0) < 1 << 26 else np.int64
    need = (a * n).astype(small)
    have = ((a + b) * (n - rows["at"][order] + FURTHER) - a * n).astype(small)  # what the other may need
    sig = rows["sig"][order]
    asking = np.flatnonzero(rows["ask"][order])
    given = np.zeros(size, np.int64)
    more = np.zeros(size, bool)
    ys, xs = [], []
    for beside in (0, -1, 1):
        y, base = asking, asking
        to = of[y]
        if beside:
            to = np.searchsorted(runs, runs + beside)
            there = runs[np.minimum(to, len(runs) - 1)] == runs + beside
            y = y[there[of[y]]]
            to = to[of[y]]
            base = np.searchsorted(key, (runs[to] << bits) + rank[y])
        before = base - first[to]
        more[y] |= (given[y] >= ask) & (before > 0)
        step, done = 0, len(y)  # rows that are known to have no more to look at; they leave when they are many
        while True:
            if not step or 4 * (done + np.searchsorted(ends, step, "right")) > len(y):
                left = (before > step) & (given[y] < ask)
                y, base, before = y[left], base[left], before[left]
                have_y, need_y, ends, done = have[y], need[y], np.sort(before), 0
            if not len(y):
                break
            step += 1
            x = base - step
            at = np.flatnonzero((have.take(x, mode="wrap") >= need_y) & (have_y >= need.take(x, mode="wrap")))
            at = at[(before[at] >= step) & (given[y[at]] < ask)]
            if not len(at):
                continue
            late, early = y[at], x[at]
            near = _apart(sig[late], sig[early]) * (a + b) <= (n[late] + n[early]) * (b - a)
            at, late, early = at[near], late[near], early[near]
            of_late, of_early = order[late], order[early]
            side = rows["side"][of_late]
            near = (a * n[late] <= b * n[early]) & (a * n[early] <= b * n[late]) & ((side == 0) | (side != rows["side"][of_early]))
            near &= np.any([rows[c][of_late] != rows[c][of_early] for c in ("doc", "part", "line")], axis=0)
            at, late, early = at[near], late[near], early[near]
            ys.append(late)
            xs.append(early)
            given[late] += 1
            full = given[late] >= ask
            more[late[full]] |= before[at[full]] > step
            done += int(full.sum())
    marked = np.zeros(size, bool)
    marked[order] = more
    none = [np.empty(0, np.int64)]
    return order[np.concatenate(ys or none)], order[np.concatenate(xs or none)], marked


def _enough_groups(t: Fraction) -> Column:
    """Whether a pair shares as many prefix words as its sizes force.

    Two sets of the similarity share at least ``o`` words, so at most ``n - o``
    of each are not shared, and all but that many places of each prefix hold
    shared words, the first ones in both.
    """
    a, b = t.numerator, t.denominator
    y, x = F.col("y_n").cast("long"), F.col("x_n").cast("long")
    o = F.expr(f"(cast(y_n as long) + x_n) * {a} div {a + b}") + F.when((y + x) * a % (a + b) == 0, 0).otherwise(1)

    def forced(n: Column, name: str) -> Column:
        prefix = n - F.expr(f"(cast({name} as long) * {a} + {b - 1}) div {b}") + 1
        return prefix - (n - o)

    return F.col("groups") >= F.least(F.lit(1 + FURTHER), forced(y, "y_n"), forced(x, "x_n"))


def candidate_pairs(sets: DataFrame, blocks: np.ndarray, buckets: int, t: Fraction = SIMILARITY, ask: int = FIRST_ASK,
                    asked: DataFrame | None = None) -> DataFrame:
    """Pairs (y, earlier x) of line sets that share a prefix word and pass the filters, for the sets of ``asked`` (all if None).

    Each y gets at most ``ask`` of every group; ``more`` tells that there may be
    others. ``groups`` counts the groups that a pair shares, and ``enough``
    tells whether they are as many as a match must share (a match that a full
    group left out has too few; its y has ``more`` and asks again). With ``asked``
    only groups with a set that is asked again are looked at.
    """
    shared, again, wanted = sets.sparkSession.sparkContext.broadcast(blocks), None, None
    if asked is not None:
        n = asked.count()
        again = _bits(asked.select("doc", "part", "line"), lambda b: _place(*(c.to_numpy(zero_copy_only=False) for c in b.columns)), n)

        def words(batch: pa.RecordBatch) -> np.ndarray:
            found = [prefix[np.repeat(_in(again.value, _place(rows["doc"], rows["part"], rows["line"])), rows["size"])]
                     for rows, prefix in _each_block(batch)]
            return _mixed(np.unique(np.concatenate(found)).astype(np.uint64), 0)

        wanted = _bits(sets, words, 8 * n)  # about as many words as that

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def packed() -> Iterator[pa.RecordBatch]:
            rows = {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}
            before = np.cumsum([0] + [len(h[0]["n"]) for h in held[:-1]])
            of, at, word = (np.concatenate([h[k] + (b if k == 1 else 0) for h, b in zip(held, before, strict=True)]) for k in (1, 2, 3))
            yield from _postings(rows, of, at, word, shared.value, buckets)

        for batch in batches:
            for rows, word in _each_block(batch):
                of = np.repeat(np.arange(len(rows["size"])), rows["size"])
                at = _spread(np.zeros(len(rows["size"]), np.int64), rows["size"])
                rows["ask"] = np.ones(len(rows["size"]), bool)
                if again is not None:
                    rows["ask"] = _in(again.value, _place(rows["doc"], rows["part"], rows["line"]))
                    keep = _in(wanted.value, _mixed(word.astype(np.uint64), 0))
                    at, word = at[keep], word[keep]
                    used, of = np.unique(of[keep], return_inverse=True)
                    rows = {c: v[used] for c, v in rows.items()}
                held.append((rows, of, at, word))
                n += len(word)
                if n >= PACK_ROWS:
                    yield from packed()
                    held, n = [], 0
        if n:
            yield from packed()

    def pairs(rows: dict[str, np.ndarray], _: np.ndarray) -> Iterator[pa.RecordBatch]:
        y, x, more = _matched(rows, t, ask)
        for i in range(0, len(y), 1 << 16):
            yy, xx = y[i:i + (1 << 16)], x[i:i + (1 << 16)]
            yield pa.record_batch([*(pa.array(rows[c][yy]) for c in ID), *(pa.array(rows[c][xx]) for c in ID),
                                   pa.array(more[yy])], names=[f"{s}_{c}" for s in "yx" for c in ID] + ["more"])

    found = _by_bucket(sets.mapInArrow(run, BLOCK), buckets, POSTING, pairs, PAIR)
    return found.groupBy(*(f"{s}_{c}" for s in "yx" for c in ID)).agg(
        F.max("more").alias("more"), F.count(F.lit(1)).alias("groups")).withColumn(
        "enough", _enough_groups(t)).filter("enough or more")


def words_of(docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """``(doc, part, line, n, words)`` of the lines of ``needed(doc, part, line)``, about ``n``, and of some others.

    The documents are parsed again rather than kept; a bit filter over the
    needed places lets few other lines through, and one over their ids few other documents.
    """
    docs = possibly_in(docs, id_filter(needed.select("doc"), "doc"), _id()).filter("__in")
    places = _bits(needed.select("doc", "part", "line"), lambda b: _place(*(c.to_numpy(zero_copy_only=False) for c in b.columns)), n)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 1):
            ids, part = _ids(piece.column(0)), piece.column(2).to_numpy(zero_copy_only=False)
            p = Parsed(piece.column(1), lambda doc, no: _in(places.value, _place(ids[doc], part[doc], no)))  # noqa: B023
            line, start, h = p.sets(None)
            if not len(line):
                continue
            n = np.diff(np.append(start, len(h)))
            yield pa.record_batch([
                pa.array(ids[p.doc[line]]), pa.array(part[p.doc[line]]), pa.array(p.no[line], pa.int32()), pa.array(n, pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.append(start, len(h)), pa.int32()), pa.array(h.view(np.int64)))],
                names=[*ID, "words"])

    return docs.select("doc_id", "text", "__part").mapInArrow(lines, "doc long, part long, line int, n int, words array<long>")


def _checked(docs: DataFrame, pairs: DataFrame, t: Fraction) -> DataFrame:
    """``ID`` of the y of ``pairs`` that reach the similarity with their x."""
    a, b = t.numerator, t.denominator
    ends = [pairs.select(*(F.col(f"{s}_{c}").alias(c) for c in ID)) for s in "yx"]
    words = words_of(docs, ends[0].unionByName(ends[1]), 2 * pairs.count())
    words = written(words.groupBy(*ID).agg(F.min("words").alias("words")), "words")
    checked = pairs.select(*(f"{s}_{c}" for s in "yx" for c in ID))
    for s in "yx":
        own = words.select(*(F.col(c).alias(f"{s}_{c}") for c in ID), F.col("words").alias(f"{s}_words"))
        checked = checked.join(own, [f"{s}_{c}" for c in ID])
    shared = F.size(F.array_intersect("y_words", "x_words"))
    hits = checked.filter(shared * (a + b) >= a * (F.col("y_n") + F.col("x_n")))
    return written(hits.select(*(F.col(f"y_{c}").alias(c) for c in ID)).distinct(), "hits")


def _matches(docs: DataFrame, sets: DataFrame, blocks: np.ndarray, buckets: int, t: Fraction, ask: int) -> DataFrame:
    """``ID`` of the line sets that reach the similarity with an earlier one.

    One earlier match is enough. First each set is checked with the candidate
    that it shares most groups with, then sets without a match with all their
    other candidates, those that had to leave out candidates asking again.
    """
    y = [f"y_{c}" for c in ID]

    def unmatched(rows: DataFrame, hits: DataFrame) -> DataFrame:
        return rows.join(hits.select(*(F.col(c).alias(f"y_{c}") for c in ID)), y, "left_anti")

    pairs = written(candidate_pairs(sets, blocks, buckets, t, ask), "pairs")
    fit = pairs.filter("enough")
    best = fit.groupBy(*y).agg(F.max(F.struct("groups", *(f"x_{c}" for c in ID))).alias("best"),
                                 F.count(F.lit(1)).alias("n"))
    best = written(best.select(*y, *(f"best.x_{c}" for c in ID), "n"), "best")
    out = _checked(docs, best, t)
    others = unmatched(fit.join(best.filter("n > 1").select(*y), y, "left_semi"), out).select(pairs.columns)
    while True:
        unsure = written(unmatched(pairs.filter("more").select(*y).distinct(), out), "unsure")
        if unsure.limit(1).count():
            ask *= RAISE
            asked = unsure.select(*(F.col(f"y_{c}").alias(c) for c in ID))
            pairs = written(candidate_pairs(sets, blocks, buckets, t, ask, asked), "pairs")
            todo = pairs.filter("enough") if others is None else pairs.filter("enough").unionByName(others).dropDuplicates(
                [f"{s}_{c}" for s in "yx" for c in ID])
        elif others is None:
            return out
        else:
            pairs, todo = pairs.filter("false"), others
        out = out.unionByName(_checked(docs, written(todo, "pairs"), t))
        others = None


def later_lines(docs: DataFrame, t: Fraction = SIMILARITY, first_ask: int = FIRST_ASK) -> DataFrame:
    """``(doc, part, lines)``: the line numbers, from 0, that match an earlier line, for each document that has any.

    Lines match if the Jaccard similarity of their word sets is at least ``t``;
    lines are ordered by doc_id, then ``__part`` (see ``with_part``), then
    number. Lines of equal word sets are one
    set, at its first place, so that copies are never paired. Sets that share
    one of their rarest words meet in that word's group; candidates that pass
    the length, position and signature filters are checked word by word (by
    64-bit word hashes).
    """
    context = docs.sparkSession.sparkContext
    counts = word_counts(docs)
    buckets = max(context.defaultParallelism, int(counts.sum()) // BUCKET_WORDS)
    lines = set_blocks(docs, context.broadcast(counts), buckets, t)
    sets = lines.filter("octet_length(prefix) > 0")
    gone = _matches(docs, sets, hot_counters(sets, counts), buckets, t, first_ask)
    later = set_rows(lines.filter("octet_length(prefix) = 0")).select(*ID).unionByName(gone)
    return later.groupBy("doc", "part").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, t: Fraction = SIMILARITY, first_ask: int = FIRST_ASK) -> DataFrame:
    """``docs`` with ``text`` less its later lines, and the columns ``n_lines`` and ``n_removed``.

    One row for each row. A null text stays null and has no lines; an empty
    text has one line. Lines without words always stay. Rows without doc_id
    stand before all others; they, and different texts under one doc_id, stand
    in the order of a hash of the text. Each distinct (doc_id, text) has places
    of its own and loses its own lines only; rows repeated with the same doc_id
    (or none) and text share their places and keep the same lines. An empty
    table gives no rows. Other columns are passed on; ``n_lines`` and
    ``n_removed`` are replaced, and names that begin with two underscores are taken.
    """
    repeated = repeated_ids(docs.select("doc_id", "text"))
    later = written(later_lines(with_part(docs.select("doc_id", "text"), repeated), t, first_ask).select(
        F.col("doc").alias("__doc"), F.col("part").alias("__part"), F.col("lines").alias("__later")), "later-lines")
    marked = possibly_in(with_part(docs, repeated), id_filter(later, "__doc"), _id())
    later = later.hint("merge")  # a broadcast of it would fit in no driver at scale
    joined = marked.filter("__in").withColumn("__doc", _id()).join(later, ["__doc", "__part"], "left").unionByName(
        marked.filter("not __in"), allowMissingColumns=True)
    joined = joined.withColumn("__lines", F.when(F.col("__later").isNotNull(), F.split("text", "\n", -1)))  # once a row, not once a line
    lines = F.col("__lines")
    n_lines = 1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    kept = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__later")))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    return joined.select(
        *(F.when(F.col("__later").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(c)
          for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__later"), F.lit(0)).alias("n_removed"))
