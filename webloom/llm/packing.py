"""Lexical retrieval packing: documents that share rare tokens fill a window together.

Every document becomes token ids and a closing id. Whole windows of a long
document stand alone; its tail, and every shorter document, is packed. Tails
are dealt to shards by the token of highest BM25 weight in the whole document,
a token that many documents share to several shards, so a shard is of bounded
size. A shard's task builds an inverted index of BM25 weights, whose document
frequencies and mean length are those of the whole corpus, and fills windows: a
seed's unused neighbours follow it by falling BM25 score until the window is
full. The neighbour that reaches over the end is cut, and its rest seeds the
next window. Documents that share no token with any unused one are followed by
the next of the shard. What is left of a shard at its end becomes sequences of
falling powers of two, so nothing is padded.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices, written

WINDOW = 1024
#: The id that closes a document.
CLOSING = 0
#: BM25: saturation of counts, and how much a document's length matters.
K1, B = 1.2, 0.75
#: Index entries (a document and one of its distinct tokens) that a shard holds, about.
SHARD_ENTRIES = 200_000
#: Share of a shard's documents, one in so many, from which a token has a row of weights.
COMMON = 16
#: Text with characters from here on, or with a special token's string, is encoded by ``tokenizers`` itself; the rank form
#: of the same vocabulary, four times faster, gives the same ids for the rest.
PLAIN_BELOW = 0x250

TOKENS = "key long, doc_id long, n_tokens long, ids binary, first_sequence long, frequencies binary, n_docs long"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of texts, by the vocabulary file at ``path`` (``byte_bpe_50k.json`` of the installed vocabularies if None)."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.size = self.slow.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if path is None or ranks is not None:
            import base64

            import tiktoken
            from tiktoken_ext.openai_public import r50k_pat_str  # splits like public_tokenizers.PATTERN, faster
            with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=r50k_pat_str, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text and the closing one."""
        if self.fast and self._plain(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.slow.encode(text, add_special_tokens=False).ids
        ids.append(CLOSING)
        return np.frombuffer(array("H" if self.kind is np.uint16 else "I", ids), self.kind)

    def _plain(self, text: str) -> bool:
        if not text.isascii() and np.frombuffer(text.encode("utf-32-le"), np.uint32).max() >= PLAIN_BELOW:
            return False
        return not any(s in text for s in self.special)


@lru_cache(maxsize=1)
def encoder(path: str | None, ranks: str | None) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path, ranks)


def _terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, token, count)`` of the distinct tokens of documents, without the closing ids, in this order."""
    sizes = np.array([len(i) - 1 for i in ids], np.int64)
    every = np.concatenate([np.zeros(0, np.uint16), *(i[:-1] for i in ids)])
    bits = int(every.max(initial=0)).bit_length()
    kind = np.int32 if bits + len(ids).bit_length() < 32 else np.int64  # the narrower sorts faster
    both = np.repeat(np.arange(len(ids), dtype=kind) << kind(bits), sizes) | every.astype(kind)
    both.sort()
    at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])
    doc, token = both[at] >> kind(bits), both[at] & kind((1 << bits) - 1)
    return doc.astype(np.int64), token.astype(np.int64), np.diff(at, append=len(both))


def tokenized(docs: DataFrame, path: str | None = None, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """A written table of each row's ids (little-endian, 16 bits if the vocabulary fits), and a row of document frequencies per task.

    ``key`` tells rows apart whatever their doc_id; ``first_sequence`` numbers the
    whole windows of a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, ranks), TaskContext.get().partitionId() << 40
        seen, n, windows, tokens = np.zeros(encode.size, np.int64), 0, 0, 0
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                            ("first_sequence", pa.int64()), ("frequencies", pa.binary()), ("n_docs", pa.int64())])
        for b in slices(batches, 128):
            ids = [encode(t or "") for t in b.column(1).to_pylist()]
            full = np.array([len(i) // window for i in ids])
            seen += np.bincount(_terms(ids)[1], minlength=len(seen))
            starts = windows + np.cumsum(full) - full
            yield pa.record_batch([
                pa.array(task + n + np.arange(len(ids))), b.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([i.tobytes() for i in ids], pa.binary()), pa.array((task + starts) * 2),
                pa.nulls(len(ids), pa.binary()), pa.nulls(len(ids), pa.int64())], schema=schema)
            n, windows, tokens = n + len(ids), windows + int(full.sum()), tokens + sum(map(len, ids))
        yield pa.record_batch([[None], [None], [tokens], [None], [None], [seen.tobytes()], [n]], schema=schema)

    table = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)
    return written(table, "tokens", compression="zstd")


class Weights:
    """BM25 weights of tokens in documents, by the frequencies of the whole corpus."""

    def __init__(self, frequencies: np.ndarray, n_docs: int, mean_length: float):
        self.idf = np.log1p((n_docs - frequencies + 0.5) / (frequencies + 0.5))
        self.mean = mean_length

    def __call__(self, token: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.idf[token] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


def _corpus(tokens: DataFrame) -> Weights | None:
    """The corpus statistics: sums of the tasks' counters, one per token of the vocabulary."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for counts, n, size in zip(b.column(0), b.column(1), b.column(2), strict=True):
                f = np.frombuffer(counts.as_py(), np.int64)
                at = np.flatnonzero(f)
                yield pa.record_batch([pa.array([-1, -2, *at]), pa.array([n.as_py(), size.as_py(), *f[at]])], names=["token", "n"])

    parts = tokens.filter("frequencies IS NOT NULL").select("frequencies", "n_docs", "n_tokens")
    rows = parts.mapInArrow(split, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    total = {r.token: r.n for r in rows}  # at most the vocabulary and two
    n_docs = total.pop(-1, 0)
    size = total.pop(-2, 0)
    if not n_docs:
        return None
    f = np.zeros(max(total, default=0) + 1, np.int64)
    f[list(total)] = list(total.values())
    return Weights(f, n_docs, max(1.0, (size - n_docs) / n_docs))


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)
            for x, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True)]


def _weighed(ids: list[np.ndarray], weights: Weights):
    """Terms and weights of documents, where each document's begin, and its top token (-1 without tokens)."""
    doc, token, count = _terms(ids)
    w = weights(token, count, np.array([len(i) - 1 for i in ids])[doc])
    starts = np.searchsorted(doc, np.arange(len(ids) + 1))
    top = np.full(len(ids), -1)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        most = np.zeros(len(ids), np.float32)
        most[some] = np.maximum.reduceat(w, starts[some])
        at = np.flatnonzero(w == most[doc])[::-1]
        top[doc[at]] = token[at]  # of equal weights the smallest token, which is written last
    return token, w, starts, top


def _shards(tokens: DataFrame, weights: Weights, entries: int) -> dict[int, tuple[int, int]]:
    """First shard and number of shards of each top token; small tokens share a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(weights.idf) + 1, np.int64)
        for b in slices(batches):
            _, _, starts, top = _weighed(_ids(b), weights)
            held += np.bincount(top + 1, np.diff(starts) + 1, len(held)).astype(np.int64)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array(at - 1), pa.array(held[at])], names=["top", "n"])

    rows = tokens.filter("ids IS NOT NULL").select("ids", "n_tokens").mapInArrow(run, "top long, n long")
    out, shard, room = {}, -1, 0
    for r in rows.groupBy("top").agg(F.sum("n").alias("n")).orderBy("top").collect():  # at most the vocabulary and one
        if r.n > room:
            out[r.top] = (shard + 1, -(-r.n // entries))
            shard += out[r.top][1]
            room = entries - r.n  # nothing is added to tokens of several shards
        else:
            out[r.top] = (shard, 1)
            room -= r.n
    return out


def _tails(tokens: DataFrame, weights: Weights, shards: dict[int, tuple[int, int]], window: int) -> DataFrame:
    """Each document's last, partial window with its shard and the weights of its whole text."""
    first, many = np.zeros(len(weights.idf) + 1, np.int64), np.ones(len(weights.idf) + 1, np.int64)
    for top, (a, b) in shards.items():
        first[top + 1], many[top + 1] = a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = _ids(b)
            token, w, cut, top = _weighed(ids, weights)
            key = b.column("key").to_numpy()
            mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            token = token.astype(np.uint32)
            keep = [i for i, x in enumerate(ids) if len(x) % window]
            yield pa.record_batch([
                pa.array((first[top + 1] + mixed.astype(np.int64) % many[top + 1])[keep]), pa.array(key[keep]),
                b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array([len(ids[i]) for i in keep], pa.int64()),
                pa.array([ids[i][len(ids[i]) // window * window:].astype(np.uint32).tobytes() for i in keep], pa.binary()),
                pa.array([token[cut[i]:cut[i + 1]].tobytes() for i in keep], pa.binary()),
                pa.array([w[cut[i]:cut[i + 1]].tobytes() for i in keep], pa.binary())],
                names=["shard", "key", "doc_id", "n_tokens", "tail", "tokens", "weights"])

    rows = tokens.filter("ids IS NOT NULL").select("key", "doc_id", "ids", "n_tokens")
    return rows.mapInArrow(run, "shard long, key long, doc_id long, n_tokens long, tail binary, tokens binary, weights binary")


class Index:
    """Inverted index of a shard: for each token, the documents that hold it and their BM25 weights.

    A token that at least one document in ``COMMON`` holds has a row of weights, rarer ones
    have lists, so the index takes at most ``COMMON`` numbers per entry.
    """

    def __init__(self, tokens: list[np.ndarray], weights: list[np.ndarray], live: np.ndarray):
        self.live = live
        sizes = np.array([len(tokens[i]) for i in live], np.int64)
        token = np.concatenate([np.zeros(0, np.uint32), *(tokens[i] for i in live)])
        order = np.argsort(token, kind="stable")
        self.doc = np.repeat(np.arange(len(live)), sizes)[order]
        self.weight = np.concatenate([np.zeros(0, np.float32), *(weights[i] for i in live)])[order]
        self.known, self.at, self.size = np.unique(token[order], return_index=True, return_counts=True)
        common = self.size * COMMON >= len(live)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.rows = np.zeros((int(common.sum()), len(live)), np.float32)
        dense = np.repeat(self.row, self.size)
        some = dense >= 0
        self.rows[dense[some], self.doc[some]] = self.weight[some]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 score of every indexed document (of ``live``) for the distinct tokens of a query."""
        k = np.searchsorted(self.known, query)
        query, k = query[k < len(self.known)], k[k < len(self.known)]
        k = k[self.known[k] == query]
        row = self.row[k]
        out = self.rows[row[row >= 0]].sum(0, dtype=np.float32)
        k = k[row < 0]
        size = self.size[k]
        at = np.repeat(self.at[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return out + np.bincount(self.doc[at], self.weight[at], len(self.live))


def fill_windows(sizes: np.ndarray, tokens: list[np.ndarray], weights: list[np.ndarray], window: int = WINDOW):
    """Windows as lists of ``(document, start in its tail, length)``, all full but the last.

    The next seed is the rest of a cut document, or else the first unused one.
    """
    unused = np.ones(len(sizes), bool)
    index, left, rest, nxt = Index(tokens, weights, np.arange(len(sizes))), len(sizes), None, 0
    while rest or left:
        if rest is None:
            while not unused[nxt]:
                nxt += 1
            rest = (nxt, 0)
            unused[nxt] = False
            left -= 1
        (seed, start), rest = rest, None
        pieces, room = [(seed, start, int(sizes[seed]) - start)], window - int(sizes[seed]) + start
        if room and left:
            if 2 * left < len(index.live):  # used documents no longer cost time
                index = Index(tokens, weights, np.flatnonzero(unused))
            score = index.scores(tokens[seed])
            open_ = np.flatnonzero(unused[index.live])
            for i in index.live[open_[np.argsort(-score[open_], kind="stable")]]:  # no score: in the order of the shard
                length = min(room, int(sizes[i]))
                pieces.append((int(i), 0, length))
                unused[i] = False
                left -= 1
                room -= length
                if length < sizes[i]:
                    rest = (int(i), length)
                if not room:
                    break
        yield pieces


def _powers(pieces: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """A window cut into sequences of falling powers of two, or as it is if full."""
    total = sum(p[2] for p in pieces)
    goals = [window] if total == window else [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
    pieces = pieces[::-1]
    for goal in goals:
        out = []
        while goal:
            i, start, length = pieces.pop()
            take = min(goal, length)
            out.append((i, start, take))
            goal -= take
            if take < length:
                pieces.append((i, start + take, length - take))
        yield out


def pack(docs: DataFrame, path: str | None = None, ranks: str | None = None, window: int = WINDOW,
         shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``: a row per piece of every row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit integers. The columns doc_id and text are
    read, others are ignored. A null or empty text is its closing id alone; rows that
    repeat, or share or lack a doc_id, are packed each. An empty table gives no pieces.
    """
    tokens = tokenized(docs, path, ranks, window)
    weights = _corpus(tokens)
    if weights is None:
        return docs.sparkSession.createDataFrame([], PIECES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for doc_id, ids, first in zip(b.column("doc_id").to_pylist(), _ids(b), b.column("first_sequence").to_pylist(), strict=True):
                k = len(ids) // window
                parts = ids[:k * window].astype(np.uint32).reshape(k, window)
                yield _batch([doc_id] * k, range(0, k * window, window), [window] * k, [p.tobytes() for p in parts],
                             [len(ids)] * k, range(first, first + 2 * k, 2), [0] * k)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        cols = {c: group.column(c).to_pylist() for c in ("doc_id", "n_tokens", "tail")}
        shard = group.column("shard")[0].as_py()
        sizes = np.array([len(t) // 4 for t in cols["tail"]])
        index = [[np.frombuffer(x, kind) for x in group.column(c).to_pylist()]
                 for c, kind in (("tokens", np.uint32), ("weights", np.float32))]
        rows, sequence = [], (shard << 32) * 2 + 1
        for pieces in fill_windows(sizes, *index, window):
            for part in _powers(pieces, window):
                offset = 0
                for i, start, length in part:
                    n = cols["n_tokens"][i]
                    rows.append((cols["doc_id"][i], n // window * window + start, length,
                                 cols["tail"][i][4 * start:4 * (start + length)], n, sequence, offset))
                    offset += length
                sequence += 2
        return pa.Table.from_batches([_batch(*zip(*rows, strict=True))])

    long = tokens.filter((F.col("n_tokens") >= window) & F.col("ids").isNotNull())
    full = long.select("doc_id", "n_tokens", "ids", "first_sequence").mapInArrow(whole, PIECES)
    tails = _tails(tokens, weights, _shards(tokens, weights, shard_entries), window)
    return full.unionByName(tails.groupBy("shard").applyInArrow(packed, PIECES))


def _batch(*columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                           names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids, doc_ids)``: each sequence's ids joined in order, at most a window of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.expr("aggregate(p.ids, x'', (a, b) -> concat(a, b))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in the place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

