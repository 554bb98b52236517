"""Topic models (L1-L7): the variational EM of the reference job on blocks.

  * Documents are packed once into blocks of a bounded number of (document,
    term) entries, one row each: ``doc_blocks``. Topics ``lambda`` are a written table of
    term blocks of bounded size: ``term_blocks``. ``block_needs`` lists the terms of
    each term block that each document block has.
  * An iteration joins the needs with lambda by term block, cuts out the
    needed rows, and brings them to their document block: a topic row travels once per
    document block, not once per document.
  * E-step: numpy fixed-point iterations over a document block. It emits the block's
    sums of count * phi per term block, and the sufficient statistics.
  * M-step: sums per term block, added up in a stream of batches, so that a task holds one
    term block whatever the number of documents. Terms that no document has keep their value.
  * alpha: Newton steps on K numbers on the driver, between jobs; the only other thing that
    the driver sees are the K totals that normalise the topics.

MLlib's ``LDA`` is an option (``fit_lda_mllib``); it keeps vocabulary and topics on the driver.
"""

from __future__ import annotations

import gc
import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.vectorize import cell_numbers
from webloom.sources.tables import discard, materialized

try:  # ship this module's per-block code with the task (no package install on executors)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

# Fixed values of the reference job.
ALPHA0 = 0.1
ETA = 1e-12
INNER_ITERATIONS = 100
OUTER_ITERATIONS = 20
ALPHA_MAX_ITERATIONS = 1000
ALPHA_TOLERANCE = 1e-6
ALPHA_DECAY = 0.8
ALPHA_MAX_DECAY = 11
#: Term block and term id of the sufficient statistics.
SUFF_STAT_ID = -1
#: Numbers (entries times topics) that a document block's arrays hold, and a term block's.
DOC_BLOCK_NUMBERS, TERM_BLOCK_NUMBERS = 1 << 18, 1 << 17
#: How many of these arrays a document block holds once there are blocks for every core: documents of a larger block share
#: more terms, so that fewer topic rows travel for each of its entries.
DOC_BLOCK_GROWTH = 96
#: Document blocks up to which their keys are chosen so that partitions get equal numbers of them.
EVEN_BLOCKS = 2048
#: Document blocks that share a copy of a term block.
MEMBERS = 64
#: Numbers that the topic rows of documents worked on together hold: they stay in a core's cache through all inner iterations.
GROUP_NUMBERS = 1 << 17
#: Words of a document per topic below which its factors could all become 0, if the largest were not made 1.
FEW_WORDS = 0.1


# ------------------------------------------------------------------ special functions (numpy)

def digamma(x):
    """Six steps of the recurrence, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    y = x + 6
    f = 1.0 / (y * y)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + i) for i in range(6))


def trigamma(x):
    x = np.asarray(x, dtype=float)
    y = x + 6
    f = 1.0 / (y * y)
    series = f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30))))
    return 1 / y + f / 2 + series + sum(1.0 / (x + i) ** 2 for i in range(6))


# ------------------------------------------------------------------ MLlib path

def fit_lda_mllib(doc_terms_arrays: DataFrame, k: int = 10, max_iter: int = 20, seed: int = 7,
                  terms_col: str = "terms", subsampling_rate: float = 1.0):
    """L1 by MLlib: term counts over the whole vocabulary + online LDA (alpha
    learned). Every iteration reads all documents; a lower ``subsampling_rate``
    is the caller's choice. The vocabulary and the K x V matrix are held
    by the driver; ``fit_lda_em`` reads all documents and has no such bound."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    terms = doc_terms_arrays.select(F.explode(terms_col).alias("term")).agg(F.count_distinct("term")).first()[0]
    cv = CountVectorizer(inputCol=terms_col, outputCol="features", vocabSize=max(1, terms)).fit(doc_terms_arrays)
    feats = cv.transform(doc_terms_arrays).select("doc_id", "features").persist()
    model = LDA(k=k, maxIter=max_iter, optimizer="online", optimizeDocConcentration=True, subsamplingRate=subsampling_rate, seed=seed).fit(feats)
    feats.unpersist()
    return model, cv.vocabulary


def describe_topics_mllib(model, vocabulary, n: int = 10) -> DataFrame:
    """(k, rank, term, weight) for the n heaviest terms of each topic."""
    spark = model.describeTopics(n).sparkSession
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(vocabulary)], "term_id int, term string")
    t = model.describeTopics(n).select(
        F.col("topic").alias("k"),
        F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    t = t.select("k", "rank", F.col("tw.termIndices").alias("term_id"), F.col("tw.termWeights").alias("weight"))
    return t.join(vocab, "term_id").select("k", "rank", "term", "weight")


# ------------------------------------------------------------------ EM on blocks

def start_values(term_ids: np.ndarray, k: int, v: int, seed: int = 0) -> np.ndarray:
    """Random start u1 / (u2 + V) per (term, topic): u are 32-bit integer hashes of seed, term, topic and 0 or 1."""
    x = (np.asarray(term_ids, np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64)) * np.uint64(2)

    def unif(salt):
        h = ((x + np.uint64(salt + 2654435769)) ^ np.uint64(seed)) & np.uint64(0xFFFFFFFF)
        for _ in range(2):
            h = ((h ^ (h >> np.uint64(16))) * np.uint64(73244475)) & np.uint64(0xFFFFFFFF)
        return ((h ^ (h >> np.uint64(16))).astype(float) + 1) / 2.0 ** 32

    return unif(0) / (unif(1) + v)


def doc_blocks(corpus: DataFrame, k: int) -> DataFrame:
    """Written table (block, terms, starts, index, counts): documents packed by a hash of their id.

    ``corpus`` has a row per (doc_id, term_id, count), or is that of ``packed_documents``.
    ``terms`` are the block's distinct term ids, ``index`` (as ``_steps``) and ``counts`` its entries by
    document, ``starts`` where each document begins.
    """
    entries, packed = max(1, DOC_BLOCK_NUMBERS // k), "terms" in corpus.columns
    if packed:
        rows, total = corpus, corpus.agg(F.sum("size")).first()[0] or 0
    else:
        rows = corpus.select("doc_id", F.col("term_id").cast("long").alias("term_id"), F.col("count").cast("double").alias("count"))
        total = rows.count()
    small = max(1, -(-total // entries))
    n = max(-(-small // DOC_BLOCK_GROWTH), min(small, 2 * corpus.sparkSession.sparkContext.defaultParallelism))

    def pack(table: pa.Table) -> pa.Table:
        doc = table.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        if packed:
            order = np.argsort(doc, kind="stable")
            sizes, ids, own = (table.column(c).take(pa.array(order)).to_pylist() for c in ("size", "terms", "counts"))
            doc, ids, counts = np.repeat(doc[order], sizes), cell_numbers(sizes, ids), cell_numbers(sizes, own).astype(float)
        else:
            ids, counts = table.column("term_id").to_numpy(), table.column("count").to_numpy()
            order = np.lexsort((ids, doc))
            doc, ids, counts = doc[order], ids[order], counts[order]
        terms, index = np.unique(ids, return_inverse=True)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        row = [table.column("block")[0].as_py(), terms.astype(np.int64).tobytes(), starts.astype(np.int64).tobytes(),
               _steps(index), _short(counts).tobytes()]
        return pa.table([[x] for x in row], names=["block", "terms", "starts", "index", "counts"])

    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    if n <= EVEN_BLOCKS:
        dealt = F.element_at(F.expr(f"array({', '.join(f'{key}L' for key in even_keys(corpus.sparkSession, n))})"), (dealt + 1).cast("int"))
    return materialized(rows.withColumn("block", dealt).groupBy("block").applyInArrow(
        pack, "block long, terms binary, starts binary, index binary, counts binary"), "lda-documents")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers, small ones first, that the hash of a shuffle deals out evenly to its partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each, width, keys = -(-n // parts), n + 8 * parts, []
    while len(keys) < n:
        dealt = np.array([r[0] for r in spark.range(width).select(F.pmod(F.hash("id"), F.lit(parts))).collect()])
        order = np.argsort(dealt, kind="stable")
        rank = np.empty(width, int)
        rank[order] = np.arange(width) - np.searchsorted(dealt[order], dealt[order])
        keys, width = np.flatnonzero(rank < each)[:n].tolist(), 2 * width
    return keys


def _steps(index: np.ndarray) -> bytes:
    """The steps between rising places, all first bytes, then all second ones and so on: the upper ones, mostly 0, compress to little."""
    return np.diff(index, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(cell: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return np.cumsum(steps, dtype=np.uint32).view(np.int32)


def _short(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each if all of them are whole and small, as doubles otherwise."""
    short = counts.astype(np.uint16) if counts.size and counts.min() >= 0 and counts.max() < 1 << 16 else counts
    return short if np.array_equal(short, counts) else counts


def block_needs(blocks: DataFrame, k: int) -> DataFrame:
    """Written table (term_block, members): the rows of each term block that document blocks have.

    Each of the ``members`` is a document block, the ``offsets`` of its rows in the term block and where they
    begin in its terms; at most ``MEMBERS`` of them share a row, and so a copy of the term block.
    """
    size, kind = _term_block_size(k), _offset_type(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                terms = np.frombuffer(terms, np.int64)
                at = np.flatnonzero(np.diff(terms // size, prepend=-1))
                yield pa.record_batch([pa.array(terms[at] // size), pa.array(np.full(len(at), block)), pa.array(at),
                                       pa.array([(p % size).astype(kind).tobytes() for p in np.split(terms, at[1:])], pa.binary())],
                                      names=["term_block", "block", "at", "offsets"])

    rows = blocks.select("block", "terms").mapInArrow(run, "term_block long, block long, at long, offsets binary")
    rows = rows.groupBy("term_block", F.floor(F.col("block") / MEMBERS).alias("part")).agg(
        F.collect_list(F.struct("block", "at", "offsets")).alias("members"))
    return materialized(rows.select("term_block", "members"), "lda-needs")


def _term_block_size(k: int) -> int:
    return max(1, TERM_BLOCK_NUMBERS // k)


def _offset_type(k: int) -> type:
    return np.uint16 if _term_block_size(k) <= 1 << 16 else np.uint32


def term_blocks(spark: SparkSession, k: int, v: int, seed: int = 0) -> DataFrame:
    """Written table (term_block, lam, totals) of the random start; ``totals`` are the block's sums per topic."""
    size = _term_block_size(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0).to_pylist():
                yield _lambda_row(block, start_values(np.arange(block * size, min(v, (block + 1) * size)), k, v, seed))

    return materialized(spark.range(-(-v // size)).mapInArrow(run, _LAMBDA), "lda-topics")


_LAMBDA = "term_block long, lam binary, totals array<double>"
_SUMS = "term_block long, offsets binary, sums binary"


def _lambda_row(block: int, lam: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([block], pa.int64()), pa.array([lam.tobytes()], pa.binary()),
                            pa.array([lam.sum(0)], pa.list_(pa.float64()))], names=["term_block", "lam", "totals"])


def _alike(sizes: np.ndarray, entries: int) -> Iterator[np.ndarray]:
    """Documents of near sizes, of so many entries together if each had those of the largest; a longer one stands alone."""
    order = np.argsort(sizes, kind="stable")
    rising, i = sizes[order].tolist(), 0
    while i < len(rising):
        j, widest = i + 1, rising[i] + rising[i] // 8 + 8
        while j < len(rising) and rising[j] <= widest and rising[j] * (j + 1 - i) <= entries:
            j += 1
        yield order[i:j]
        i = j


def _digamma_weights(x: np.ndarray, out: np.ndarray, room: list[np.ndarray], scaled: bool) -> None:
    """exp(digamma(x)) in ``out``, in as few passes as possible; ``scaled``: over the largest of each row, which cancels."""
    t, a, s = room
    np.multiply(np.add(x, 5, t), x, t)  # sum of 1 / (x + i), i to 5: three pairs, whose products are t, t + 4 and t + 6
    np.multiply(np.add(np.multiply(np.add(t, 10, a), t, a), 24, a), t, a)
    np.add(np.multiply(np.add(np.multiply(t, 6, s), 40, s), t, s), 48, s)
    np.divide(np.multiply(s, np.add(x, 2.5, t), s), a, s)
    np.divide(1.0, np.add(x, 6, out), t)
    np.multiply(t, t, a)
    np.add(s, np.multiply(t, 0.5, t), s)
    np.multiply(a, -1 / 132, t)
    for c in (1 / 240, -1 / 252, 1 / 120, -1 / 12):
        np.multiply(np.add(t, c, t), a, t)
    np.subtract(t, s, t)
    if scaled:
        t += np.log(out)
        np.exp(t - t.max(1, keepdims=True), out)
    else:
        np.multiply(out, np.exp(t, t), out)


def _one_after_other(cells: pa.ChunkedArray) -> np.ndarray:
    """The doubles of binary cells, without a copy if they lie in one piece."""
    cells = cells.combine_chunks()
    if isinstance(cells, pa.ChunkedArray):  # more than a binary array can hold
        return np.concatenate([_one_after_other(pa.chunked_array([c])) for c in cells.chunks])
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]
    return np.frombuffer(cells.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(float)


def fixed_point(lam: np.ndarray, index: np.ndarray, starts: np.ndarray, counts: np.ndarray, alpha: np.ndarray, gamma0: float, inner: int,
                phi_weight: str = "digamma") -> tuple[np.ndarray, np.ndarray]:
    """Sums of count * phi per topic row of ``lam``, with a spare row, and the documents' final gamma; ``index`` has the row of each entry (L2, L3).

    A group of documents of near sizes goes through all iterations before the next: two products of
    its topic rows each, in which shorter documents repeat their last entry with a count of 0.
    """
    k, sizes = lam.shape[1], np.diff(starts, append=len(counts))
    sums, gammas = np.zeros((len(lam) + 1, k)), np.empty((len(starts), k))
    words = np.add.reduceat(counts, starts, dtype=float) if len(starts) else counts
    for group in _alike(sizes, max(1, GROUP_NUMBERS // k)):
        own, n = sizes[group][:, None], int(sizes[group[-1]])
        at = starts[group][:, None] + np.minimum(np.arange(n), own - 1)
        rows, count = index[at], np.where(np.arange(n) < own, counts[at], 0.0)[:, None, :]
        topics = np.ascontiguousarray(lam[rows].transpose(0, 2, 1))
        gamma, weight, total = (np.full((len(group), k), gamma0) for _ in range(3))
        room, rate = [np.empty_like(gamma) for _ in range(3)], np.empty(count.shape)
        scaled = bool(words[group].min() < FEW_WORDS * k)
        for _ in range(inner):
            if phi_weight == "gamma":
                weight[:] = gamma
            else:
                _digamma_weights(gamma, weight, room, scaled)
            np.divide(count, np.matmul(weight[:, None, :], topics, out=rate), out=rate)
            np.matmul(topics, rate[:, 0, :, None], out=total[:, :, None])
            np.add(np.multiply(weight, total, gamma), alpha, gamma)
        topics *= weight[:, :, None]
        topics *= rate
        np.add.at(sums.reshape(-1), (rows.astype(np.intp)[:, None, :] * k + np.arange(k)[:, None]).reshape(-1), topics.reshape(-1))
        gammas[group] = gamma
    return sums, gammas


def e_step(blocks: DataFrame, needs: DataFrame, lam: DataFrame, totals: np.ndarray, alpha: np.ndarray, k: int, v: int,
           inner: int = INNER_ITERATIONS, phi_weight: str = "digamma") -> DataFrame:
    """L2 + L3: (term_block, offsets, sums) of every document block; term block -1 holds its sufficient statistics.

    ``totals`` normalise the topics as they are cut.
    """
    alpha, totals = np.asarray(alpha, float), np.asarray(totals, float)
    gamma0, kind = ALPHA0 + v // k, _offset_type(k)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                topics = np.frombuffer(b.column(2)[i].as_py()).reshape(-1, k) / totals
                own = b.column(1)[i].as_py()
                parts = [topics[np.frombuffer(m["offsets"], kind)].tobytes() for m in own]
                yield pa.record_batch([
                    pa.array([b.column(0)[i].as_py()] * len(own), pa.int64()), *(pa.array([m[c] for m in own], pa.int64()) for c in ("block", "at")),
                    pa.array([m["offsets"] for m in own], pa.binary()), pa.array(parts, pa.binary())],
                    names=["term_block", "block", "at", "offsets", "part"])

    def fit(docs: pa.Table, parts: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], names=["term_block", "offsets", "sums"])
        row = docs.to_pylist()[0]
        parts = parts.sort_by("at")
        topics = _one_after_other(parts.column("part")).reshape(-1, k)
        starts, index = np.frombuffer(row["starts"], np.int64), _from_steps(row["index"])
        counts = np.frombuffer(row["counts"], np.uint16 if len(row["counts"]) == 2 * len(index) else float)
        sums, gamma = fixed_point(topics, index, starts, counts, alpha, gamma0, inner, phi_weight)
        suff = (digamma(gamma) - digamma(gamma.sum(1))[:, None]).sum(0)
        ends = np.append(parts.column("at").to_numpy(), (len(topics), len(topics) + 1)) * 8 * k
        sums[-1] = suff
        del topics
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array([*parts.column("term_block").to_pylist(), SUFF_STAT_ID], pa.int64()),
                         pa.array([*parts.column("offsets").to_pylist(), np.zeros(1, kind).tobytes()], pa.binary()),
                         pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sums)])],
                        names=["term_block", "offsets", "sums"])

    parts = needs.join(lam.select("term_block", "lam"), "term_block").select("term_block", "members", "lam").mapInArrow(
        cut, "term_block long, block long, at long, offsets binary, part binary")
    return blocks.drop("terms").groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(fit, _SUMS)


def _added(batches: Iterator[pa.RecordBatch], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of a term block up to its last term, which terms have any, and the values that come without offsets."""
    new, seen, old = np.zeros((0, k)), np.zeros(0, bool), np.zeros((0, k))
    for b in batches:
        for offsets, values in zip(b.column("offsets").to_pylist(), b.column("sums").to_pylist(), strict=True):
            values = np.frombuffer(values).reshape(-1, k)
            if offsets is None:
                old = values
                continue
            at = np.frombuffer(offsets, f"u{len(offsets) // len(values)}")
            if len(new) <= at[-1]:  # offsets rise
                new, seen = (np.concatenate([x, np.zeros((int(at[-1]) + 1 - len(x), *x.shape[1:]), x.dtype)]) for x in (new, seen))
            new[at] += values
            seen[at] = True
    return new, seen, old


def unseen_blocks(needs: DataFrame, k: int, v: int) -> DataFrame | None:
    """Written table (term_block) of the term blocks with a term that no document has; None if there are none, as in a vectorized corpus."""
    size, kind = _term_block_size(k), _offset_type(k)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = key[0].as_py(), None
        for b in batches:
            for members in b.column("members"):
                seen = np.zeros(min(size, v - block * size), bool) if seen is None else seen
                for offsets in members.values.field("offsets"):
                    seen[np.frombuffer(offsets.as_py(), kind)] = True
        if seen.all():
            yield pa.record_batch([pa.array([block])], names=["full"])

    spark = needs.sparkSession
    full = needs.groupBy("term_block").applyInArrow(run, "full long")
    rows = materialized(spark.range(-(-v // size)).toDF("term_block").join(full, F.col("term_block") == F.col("full"), "left_anti"), "lda-unseen")
    return rows if rows.head(1) else None


def m_step(sums: DataFrame, lam: DataFrame, totals: np.ndarray, k: int, unseen: DataFrame | None) -> DataFrame:
    """Written (term_block, lam, totals): eta + summed phi where a document has the term, the old value elsewhere.

    Only term blocks of ``unseen_blocks`` bring their old values. Term block -1 holds the sums of the sufficient statistics in ``totals``.
    """
    totals = np.asarray(totals, float)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        new, seen, old = _added(batches, k)
        out = new
        if block != SUFF_STAT_ID:
            out = old / totals if len(old) else np.empty_like(new)
            out[:len(new)][seen] = ETA + new[seen]
        yield _lambda_row(block, out)

    if unseen is not None:
        sums = sums.unionByName(lam.join(unseen, "term_block", "left_semi").select(
            "term_block", F.lit(None).cast("binary").alias("offsets"), F.col("lam").alias("sums")))
    return materialized(sums.groupBy("term_block").applyInArrow(add, _LAMBDA), "lda-topics")


def topic_totals(lam: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The K totals over all terms and the K sufficient statistics of an ``m_step``."""
    own = F.col("term_block") != SUFF_STAT_ID
    r = lam.agg(*(F.sum(F.when(c, F.col("totals")[j])).alias(f"c{i}_{j}") for i, c in enumerate((own, ~own)) for j in range(k))).first()
    return np.array(r[:k], float), np.array([0.0 if x is None else x for x in r[k:]], float)


def lambda_rows(lam: DataFrame, totals: np.ndarray, k: int) -> DataFrame:
    """(term_id, lam): the topic rows of term blocks, divided by ``totals``."""
    size, totals = _term_block_size(k), np.asarray(totals, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values = np.frombuffer(values).reshape(-1, k) / totals
                yield pa.record_batch([pa.array(block * size + np.arange(len(values))), pa.array(list(values), pa.list_(pa.float64()))],
                                      names=["term_id", "lam"])

    return lam.filter(F.col("term_block") != SUFF_STAT_ID).select("term_block", "lam").mapInArrow(run, "term_id long, lam array<double>")


def sum_rows(sums: DataFrame, k: int) -> DataFrame:
    """(k, term_id, value): the block sums of an E-step per topic and term (A8); term -1 holds the sufficient statistics.

    They are added up a term block at a time, before they are rows.
    """
    size = _term_block_size(k)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        new, seen, _ = _added(batches, k)
        terms = np.flatnonzero(seen) + (block * size if block != SUFF_STAT_ID else SUFF_STAT_ID)
        yield pa.record_batch([pa.array(np.tile(np.arange(k, dtype=np.int32), len(terms))), pa.array(np.repeat(terms, k)),
                               pa.array(new[seen].reshape(-1))], names=["k", "term_id", "value"])

    return sums.groupBy("term_block").applyInArrow(run, "k int, term_id long, value double")


def update_alpha(alpha: np.ndarray, suff: np.ndarray, d: int) -> np.ndarray:
    """L4: damped Newton steps for the Dirichlet parameter (K numbers); it stays without documents."""
    alpha = np.asarray(alpha, float)
    for _ in range(ALPHA_MAX_ITERATIONS + 1 if d else 0):
        g = d * (digamma(alpha.sum()) - digamma(alpha)) + suff
        q = -1.0 / (d * trigamma(alpha))
        z = 1.0 / (d * trigamma(alpha.sum()))
        b = (g * q).sum() / (z + q.sum())
        hg = (g - b) * q
        new = alpha
        for decay in range(ALPHA_MAX_DECAY + 1):
            step = hg * ALPHA_DECAY ** decay
            if not np.any(step > alpha):
                new = alpha - step
                break
        delta = np.abs((new - alpha) / alpha)
        alpha = new
        if not np.any(delta > ALPHA_TOLERANCE):
            break
    return alpha


def release_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver collects its garbage; without a call that may be
    after the last iteration, and their files of all iterations lie on disk together."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fit_lda_em(corpus: DataFrame, v: int, k: int = 10, outer: int = OUTER_ITERATIONS, inner: int = INNER_ITERATIONS,
               phi_weight: str = "digamma", seed: int = 0, last_use: bool = False):
    """L1: returns (lambda (term_id, lam), alpha, per-iteration seconds).

    ``corpus`` is that of ``doc_blocks``, with term ids below ``v``, the vocabulary size. With ``last_use`` it
    is a written table that is deleted once its documents are packed.
    """
    blocks = doc_blocks(corpus, k)
    if last_use:
        discard(corpus)
    needs = block_needs(blocks, k)
    release_shuffles(corpus.sparkSession)
    lam, totals, unseen = term_blocks(corpus.sparkSession, k, v, seed), np.ones(k), unseen_blocks(needs, k, v)
    d = int(blocks.agg(F.sum(F.length("starts") / 8)).first()[0] or 0)
    alpha, timings = np.full(k, ALPHA0), []
    for _ in range(outer):
        t0 = time.perf_counter()
        old, lam = lam, m_step(e_step(blocks, needs, lam, totals, alpha, k, v, inner, phi_weight), lam, totals, k, unseen)
        discard(old)
        totals, suff = topic_totals(lam, k)
        alpha = update_alpha(alpha, suff, d)
        release_shuffles(corpus.sparkSession)
        timings.append(time.perf_counter() - t0)
    return lambda_rows(lam, totals, k), alpha, timings


def topics_table(lam: DataFrame) -> DataFrame:
    """Lambda in long form (term_id, k, value)."""
    return lam.select("term_id", F.posexplode("lam").alias("k", "value"))


def top_terms(lam: DataFrame, vocab: DataFrame, n: int = 10) -> DataFrame:
    """(k, rank, term, weight): the n heaviest terms per topic."""
    t = topics_table(lam)
    w = Window.partitionBy("k").orderBy(F.col("value").desc(), F.col("term_id"))
    # filtering row_number() itself lets Spark keep only n rows per topic in
    # each task before the shuffle (WindowGroupLimit)
    top = t.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.join(vocab, "term_id").select("k", (F.col("_rn") - 1).alias("rank"), "term",
                                             F.col("value").alias("weight"))

