"""Vocabulary and sparse document vectors.

Plan shape:
  texts --explode (map side)--> (doc_id, term) --partial+final agg--> term
  counts per document (the only pass over all tokens); the vocabulary is the
  distinct terms of that table; ids are dense ranks in term order, assigned
  per range partition plus a per-partition offset (no single-task window);
  the vocabulary join has no hint: Spark broadcasts a vocabulary whose size is
  below its own byte bound, and AQE splits skewed terms of a shuffle join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.cleaning import (all_tokens, clean_documents, is_term, lowered, remove_numbers, remove_urls,
                                        stem_and_fold, stop_words, strip_stored_newline)
from webloom.functions.stem import stem_tokens
from webloom.session import checkpoint_dir
from webloom.sources.tables import discard, materialized

try:  # ship this module's per-batch code with the task (no package install on executors)
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover
    pass

#: Rows of a batch that are counted at once, into a block.
COUNTED_ROWS = 2000


def cleaned_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """texts(doc_id STRING, text STRING): the cleaner's output per document."""
    return clean_documents(docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")))


def corpus_terms(texts: DataFrame, stem: bool = False) -> DataFrame:
    """(doc_id, term): ``split(" ")`` of each text (stored newline removed),
    optionally stemmed, empty terms dropped."""
    toks = F.split(strip_stored_newline(F.col("text")), " ")
    if stem:
        toks = stem_tokens(toks)
    return texts.select("doc_id", F.explode(F.filter(toks, lambda t: t != "")).alias("term"))


def term_counts(terms: DataFrame) -> DataFrame:
    """(doc_id, term, count): occurrences per document and term (A6 before ids)."""
    return terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("count"))


def distinct_terms(counts_or_terms: DataFrame) -> DataFrame:
    """A4."""
    return counts_or_terms.select("term").distinct()


def assign_ids(terms: DataFrame, col: str = "term", num_partitions: int | None = None) -> DataFrame:
    """A5: (term, term_id) with term_id = 0-based rank in term order.

    Range-partition and sort by term; the position inside a partition comes
    from ``monotonically_increasing_id`` (partition id in the high bits), the
    partition's offset from a table with one row per partition. The ranked
    rows are checkpointed, so that both sides see the same partitions.
    """
    parted = (terms.select(col).repartitionByRange(num_partitions, col) if num_partitions
              else terms.select(col).repartitionByRange(col))
    checkpoint_dir(terms.sparkSession)
    ranked = parted.sortWithinPartitions(col).select(
        col, F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")).checkpoint(eager=True)
    sizes = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, not by the data
    return ranked.join(F.broadcast(offsets), "_pid").select(
        col, (F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).alias("term_id"))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (ids, words, sizes, codes, counts) of rows (doc_id, tokens): per row ``sizes`` entries, a place in ``words`` and its count each."""
    for b in batches:
        for at in range(0, b.num_rows, COUNTED_ROWS):
            part = b.slice(at, COUNTED_ROWS)
            tokens = part.column(1)
            coded = tokens.flatten().dictionary_encode()
            if not len(coded):
                continue
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, counts = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = np.divmod(keys, len(coded.dictionary))
            sizes = np.bincount(row, minlength=part.num_rows)
            lists = (pa.ListArray.from_arrays([0, len(x)], x.cast(pa.string())) for x in (part.column(0), coded.dictionary))
            yield pa.record_batch([*lists, *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (sizes, code, counts))],
                                  names=["ids", "words", "sizes", "codes", "counts"])
        pa.default_memory_pool().release_unused()


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (block, ids, words, sizes, codes, counts): the counted tokens of some documents a row, each distinct token once.

    Tokens are counted where their text is read, without an exchange.
    """
    text = remove_numbers(remove_urls(F.coalesce(F.col(text_col), F.lit(""))))
    blocks = docs.select(F.col(id_col).cast("string").alias("doc_id"), all_tokens(text).alias("tokens")).mapInArrow(
        _count_rows, "ids array<string>, words array<string>, sizes binary, codes binary, counts binary")
    return materialized(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), "token-blocks")


def _as_raw(rows: DataFrame) -> DataFrame:
    """Rows whose ``token`` is a term of the analyzer, with it as ``raw``: without possessive, lower case, no stop word."""
    rows = rows.where(is_term(F.col("token"))).withColumn("raw", lowered(F.col("token")))
    return rows.where(~F.col("raw").isin(*stop_words()))


def raw_terms(blocks: DataFrame) -> DataFrame:
    """Written table (token, raw): the analyzer's terms, before stems, among the distinct words of ``token_blocks``.

    The distinct words are written first, or Spark would look at a word once per block.
    """
    tokens = materialized(blocks.select(F.explode("words").alias("token")).distinct(), "tokens")
    raws = materialized(_as_raw(tokens), "raw-terms")
    discard(tokens)
    return raws


def raw_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, count): analyzer terms of each document before stems, counted, in rows.

    Terms that differ in case or possessive, and rows of one id, leave several rows of a document and term, which sums put together.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, *own in zip(*b.columns, strict=True):
                sizes, codes, counts = (np.frombuffer(x.as_py(), np.int32) for x in own)
                row = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.record_batch([ids.values.take(pa.array(row)), words.values.take(pa.array(codes)), pa.array(counts, pa.int64())],
                                      names=["doc_id", "token", "count"])

    blocks = token_blocks(docs, id_col, text_col).drop("block")
    return _as_raw(blocks.mapInArrow(run, "doc_id string, token string, count long")).select("doc_id", "raw", "count")


def term_dictionary(counts: DataFrame, stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """Written tables (raw, term_id) and the vocabulary (term, term_id) of rows with raw terms.

    Every distinct raw term is stemmed, folded and stripped once. Folding may leave no term of
    it, or several; ``stem`` stems them again, as a job that stems cleaned texts does.
    """
    words = F.split(stem_and_fold(F.array("raw")), " ")
    words = F.filter(stem_tokens(words) if stem else words, lambda t: t != "")
    pairs = materialized(counts.select("raw").distinct().select("raw", F.explode(words).alias("term")), "term-dictionary")
    vocab = materialized(assign_ids(pairs.select("term").distinct()), "vocabulary")
    ids = materialized(pairs.join(vocab, "term").select("raw", "term_id"), "term-ids")
    discard(pairs)
    return ids, vocab


_DOCUMENTS = "doc_id string, size long, terms binary, counts binary"


def _cells(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary cells of unsigned numbers, as narrow as the largest allows; a cell begins at each of ``starts``."""
    values = values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))
    ends = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values)])


def cell_numbers(sizes: list[int], cells: list[bytes]) -> np.ndarray:
    """The numbers of such cells, one after the other."""
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c, f"u{len(c) // n}") for n, c in zip(sizes, cells, strict=True))]).astype(np.int64)


def packed_documents(blocks: DataFrame, raws: DataFrame, ids: DataFrame) -> DataFrame:
    """A6 in a row per row of the input: (doc_id, size, terms, counts), its ``size`` distinct term ids and how often it has them.

    The ids of a block's words come to the block, so that a word is joined and shuffled once per block, not once per document.
    """
    def run(block: pa.Table, words: pa.Table) -> pa.Table:
        if not block.num_rows or not words.num_rows:
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary())], names=["doc_id", "size", "terms", "counts"])
        names = block.column("ids").combine_chunks().values
        sizes, codes, counts = (np.frombuffer(block.column(c)[0].as_py(), np.int32) for c in ("sizes", "codes", "counts"))
        words = words.sort_by("place")
        place = words.column("place").to_numpy()
        distinct, local = np.unique(words.column("term_id").to_numpy(), return_inverse=True)
        of_word = np.bincount(place, minlength=codes.max() + 1)  # a word may have no term, or several
        n = of_word[codes]
        at = np.repeat((np.cumsum(of_word) - of_word)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(np.repeat(np.arange(len(sizes)), sizes), n) * len(distinct) + local[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        row, term = np.divmod(key[first], len(distinct))
        total = np.add.reduceat(np.repeat(counts, n)[order], first, dtype=np.int64) if len(first) else first
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        return pa.table([names.take(pa.array(row[starts])), pa.array(np.diff(starts, append=len(row)), pa.int64()),
                         _cells(distinct[term], starts), _cells(total, starts)], names=["doc_id", "size", "terms", "counts"])

    words = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("place", "token"))
    places = words.join(raws.join(ids, "raw").select("token", "term_id"), "token").select("of", "place", "term_id")
    return blocks.drop("words").groupBy("block").cogroup(places.groupBy("of")).applyInArrow(run, _DOCUMENTS)


def dictionary_doc_terms(packed: DataFrame) -> DataFrame:
    """A6 from the dictionary: doc_terms(doc_id, term_id, count) of ``packed_documents``. Rows of one id add up.

    What follows stays partitioned by document.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, terms, counts = (b.column(c).to_pylist() for c in ("size", "terms", "counts"))
            yield pa.record_batch([b.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(cell_numbers(sizes, terms)),
                                   pa.array(cell_numbers(sizes, counts))], names=["doc_id", "term_id", "count"])

    rows = packed.mapInArrow(run, "doc_id string, term_id long, count long").repartition("doc_id")
    return rows.groupBy("doc_id", "term_id").agg(F.sum("count").alias("count"))


def vectorize_documents(docs: DataFrame, stem: bool = False, packed: bool = False):
    """(vocab, doc_terms, vectors) straight from documents, by a written term dictionary, without cleaned texts.

    With ``packed``, doc_terms are those of ``packed_documents``, for jobs that work on whole documents;
    their ``sources`` are the written tables that a copy of them does without.
    """
    blocks = token_blocks(docs)
    raws = raw_terms(blocks)
    ids, vocab = term_dictionary(raws, stem)
    own = packed_documents(blocks, raws, ids)
    own.sources = [blocks, raws, ids]
    dt = dictionary_doc_terms(own)
    return vocab, own if packed else dt, doc_vectors(dt)


def occurrences(dterms: DataFrame, vocab: DataFrame) -> DataFrame:
    """J1 by occurrence: (doc_id, term, term_id), from counts, so that a frequent term is one row per document until the end."""
    rows = dterms.join(vocab, "term_id")
    return rows.select("doc_id", "term", "term_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("_n")).drop("_n")


def join_vocab(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Attach term_id."""
    return rows.join(vocab, "term")


def doc_terms(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_terms(doc_id, term_id, count)."""
    return join_vocab(counts, vocab).select("doc_id", "term_id", "count")


def doc_vectors(dterms: DataFrame) -> DataFrame:
    """(doc_id, vector) with vector = 'id:count id:count ...' by id."""
    entry = F.concat(F.col("term_id").cast("string"), F.lit(":"), F.col("count").cast("string"))
    pairs = F.sort_array(F.collect_list(F.struct("term_id", "count", entry.alias("entry"))))
    return dterms.groupBy("doc_id").agg(F.array_join(pairs["entry"], " ").alias("vector"))


def vector_lines(vectors: DataFrame) -> DataFrame:
    """Text form of A7: 'doc_id id:count ...'."""
    return vectors.select(F.concat_ws(" ", "doc_id", "vector").alias("value"))


def corpus_size(texts: DataFrame) -> DataFrame:
    """A10: number of documents that have a term."""
    return corpus_terms(texts).agg(F.count_distinct("doc_id").alias("num_docs"))


def vectorize(texts: DataFrame, stem: bool = False, materialize: bool = True):
    """Full job: returns (vocab, doc_terms, vectors).

    With ``materialize`` the counts and the vocabulary are checkpointed to the
    session's shared checkpoint folder (both are read twice).
    """
    counts = term_counts(corpus_terms(texts, stem))
    if materialize:
        checkpoint_dir(texts.sparkSession)
        counts = counts.checkpoint(eager=True)  # read by the vocabulary and the join
    vocab = assign_ids(distinct_terms(counts))
    if materialize:
        vocab = vocab.checkpoint(eager=True)
    dt = doc_terms(counts, vocab)
    return vocab, dt, doc_vectors(dt)


def doc_index(df: DataFrame, order_col: str) -> DataFrame:
    """P10: dense 0-based running index in ``order_col`` order (distributed)."""
    ids = assign_ids(df.select(order_col).distinct(), order_col).withColumnRenamed("term_id", "doc_index")
    return df.join(ids, order_col)
