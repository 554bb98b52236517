"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.session import scratch_path

#: Rows of an Arrow batch that a task works on at once; bounds a task's memory where texts are long.
SLICE_ROWS = 512
#: Bits of an id filter: at most 128 Ki words of 64, so that broadcasting one is bounded.
FILTER_BITS = 1 << 23
#: Numbers that ``sums_before`` adds up in one fold.
SUM_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas of ``body`` read it."""
    return F.transform(F.array(value), body)[0]


def _folded(values: Column, start: Column) -> Column:
    grown = F.aggregate(values, F.array(start), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))
    return F.slice(grown, 1, F.size(values))


def sums_before(values: Column) -> Column:
    """For every number of an array, the sum of those before it, as long.

    Folds run over blocks of ``SUM_BLOCK`` numbers, as a fold copies its array at every step.
    """
    def whole(all_values: Column) -> Column:
        last = F.greatest(F.size(all_values) - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / SUM_BLOCK).cast("int")),
                             lambda b: F.slice(all_values, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK)))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, v: s + v))
        starts = let(totals, lambda t: _folded(t, F.lit(0).cast("long")))
        return F.flatten(F.zip_with(blocks, starts, _folded))

    return let(F.transform(values, lambda v: v.cast("long")), whole)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches of ``mapInArrow`` in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links left-right."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def id_filter(ids: DataFrame, column: str) -> DataFrame:
    """``(word, bits)``: a bit filter of fixed size over a column of ids."""
    h = F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    return written(ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")), "id-filter")


def possibly_in(df: DataFrame, table: DataFrame, column: Column) -> DataFrame:
    """``df`` with ``__in``: false only where ``column`` is surely not among the ids of an ``id_filter``.

    It saves work where few ids matter; what it lets through is decided by a join.
    """
    at = df.withColumn("__h", F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1)))
    bits = table.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
    hit = F.expr("shiftright(__bits, cast(__h & 63 as int)) & 1 = 1")
    return at.join(F.broadcast(bits), F.shiftright("__h", 6) == F.col("__word"), "left").withColumn(
        "__in", F.coalesce(hit, F.lit(False))).drop("__h", "__word", "__bits")
