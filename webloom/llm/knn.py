"""Exact top-k search by inner product: a Voronoi join of queries with data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import written

SCALE = 1024
#: Data rows, spread by a hash of their id, that serve as pivots of the data's cells.
PIVOTS = 64
#: Data rows, picked likewise, whose scores give each query a first bound. Neither number changes the results.
SEEDS = 2048
#: Queries that a cell of queries holds on average.
QUERIES_PER_CELL = 1024
#: Queries of a cell that one task searches on average; a fuller cell is split.
QUERIES_PER_TASK = 8192
#: Data rows that one task of a query cell searches on average.
ROWS_PER_BLOCK = 16384


def quantized(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` with every component x as floor(1024 * x), x as double.

    Rows whose vector or id is null, or whose vector holds a null or a
    component that is not finite, take no part. An empty vector does.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine).select(
        "vec_id", F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))


def _picked(rows: DataFrame, n: int) -> list[tuple[int, np.ndarray]]:
    """A bounded sample, the rows of lowest hash."""
    kept = rows.select("row", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(n).collect()
    return [(r.row, np.array(r.v, np.float64)) for r in kept]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, in double arithmetic where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if top < 2 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance to it."""
    d = (pivots ** 2).sum(1) - 2 * x @ pivots.T
    cell = d.argmin(1)
    return cell, np.sqrt(((x - pivots[cell]) ** 2).sum(1))


def _in_cells(rows: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """``rows`` with their Voronoi cell and their distance from its pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, far = _nearest(_matrix(b.column(2), dim).astype(np.float64), pivots)
                yield pa.record_batch([*b.columns, pa.array(cell, pa.int32()), pa.array(far)],
                                      names=["row", "vec_id", "v", "cell", "far"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<long>, cell int, far double")


def _bounded(queries: DataFrame, seeds: list, dim: int, k: int) -> DataFrame:
    """``queries`` with ``least``: the k-th best score among the seeds, which the true k-th best cannot be under."""
    ids = np.array([i for i, _ in seeds], np.int64)
    x = np.array([v for _, v in seeds]).reshape(len(seeds), dim).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _scores(_matrix(b.column(2), dim), x).astype(np.float64)
                s[b.column(0).to_numpy()[:, None] == ids] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k] if len(ids) >= k else np.full(b.num_rows, -np.inf)
                yield pa.record_batch([*b.columns, pa.array(least)], names=[*b.schema.names, "least"])

    return queries.mapInArrow(run, "row long, vec_id long, v array<long>, cell int, far double, least double")


def top_k(data: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, seeds: int = SEEDS,
          queries_per_cell: int = QUERIES_PER_CELL, rows_per_block: int = ROWS_PER_BLOCK,
          queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` rows of the largest inner product, itself aside.

    ``data`` and ``queries`` are ``quantized`` tables. Both are grouped by the
    nearest pivot. With c and R the centre and radius of a group of queries, p
    the pivot of a group of data and d a row's distance from it, no row scores
    over c.p + |c| d + R |p| + R d with any query of the group. From the groups'
    summaries (pivots, radii, the least score that the seeds assure to every
    query of the group) follows the distance d that a row of each data group
    needs to count for each query group; only rows that reach it are copied
    there, and each (query group, block of rows) is searched in one task. The
    tasks' best k of each query meet in a second step.

    Ties go to the smaller vec_id. Fewer rows than ``k`` give all. Vectors of
    another length than the query's are no candidates; empty ones score 0. An
    empty table gives no rows. ``row`` tells rows apart, and a query from its
    own row in ``data``; where it is missing, vec_id does, and must be unique.
    Rows that repeat an id under a ``row`` of their own are candidates of one
    another, and each gives its own ``k`` rows as a query.
    """
    spark = data.sparkSession
    data, queries = (t if "row" in t.columns else t.withColumn("row", F.col("vec_id")) for t in (data, queries))
    data = written(data, "vectors")
    queries = written(queries, "queries")
    results = None
    for (dim,) in queries.select(F.size("v")).distinct().collect():
        x = data.filter(F.size("v") == dim)
        found = _top_k_of_length(x, queries.filter(F.size("v") == dim), dim, k, pivots, seeds, queries_per_cell,
                                 rows_per_block, queries_per_task)
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return results


def _top_k_of_length(data: DataFrame, queries: DataFrame, dim: int, k: int, pivots: int, seeds: int,
                     queries_per_cell: int, rows_per_block: int, queries_per_task: int) -> DataFrame:
    n_cells = max(1, min(pivots, math.ceil(queries.count() / queries_per_cell)))
    sample = _picked(data, max(seeds, pivots))
    if not sample:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    p = np.array([v for _, v in sample[:pivots]]).reshape(-1 if dim else min(pivots, len(sample)), dim)
    c = np.array([v for _, v in _picked(queries, n_cells)])
    c = c.reshape(len(c), dim)
    x = written(_in_cells(data, p, dim), "cells")
    q = written(_bounded(_in_cells(queries, c, dim), sample[:seeds], dim, k), "query-cells")
    in_x = {r.cell: r for r in x.groupBy("cell").agg(F.max("far").alias("r"), F.count("vec_id").alias("n")).collect()}
    in_q = {r.cell: r for r in q.groupBy("cell").agg(F.max("far").alias("r"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n")).collect()}
    needs = np.full((len(c), len(p)), np.inf)
    blocks = {}
    for i, own in in_q.items():
        size = np.linalg.norm(c[i])
        for j, cell in in_x.items():
            slope = size + own.r
            short = own.least - c[i] @ p[j] - own.r * np.linalg.norm(p[j])
            reach = short / slope if slope > 0 else (-np.inf if short <= 0 else np.inf)
            needs[i, j] = reach - 1e-6 * (1 + abs(reach)) if np.isfinite(reach) else reach
        rows = sum(cell.n for j, cell in in_x.items() if cell.r >= needs[i, j])
        blocks[i] = max(1, math.ceil(rows / rows_per_block))
    levels = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in needs.T))
    reach = F.element_at(levels, F.col("cell") + 1)
    split = F.array(*(F.lit(blocks.get(i, 1)) for i in range(len(c))))
    parts = F.array(*(F.lit(math.ceil(in_q[i].n / queries_per_task) if i in in_q else 1) for i in range(len(c))))
    counts = F.transform(reach, lambda v, i: F.when(F.col("far") >= v, i).otherwise(-1))
    of_cell = F.col("qcell") + 1
    copied = x.select("row", "vec_id", "v", F.explode(F.filter(counts, lambda i: i >= 0)).alias("qcell"))
    copied = copied.select(F.lit(False).alias("query"), "row", "vec_id", "v", "qcell", F.explode(
        F.sequence(F.lit(0), F.element_at(parts, of_cell) - 1)).alias("part"), F.pmod(
        F.xxhash64("row"), F.element_at(split, of_cell)).cast("int").alias("block"))
    asked = q.withColumn("qcell", F.col("cell")).select(
        F.lit(True).alias("query"), "row", "vec_id", "v", "qcell",
        F.pmod(F.xxhash64("row"), F.element_at(parts, of_cell)).cast("int").alias("part"), F.explode(
            F.sequence(F.lit(0), F.element_at(split, of_cell) - 1)).alias("block"))

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("query").to_numpy()
        rows, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        v = _matrix(table.column("v"), dim)
        out = []
        qr, qi, qv = rows[is_query], ids[is_query], v[is_query]
        xr, xi, xv = rows[~is_query], ids[~is_query], v[~is_query]
        for a in range(0, len(qi) if len(xi) else 0, 256):
            s = _scores(qv[a:a + 256], xv)
            for own, i, row in zip(qr[a:a + 256], qi[a:a + 256], s, strict=True):
                other = np.nonzero(xr != own)[0]
                row = row[other]
                if len(row) > k:
                    edge = np.partition(row, -k)[-k]
                    near = np.nonzero(row >= edge)[0]
                else:
                    near = np.arange(len(row))
                best = near[np.lexsort((xi[other[near]], -row[near]))[:k]]
                out.append((np.full(len(best), own), np.full(len(best), i), xi[other[best]], row[best]))
        cols = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), cols, strict=True)))

    best = copied.unionByName(asked).groupBy("qcell", "part", "block").applyInArrow(
        search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
