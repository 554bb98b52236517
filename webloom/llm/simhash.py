"""SimHash near-duplicates: fingerprints and a binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from webloom.llm.common import local_roots, slices, written
from webloom.llm.graph import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Fingerprints under a trie node that one task may hold of each side; heavier node pairs are descended further.
NODE_LIMIT = 2048
#: Levels that one descent of heavy node pairs goes down.
DESCENT = 4


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: a bit is set if it is set in over half of its shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i:i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, f)`` and the columns ``keep`` per row: the fingerprint as a signed 64-bit number. A null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            f = np.array([fingerprint(t or b"", shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(f.view(np.int64)), *b.columns[2:]], names=["doc_id", "f", *keep])

    passed = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"), *keep).mapInArrow(
        run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, f long{passed}")


def trie_join(g: np.ndarray, depth: int, p: int, q: int, half_bits: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the sorted distinct ``g`` whose bits differ in at most ``max_bits`` places, at most ``half_bits``
    of them in the upper half, one under the node ``p`` and one under the node ``q`` of the trie level ``depth``.

    A node is the range of ``g`` that shares its prefix. All node pairs of a
    level go down together; a pair is dropped once its differing bits exceed
    the budget of the level, or if it is one fingerprint with itself.
    """
    width = np.uint64(64 - depth)
    level = g >> width
    s1, e1, s2, e2 = (np.array([np.searchsorted(level, np.uint64(x), side)], np.int32)
                      for x in (p, q) for side in ("left", "right"))
    diff = np.array([int(p ^ q).bit_count()], np.int8)
    for d in range(depth, 64):
        ones = np.concatenate([[0], np.cumsum((g >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int32)
        m1, m2 = e1 - (ones[e1] - ones[s1]), e2 - (ones[e2] - ones[s2])
        same = s1 == s2
        other = ~same
        budget = half_bits if d < 32 else max_bits
        more = diff < budget
        kids = [(s1, m1, s2, m2, diff, None), (m1, e1, m2, e2, diff, None),
                (s1, m1, m2, e2, diff + 1, more), (m1, e1, s2, m2, diff + 1, more & other)]
        parts = []
        for a, b, c, e, x, ok in kids:
            keep = (a < b) & (c < e) & ((a != c) | (b - a > 1))
            keep = keep if ok is None else keep & ok
            parts.append((a[keep], b[keep], c[keep], e[keep], x[keep].astype(np.int8)))
        s1, e1, s2, e2, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(s1):
            break
    return s1, s2


def _rotated(f: Column, side: Column) -> Column:
    return F.when(side == 0, f).otherwise(F.shiftleft(f, 32).bitwiseOR(F.shiftrightunsigned(f, 32)))


def _prefix(g: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.col(g), 64 - depth)


def links(prints: DataFrame, max_bits: int = MAX_BITS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links ``(a, b)`` that join the distinct fingerprints ``prints(f)`` as all pairs within ``max_bits`` bits do.

    Two fingerprints within the budget differ in at most half of it in one of
    their two halves, so the trie is joined with itself twice, once with either
    half on top, and the tighter budget prunes the upper levels. The top levels
    are joined as tables: a node pair with its fingerprint counts per row. Pairs
    whose nodes hold over ``node_limit`` fingerprints go down ``DESCENT`` more
    levels until none is left, so that no task gets more; the others are
    descended in one task each. A task returns the links of its pairs to the
    smallest fingerprint each reaches, never all pairs of a dense group.
    """
    half = max_bits // 2
    sides = prints.select("f", F.explode(F.array(F.lit(0), F.lit(1))).alias("o"))
    sides = sides.select("o", _rotated(F.col("f"), F.col("o")).alias("g"))
    n = prints.count()
    depth = min(28, max(1, math.ceil(math.log2(max(n, 1) / node_limit + 1e-9)) + 1))

    def nodes(d: int) -> DataFrame:
        return sides.groupBy("o", _prefix("g", d).alias("p")).agg(F.count(F.lit(1)).alias("c"))

    masks = [sum(1 << i for i in bits) for k in range(half + 1) for bits in combinations(range(depth), k)]
    found = nodes(depth)
    pairs = found.select("o", "p", F.col("c").alias("cp"), F.explode(F.array(*map(F.lit, masks))).alias("m"))
    pairs = pairs.select("o", "p", "cp", F.col("p").bitwiseXOR(F.col("m").cast("long")).alias("q")).filter("p <= q")
    members = []
    while True:
        right = found.select("o", F.col("p").alias("q"), F.col("c").alias("cq"))
        pairs = written(pairs.join(right, ["o", "q"]).filter("p <> q or cp > 1"), "node-pairs")
        light = F.greatest("cp", "cq") <= node_limit
        todo = pairs.filter(light).select("o", "p", "q")
        ends = todo.select("*", F.col("p").alias("node")).unionByName(
            todo.filter("p <> q").select("*", F.col("q").alias("node")))
        at = sides.select("o", "g", _prefix("g", depth).alias("node"))
        members.append(at.join(ends, ["o", "node"]).select("o", F.lit(depth).alias("d"), "p", "q", "g"))
        heavy = pairs.filter(~light)
        if heavy.limit(1).count() == 0:
            break
        depth += DESCENT
        below = F.array(*(F.lit(x).cast("long") for x in range(1 << DESCENT)))
        down = heavy.select("o", F.col("p").alias("p0"), "q", F.explode(below).alias("x"))
        down = down.select("o", "p0", F.col("q").alias("q0"), F.shiftleft("p0", DESCENT).bitwiseOR(F.col("x")).alias("p"),
                           F.explode(below).alias("y"))
        down = down.select("o", "p", F.shiftleft("q0", DESCENT).bitwiseOR(F.col("y")).alias("q")).filter("p <= q")
        down = down.filter(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= (half if depth <= 32 else max_bits))
        found = nodes(depth)
        pairs = down.join(found.select("o", "p", F.col("c").alias("cp")), ["o", "p"])
    rows = members[0]
    for more in members[1:]:
        rows = rows.unionByName(more)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        o, d, p, q = (k.as_py() for k in key)
        g = np.sort(table.column("g").to_numpy().view(np.uint64))
        left, right = trie_join(g, d, p, q, half, max_bits)
        root = local_roots(len(g), left, right)
        own = np.arange(len(g))
        f = g if o == 0 else (g << np.uint64(32)) | (g >> np.uint64(32))
        f = f.view(np.int64)
        linked = root != own
        return pa.table({"a": f[linked], "b": f[root[linked]]})

    return rows.groupBy("o", "d", "p", "q").applyInArrow(solve, "a long, b long")


def _rooted(prints: DataFrame, max_bits: int, node_limit: int) -> DataFrame:
    """``prints(f, low)``, one row per fingerprint, with the ``root`` of its component."""
    first = written(prints, "distinct-fingerprints")
    roots = components(links(first.select("f"), max_bits, node_limit))
    return first.join(roots.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "low", F.coalesce("root", "f").alias("root"))


def group_firsts(docs: DataFrame, key: str, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                 node_limit: int = NODE_LIMIT) -> DataFrame:
    """``(key)`` of the first row of every component of ``docs(doc_id, text, key)``.

    Components are those of ``near_duplicates``; rows stand by doc_id, nulls
    last, then by a hash of the text, then by ``key``, which is unique. Minima
    are taken per fingerprint, then per component, combined on the map side.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.col(key).alias("key"))
    rows = fingerprints(hashed, shingle, keep=("h", "key"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "key")
    rooted = _rooted(rows.groupBy("f").agg(F.min(place).alias("low")), max_bits, node_limit)
    return rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias(key))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    node_limit: int = NODE_LIMIT) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in at most ``max_bits`` bits. Null or wordless texts have the
    fingerprint zero and are linked like others. Repeated rows each give a row.
    A null doc_id gives a row too, but names no component (null if no other
    doc_id is reachable). An empty table gives no rows. Other columns are not read.
    """
    rows = written(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(rows.groupBy("f").agg(F.min("doc_id").alias("low")), max_bits, node_limit)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(lowest, "root").select("f", "component_id")
    return rows.join(of, "f", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
