"""Line dedup looks at no more than it has to: sizes that can match, texts of repeated ids, documents that are needed."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

T = Fraction(4, 5)


def _rows(n_rows, sizes, seed):
    rng = np.random.default_rng(seed)
    n = rng.choice(sizes, n_rows)
    return {"g": rng.integers(0, 3, n_rows), "side": np.zeros(n_rows, np.int8), "doc": rng.permutation(n_rows).astype(np.int64),
            "part": np.zeros(n_rows, np.int64), "line": rng.integers(0, 4, n_rows).astype(np.int32), "n": n.astype(np.int32),
            "sig": rng.integers(0, 1 << 62, n_rows) & 0x1111111111111111, "at": np.zeros(n_rows, np.int32), "ask": np.ones(n_rows, bool)}


def test_candidates_are_those_of_brute_force_and_sizes_apart_are_not_compared(monkeypatch):
    from webloom.llm import linededup as L
    compared = []
    apart = L._apart
    monkeypatch.setattr(L, "_apart", lambda a, b: compared.append(len(a)) or apart(a, b))
    rows = _rows(300, [1, 2, 4, 5, 6, 8, 20, 24, 25, 26, 31, 32, 40], 1)
    sig = rows["sig"].view(np.uint64)
    want = set()
    for y in range(300):
        for x in range(300):
            a, b = int(rows["n"][y]), int(rows["n"][x])
            differ = sum(abs((int(sig[y]) >> k & 15) - (int(sig[x]) >> k & 15)) for k in range(0, 64, 4))
            if (rows["g"][y] == rows["g"][x] and rows["doc"][x] < rows["doc"][y] and 4 * a <= 5 * b and 4 * b <= 5 * a
                    and 9 * (min(a, b) + L.FURTHER) >= 4 * (a + b) and 9 * differ <= a + b):
                want.add((y, x))
    y, x, more = L._matched(rows, T, 10 ** 9)
    assert want and set(zip(y.tolist(), x.tolist(), strict=True)) == want and not more.any()
    y, x, more = L._matched(rows, T, 2)
    assert set(zip(y.tolist(), x.tolist(), strict=True)) <= want and np.bincount(y).max() == 2
    for k in range(300):
        assert (y == k).sum() == sum(p[0] == k for p in want) or more[k]
    compared.clear()
    L._matched(_rows(3000, 2 ** np.arange(14), 2) | {"g": np.zeros(3000, np.int64)}, T, 10 ** 9)
    assert len(compared) < 1000  # steps: at most the rows of a size, three times, and not the 2999 of the group


def test_signatures_differ_by_the_sum_of_their_counters():
    from webloom.llm import linededup as L
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 16, (500, 16)) for _ in "ab")
    a[0], b[0], a[1], b[1] = 0, 15, 15, 0
    packed = [(x.astype(np.uint64) << np.arange(0, 64, 4, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64) for x in (a, b)]
    assert (L._apart(*packed) == np.abs(a - b).sum(1)).all()


def test_lines_wanted_have_the_words_that_they_have_among_all():
    from webloom.llm import linededup as L
    rng = random.Random(7)
    texts = ["", None, "x", "\n", "\n\n", "end\n", "É no feed", "glued"] + [
        "".join(rng.choice(["a", "Bc", "longer-than-eight", " ", "\t", "\n", "é"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    every = L.Parsed(pa.array(texts))

    def words(p):
        return [(p.doc[k], p.no[k], int(p.hash[c])) for k, c in zip(p.line, p.code, strict=True)]

    for mod in (1, 2, 5, 10 ** 9):
        some = L.Parsed(pa.array(["cut", *texts]).slice(1), lambda doc, no: (doc * 7 + no) % mod == 0)  # noqa: B023
        assert words(some) == [w for w in words(every) if (w[0] * 7 + w[1]) % mod == 0]


def test_texts_of_ids_that_stand_once_are_not_hashed(spark, monkeypatch):
    from webloom.llm import linededup as L
    from webloom.llm.common import possibly_in
    rows = [(i, f"text {i}") for i in range(50)] + [(None, "a"), (None, "b")]
    key, hashed = L.text_key, []
    monkeypatch.setattr(L, "text_key", lambda: hashed.append(1) or key())

    def ids(docs):
        found = possibly_in(docs, L.repeated_ids(docs), L._id()).filter("__in")
        return sorted({-1 if r.doc_id is None else r.doc_id for r in found.collect()})

    assert ids(spark.createDataFrame(rows, "doc_id long, text string")) == [-1] and not hashed
    more = [(1, "text 1"), (2, "another text"), (2, None), (3, "")]
    assert ids(spark.createDataFrame(rows + more, "doc_id long, text string")) == [-1, 2, 3] and hashed


def test_filters_let_few_others_through_and_only_needed_documents_are_parsed(spark):
    from webloom.llm import linededup as L
    keys = spark.range(2000)
    table = L._bits(keys, lambda b: L._mixed(b.column(0).to_numpy().view(np.uint64), 0), 2000).value
    hit = L._in(table, L._mixed(np.arange(100_000, dtype=np.uint64), 0))
    assert hit[:2000].all() and hit[2000:].mean() < 0.01
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("one two"), F.concat(F.lit("b"), "id")).alias("text"),
                                   F.lit(0).cast("long").alias("__part"))
    needed = spark.createDataFrame([(7, 0, 1), (300, 0, 0)], "doc long, part long, line int")
    rows = L.words_of(docs, needed, 2).collect()
    assert {(r.doc, r.line, len(r.words)) for r in rows} >= {(7, 1, 1), (300, 0, 2)} and {r.doc for r in rows} == {7, 300}
