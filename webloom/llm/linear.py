"""Linear text classifiers, fitted on a bounded sample of labelled rows and applied to all documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices
from webloom.llm.decontam import words

#: Labelled rows, of lowest id hash, that a classifier is fitted on.
MAX_ROWS = 3000
#: Sample documents that a word must stand in to be a feature.
MIN_DOCS = 3
#: Log odds between the classes from which a word is a feature.
MIN_LOG_ODDS = 1.0
#: Word beginnings that are features, and how often they must occur in a text.
PREFIX_BYTES = 5
PREFIX_ONE_IN = 100
#: Standard deviations at which surface measures are cut.
SPREAD = 4.0
STEPS = 150
PENALTY = 1.0

_BEGINNING = itemgetter(slice(0, PREFIX_BYTES))

DENSE = ("upper", "marks", "distinct", "word_length", "log_words")


def features(text: bytes) -> tuple[set[bytes], list[float], int]:
    """Word features of a whole UTF-8 text, measures of its surface, and the number of its words.

    Word features are the distinct words, and the word beginnings of
    ``PREFIX_BYTES`` bytes that at least one word in ``PREFIX_ONE_IN`` has:
    families of inflected words that are too rare each.
    """
    own = words(text)
    some = set(own)
    distinct = len(some)
    often = len(own) / PREFIX_ONE_IN
    some.update(b"^" + p for p, k in Counter(map(_BEGINNING, own)).items() if k >= often and len(p) == PREFIX_BYTES)
    n, m = max(1, len(text)), max(1, len(own))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = len(text) - len(text.translate(None, b"!\"#$%&*+/<=>?@[\\]^_`{|}~"))
    return some, [upper / n, marks / n, distinct / m, min(n / m, 50) / 10, math.log1p(len(own))], len(own)


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int = MAX_ROWS) -> list[tuple]:
    """``(label values, words, measures, fold)`` of at most ``max_rows`` labelled documents.

    The labels of lowest id hash are taken, once per id, and then as many of their
    documents at most; rows without id or with a null label are left out. Of different labels of an id the largest count,
    compared column by column. The fold follows the text, so that copies share one.
    """
    known = labels.select("doc_id", *columns).dropna().groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("y")).select("doc_id", "y.*")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.array(*(F.col(c).cast("int") for c in columns)).alias("y"),
        F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            both = [features(t or b"") for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([sorted(f[0]) for f in both], pa.list_(pa.binary())),
                                   pa.array([f[1] for f in both], pa.list_(pa.float64())), b.column(3)],
                                  names=["doc_id", "y", "words", "dense", "fold"])

    sample = own.mapInArrow(run, "doc_id long, y array<int>, words array<binary>, dense array<double>, fold int")
    table = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "fold", "y", "dense").limit(max_rows).toArrow()
    few = [table.column(c).to_pylist() for c in ("doc_id", "fold", "y", "dense")]
    known: dict[bytes, bytes] = {}  # a word is one object, however many documents hold it
    return [(few[2][i], {known.setdefault(w, w) for w in table.column("words")[i].as_py()}, few[3][i], few[1][i])
            for i in sorted(range(table.num_rows), key=lambda i: (few[0][i], few[1][i], few[2][i]))]


@dataclass
class Linear:
    """Logistic model: weights of words, of surface measures and of earlier predictions."""

    weights: dict[bytes, float]
    dense: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = frozenset(self.weights)

    def probability(self, some: set[bytes], dense: list[float]) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, some & self.known)) + float(
            np.clip((np.asarray(dense) - self.center) / self.scale, -SPREAD, SPREAD) @ self.dense)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(sample: list[tuple[set[bytes], list[float]]], y: np.ndarray, steps: int = STEPS, penalty: float = PENALTY,
        width: int = len(DENSE)) -> Linear:
    """Logistic regression whose word features are weighed by their log odds between the classes.

    The classes have equal weight. A sample of one class, or none, gives its
    smoothed share for every document.
    """
    n, ones = len(y), int(y.sum())
    dense = np.array([d for _, d in sample], float).reshape(n, width)
    center = dense.mean(0) if n else np.zeros(width)
    scale = np.where((s := dense.std(0) if n else np.ones(width)) > 1e-9, s, 1.0)
    share = math.log((ones + 0.5) / (n - ones + 0.5)) if n else -30.0
    if not 0 < ones < n:
        return Linear({}, np.zeros(width), center, scale, share)
    seen: dict[bytes, list[int]] = {}
    for (some, _), one in zip(sample, y, strict=True):
        for w in some:
            seen.setdefault(w, [0, 0])[int(one)] += 1
    odds = {w: math.log((b + 0.5) / (ones + 1)) - math.log((a + 0.5) / (n - ones + 1))
            for w, (a, b) in sorted(seen.items()) if a + b >= MIN_DOCS}
    odds = {w: v for w, v in odds.items() if abs(v) >= MIN_LOG_ODDS}
    index = {w: i for i, w in enumerate(odds)}
    r = np.array(list(odds.values()))
    row, col = [], []
    for i, (some, _) in enumerate(sample):
        own = sorted(index[w] for w in some if w in index)
        row += [i] * len(own)
        col += own
    row, col = np.array(row, int), np.array(col, int)
    d = np.clip((dense - center) / scale, -SPREAD, SPREAD)
    cost = np.where(y > 0, n / (2 * ones), n / (2 * (n - ones)))
    w, v, b = np.zeros(len(r)), np.zeros(width), 0.0
    grads = [np.zeros(len(r)), np.zeros(width), 0.0]
    squares = [np.zeros(len(r)), np.zeros(width), 0.0]
    for step in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, (w * r)[col], n) + d @ v + b
        e = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        new = [np.bincount(col, e[row], len(r)) * r + penalty * w / n, d.T @ e + penalty * v / n, e.sum()]
        out = []
        for k, (x, g) in enumerate(zip((w, v, b), new, strict=True)):
            grads[k] = 0.9 * grads[k] + 0.1 * g
            squares[k] = 0.99 * squares[k] + 0.01 * g * g
            out.append(x - 0.1 * (grads[k] / (1 - 0.9 ** step)) / (np.sqrt(squares[k] / (1 - 0.99 ** step)) + 1e-9))
        w, v, b = out
    return Linear({x: float(w[i] * r[i]) for x, i in index.items()}, v, center, scale, float(b))
