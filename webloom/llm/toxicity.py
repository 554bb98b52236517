"""Toxicity by a classifier chain."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import linear
from webloom.llm.common import slices

#: Categories in the order of the chain.
CATEGORIES = ("low_quality", "toxic")
THRESHOLD = 0.5
FOLDS = 3


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[linear.Linear]

    def probabilities(self, text: bytes) -> list[float]:
        some, dense, n = linear.features(text)
        if not n:
            return [0.0] * len(self.models)
        out: list[float] = []
        for model in self.models:
            out.append(model.probability(some, [*dense, *out]))
        return out


def fit_chain(sample: list[tuple], categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """A linear model per category; each gets the probabilities of the categories before it as features.

    In training those are out-of-fold: predicted by a model that was fitted on
    the other folds, so that later models learn how far to trust them.
    ``sample`` is that of ``linear.labelled_sample``.
    """
    rows = [(some, list(dense)) for _, some, dense, _ in sample]
    folds = np.array([f for *_, f in sample], int)
    models = []
    for k in range(len(categories)):
        y = np.array([labels[k] for labels, *_ in sample], float)
        width = len(linear.DENSE) + k
        models.append(linear.fit(rows, y, width=width))
        if k + 1 == len(categories):
            break
        held = np.zeros(len(rows))
        for fold in range(FOLDS):
            rest = np.nonzero(folds != fold)[0]
            model = linear.fit([rows[i] for i in rest], y[rest], width=width)
            for i in np.nonzero(folds == fold)[0]:
                held[i] = model.probability(*rows[i])
        rows = [(some, [*dense, p]) for (some, dense), p in zip(rows, held, strict=True)]
    return Chain(categories, models)


def with_categories(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` with a 0/1 column for each category."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
             max_rows: int = linear.MAX_ROWS) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category of the chain, and ``rejected``: toxic at least to ``threshold``.

    The chain is fitted on at most ``max_rows`` labelled documents and applied
    to the whole text of every row, in one pass without a shuffle. Null texts
    are empty; a text without words has probability 0 in every category. Without labelled documents nothing is rejected. Repeated rows
    each give a row; an empty table gives none.
    """
    sample = linear.labelled_sample(docs, with_categories(labels), list(CATEGORIES), max_rows)
    chain = docs.sparkSession.sparkContext.broadcast(fit_chain(sample))
    names = [f"p_{c}" for c in CATEGORIES]
    columns = [F.col(c) for c in docs.columns if c not in (*names, "rejected")]
    kept = docs.select(*columns)
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chain.value
        for b in slices(batches):
            scores = np.array([model.probabilities(t or b"") for t in b.column(at).cast(pa.binary()).to_pylist()])
            scores = scores.reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(s) for s in scores.T)],
                                             names=[*b.schema.names, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{n} double" for n in names])
    return kept.mapInArrow(run, schema).withColumn("rejected", F.col("p_toxic") >= threshold)
