"""Mixing documents to target weights of domains that are known only softly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm import linear
from webloom.llm.common import slices, written

#: Domains of the labelled table and the share of all tokens that each should have.
TARGETS = {"high_quality": 0.8, "low_quality": 0.15, "toxic": 0.05}
MAX_STEPS = 1000
#: Largest gap of a domain's tokens to its target, as a share of all tokens, at which targets count as met.
TOLERANCE = 1e-9


def with_domains(labels: DataFrame) -> DataFrame:
    """``labels(doc_id, quality, toxic)`` with a 0/1 column for each domain."""
    toxic = F.col("toxic") == 1
    return labels.select("doc_id", (~toxic & (F.col("quality") == 1)).cast("int").alias("high_quality"),
                         (~toxic & (F.col("quality") == 0)).cast("int").alias("low_quality"), toxic.cast("int").alias("toxic"))


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str], max_rows: int = linear.MAX_ROWS,
               fitted_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``p_<domain>``, summing to 1, for every row.

    ``labels`` has a 0/1 column for each domain. One linear model per domain is
    fitted on at most ``max_rows`` labelled documents of ``fitted_on`` (of
    ``docs`` if not given); their probabilities are scaled to a sum of 1. A
    domain without a labelled document has the posterior 0, so that with no
    such document at all every posterior is 0.
    """
    sample = linear.labelled_sample(docs if fitted_on is None else fitted_on, labels, domains, max_rows)
    rows = [(some, dense) for _, some, dense, _ in sample]
    seen = np.array([any(y[k] for y, *_ in sample) for k in range(len(domains))], float)
    models = [linear.fit(rows, np.array([y[k] for y, *_ in sample], float)) for k in range(len(domains))]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = [f"p_{d}" for d in domains]
    kept = docs.select(*(F.col(c) for c in docs.columns if c not in ("n_tokens", *names)))
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            told = [linear.features(t) for t in texts]
            p = np.array([[m.probability(f[0], f[1]) for m in shared.value] for f in told]).reshape(-1, len(names))
            p *= seen
            p /= p.sum(1, keepdims=True) if seen.any() else 1.0
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[2] for f in told], pa.int64()), *(pa.array(c) for c in p.T)],
                names=[*b.schema.names, "n_tokens", *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*schema, "n_tokens long", *(f"{n} double" for n in names)]))


def _rates(p: np.ndarray, path: list[np.ndarray]) -> np.ndarray:
    """Document rates after the steps so far: from 1, each step and the projection to nonnegative rates in turn."""
    r = np.ones(len(p))
    for step in path:
        r = np.maximum(0.0, r - p @ step)
    return r


def fit_rates(scored: DataFrame, targets: dict[str, float], max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE, labelled: tuple[str, ...] = ()) -> list[np.ndarray]:
    """The steps of projected-gradient least squares over ``scored(n_tokens, p_<domain>...)``.

    With n the tokens and p the posterior of a document, the rates r >= 0
    minimise the distance of sum(r n p) from the targets' share of all tokens.
    The residual is measured by the inverse of G = sum(n p p'), and rates by
    their tokens; in these measures the step length is 1, and a document's step
    depends on its posterior only. So the state of the fit is one vector per
    step: every iteration is a job that replays the steps for each document and
    adds up its domain tokens. It ends when every target is met to ``tolerance``
    of all tokens. A domain whose posterior is 0 everywhere has no target, unless it is
    among ``labelled`` and others have one; the others keep their proportion. If a target can't be met, as no document has so high a posterior,
    or is not after ``max_steps`` or when the residual no longer falls, a
    ``ValueError`` tells the gap.
    """
    names = [f"p_{d}" for d in targets]
    k = len(names)

    def sums(path: list[np.ndarray], second: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, top = np.zeros(k + k * k), np.zeros(k)
            for b in batches:
                n = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                p = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
                a = p * n[:, None]
                total[:k] += a.T @ _rates(p, path)
                if second:
                    total[k:] += (a.T @ p).ravel()
                    top = np.maximum(top, np.where(n[:, None] > 0, p, 0.0).max(0, initial=0.0))
            both = np.concatenate([total, top])
            yield pa.record_batch([pa.array(np.arange(len(both)), pa.int32()), pa.array(both)], names=["i", "x"])

        x = F.when(F.col("i") < k + k * k, F.sum("x")).otherwise(F.max("x"))
        found = scored.select("n_tokens", *names).mapInArrow(run, "i int, x double").groupBy("i").agg(x.alias("x"))
        out = np.zeros(k + k * k + k)
        for r in found.collect():
            out[r.i] = r.x
        return out

    first = sums([], True)
    total = first[:k].sum()
    if total == 0:
        return []
    top = first[k + k * k:]
    share = np.array(list(targets.values())) * (top > 0)
    if not share.any():
        return []  # no document of a domain that has a target
    share = np.array([w if p > 0 or d in labelled else 0.0 for (d, w), p in zip(targets.items(), top, strict=True)])
    share = share / share.sum()
    want = share * total
    over = [f"{d}: {w:.6g} of all tokens, posteriors up to {p:.6g}"
            for d, w, p in zip(targets, share, top, strict=True) if w > p + tolerance]
    if over:
        raise ValueError(f"targets that no rates meet ({'; '.join(over)})")
    inverse = np.linalg.pinv(first[k:k + k * k].reshape(k, k), rcond=1e-12)
    path: list[np.ndarray] = []
    have, best = first[:k], np.inf
    while True:
        short = have - want
        gap = float(np.abs(short).max()) / total
        if gap <= tolerance:
            return path
        left = float(short @ inverse @ short)
        if len(path) >= max_steps or left >= best * (1 - 1e-9):
            raise ValueError(f"targets are missed by {gap:.3g} of all tokens after {len(path)} steps (tolerance {tolerance:g})")
        best = left
        path.append(inverse @ short)
        have = sums(path, False)[:k]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rows: int = linear.MAX_ROWS,
        fitted_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``p_<domain>`` and ``rate``: how often each document should be drawn.

    No row is dropped: rates are expected counts, 1 for a document that is to
    be read once. ``labels`` is the table ``labels(doc_id, quality, toxic)``.
    Null and empty texts have no tokens and get the rate of their posterior.
    Targets are met to ``TOLERANCE`` of all tokens, or a ``ValueError`` is
    raised; domains without a label have no target, and without any
    labelled document all rates are 1. Labels of a domain of which no document is
    there leave it its target, which then can't be met. The posteriors are fitted on the labelled documents of
    ``fitted_on``, for a table that has lost some of them. Repeated rows each
    give a row; an empty table gives none.
    """
    domains = with_domains(labels)
    scored = written(posteriors(docs, domains, list(targets), max_rows, fitted_on), "posteriors")
    seen = domains.agg(*(F.max(d).alias(d) for d in targets)).first()
    path = fit_rates(scored, targets, labelled=tuple(d for d in targets if seen[d]))
    names = [f"p_{d}" for d in targets]

    @F.pandas_udf("double")
    def rate(*p: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.column_stack(p), path))

    return scored.withColumn("rate", rate(*names) if path else F.lit(1.0))
