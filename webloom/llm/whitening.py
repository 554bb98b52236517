"""Embedding whitening by incremental eigendecomposition.

A task holds the spectrum of its vectors' scatter: the eigenvalues and
eigenvectors of the sum of their centred outer products. Every vector is a
centred rank-one update: the secular equation gives the new eigenvalues between
the old ones, after directions that the update leaves alone are deflated. The
tasks' spectra are combined, in rounds of a few each, by a rank-one update per
eigenvector and one for the distance of the means. A last pass over the data
projects it on the combined eigenvectors and solves the projected problem
(Rayleigh-Ritz), which brings the components to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import slices, written

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned.
COMPONENTS = 16
#: Spectra that one task combines.
FAN_IN = 8
#: Eigenvalues below this share of the largest are no variance: their directions cannot be whitened.
NO_VARIANCE = 1e-12
EPS = np.finfo(float).eps


def _secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum z_j^2 / (d_j - x)`` for ascending distinct ``d``: the nearest pole, and the distance from it.

    Each root lies between two poles, the last above the largest. A root is
    found as a distance from the nearer pole, so that differences to poles stay
    exact: both sides are replaced by a pole of their own that has their value and slope,
    and the step is halved instead wherever that leaves the bracket.
    """
    n = len(d)
    top = d[-1] + rho * float(z @ z)
    right = np.append(d[1:], top)
    gap = right - d
    w = rho * z * z
    middle = 1 + (w / (d - (d + gap / 2)[:, None])).sum(1)
    left_near = (middle >= 0) | (np.arange(n) == n - 1)
    origin = np.where(left_near, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    delta = d - d[origin][:, None]
    half = gap / 2
    whole = (np.arange(n) == n - 1) & (middle < 0)
    lo = np.where(left_near, np.where(whole, half, 0.0), -half)
    hi = np.where(left_near, np.where(whole, gap, half), 0.0)
    lower = np.tril(np.ones((n, n)))  # poles up to the root's own
    upper = 1 - lower
    x = (lo + hi) / 2
    pole_l = delta[np.arange(n), np.arange(n)]
    pole_r = np.append(delta[np.arange(n - 1), np.arange(1, n)], np.inf)
    for _ in range(80):
        near = 1 / (delta - x[:, None])
        t = w * near
        psi, phi = np.einsum("ij,ij->i", t, lower), np.einsum("ij,ij->i", t, upper)
        f = 1 + psi + phi
        done = np.abs(f) <= 4 * n * EPS * (1 + np.abs(psi) + np.abs(phi))
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        if (done | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))).all():
            break
        t *= near
        dpsi, dphi = np.einsum("ij,ij->i", t, lower), np.einsum("ij,ij->i", t, upper)
        gl, gr = pole_l - x, pole_r - x
        with np.errstate(all="ignore"):
            # psi ~ r + s / (pole_l - y), phi ~ q + u / (pole_r - y); a root y of 1 + r + q + both fractions
            s, u = dpsi * gl * gl, np.where(np.isinf(gr), 0.0, dphi * gr * gr)
            c = f - dpsi * gl - np.where(np.isinf(gr), 0.0, dphi * gr)
            p = np.where(np.isinf(gr), 1.0, gr)
            b = c * (gl + p) + s + u
            e = c * gl * p + s * p + u * gl
            root = np.sqrt(np.maximum(b * b - 4 * c * e, 0))
            step = np.where(b > 0, 2 * e / (b + root), (b - root) / (2 * c))
            step = np.where(np.isinf(gr), gl + s / c, step)
        y = x + step
        inside = np.isfinite(y) & (y > lo) & (y < hi)
        x = np.where(done, x, np.where(inside, y, (lo + hi) / 2))
    return origin, x


def rank_one_update(d: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of ``q diag(d) q' + rho v v'``."""
    z = q.T @ v
    size = rho * float(z @ z)
    if size <= 0:
        return d, q
    tol = 8 * EPS * max(float(np.abs(d).max()), size)
    # equal eigenvalues: their eigenvectors are turned so that one of them takes the whole update
    edge = np.flatnonzero(np.diff(d) > tol) + 1
    starts, ends = np.append(0, edge), np.append(edge, len(d))
    many = np.flatnonzero(ends - starts > 1)
    if len(many):
        q, z = q.copy(), z.copy()
    for k in many:
        g = slice(starts[k], ends[k])
        h, length = z[g].copy(), np.linalg.norm(z[g])
        if length == 0:
            continue
        h[-1] += np.copysign(length, h[-1])
        h /= np.linalg.norm(h)
        q[:, g] -= 2 * np.outer(q[:, g] @ h, h)
        last = z[ends[k] - 1]
        z[g] = 0
        z[ends[k] - 1] = -np.copysign(length, last)
    moved = rho * np.abs(z) * np.linalg.norm(z) > tol
    if not moved.any():
        return d, q
    m, zm = d[moved], z[moved]
    origin, x = _secular_roots(m, zm, rho)
    apart = (m - m[origin][:, None]) - x[:, None]  # pole j less root i
    # the update whose roots these are exactly, so that the eigenvectors are orthogonal
    gaps = m[:, None] - m
    np.fill_diagonal(gaps, 1.0)
    with np.errstate(all="ignore"):
        ratio = np.abs(apart) / np.abs(gaps.T)  # root i, pole j
        exact = np.sqrt(np.prod(ratio, axis=0) / rho)
    exact = np.where(np.isfinite(exact), exact, np.abs(zm))
    vectors = np.copysign(exact, zm) / np.where(apart == 0, EPS * tol, apart)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    out_d, out_q = d.copy(), q.copy()
    out_d[moved] = m[origin] + x
    out_q[:, moved] = q[:, moved] @ vectors.T
    order = np.argsort(out_d, kind="stable")
    return out_d[order], out_q[:, order]


@dataclass
class Spectrum:
    """Count, mean, and eigenvalues and eigenvectors of the scatter of some vectors."""

    n: int
    mean: np.ndarray
    d: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width), np.zeros(width), np.eye(width))

    def add(self, v: np.ndarray) -> None:
        away = v - self.mean
        self.n += 1
        if self.n > 1:
            self.d, self.q = rank_one_update(self.d, self.q, away, (self.n - 1) / self.n)
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        away, n = other.mean - self.mean, self.n + other.n
        if self.n:
            for value, vector in zip(other.d, other.q.T, strict=True):
                if value > 0:
                    self.d, self.q = rank_one_update(self.d, self.q, vector, float(value))
            self.d, self.q = rank_one_update(self.d, self.q, away, self.n * other.n / n)
        else:
            self.d, self.q = other.d, other.q
        self.mean, self.n = self.mean + away * (other.n / n), n

    def row(self) -> list:
        return [self.n, self.mean.tobytes(), self.d.tobytes(), self.q.tobytes()]

    @classmethod
    def of(cls, n: int, mean: bytes, d: bytes, q: bytes) -> Spectrum:
        width = len(mean) // 8
        return cls(n, *(np.frombuffer(x).copy() for x in (mean, d)), np.frombuffer(q).reshape(width, width).copy())


_SPECTRUM = "id long, n long, mean binary, d binary, q binary"
_NAMES = ["id", "n", "mean", "d", "q"]


def whole_numbers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite entries, with ``x``: its entries as whole numbers."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return rows.filter(F.col(column).isNotNull()).filter(finite).withColumn("x", x)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, dtype=np.int64) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def _sums(fit: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Exact count and sums per dimension."""
    row = fit.select(F.posexplode("x")).groupBy("pos").agg(F.count("col").alias("n"), F.sum(
        F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    sums = {r.pos: int(r.s) for r in row}
    return max((r.n for r in row), default=0), np.array([sums.get(i, 0) for i in range(width)], object)


def spectrum(fit: DataFrame, width: int, offset: np.ndarray) -> Spectrum:
    """Spectrum of ``x - offset`` of all rows: rank-one updates in each task, then rounds that combine ``FAN_IN`` spectra."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for b in slices(batches):
            for v in _matrix(b.column(0), width) - offset:
                own.add(v.astype(float))
        if own.n:
            yield pa.record_batch([[x] for x in [TaskContext.get().partitionId(), *own.row()]], names=_NAMES)

    def combine(group: pa.Table) -> pa.Table:
        own = Spectrum.empty(width)
        for r in sorted(group.to_pylist(), key=lambda r: r["id"]):
            own.combine(Spectrum.of(r["n"], r["mean"], r["d"], r["q"]))
        return pa.table([[x] for x in [group.column("id")[0].as_py() // FAN_IN, *own.row()]], names=_NAMES)

    table = written(fit.select("x").mapInArrow(run, _SPECTRUM), "spectra")
    last = table.agg(F.max("id")).first()[0]
    while last:
        step = table.withColumn("group", F.floor(F.col("id") / FAN_IN)).groupBy("group").applyInArrow(
            lambda key, group: combine(group.drop_columns(["group"])), _SPECTRUM)
        table, last = written(step, "spectra"), last // FAN_IN
    r = table.first()  # one spectrum: its size is that of the components, not of the data
    return Spectrum.of(r.n, bytes(r.mean), bytes(r.d), bytes(r.q))


def projected(fit: DataFrame, width: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the rows' centred projections on the columns of ``basis``, added up by tasks and then in rounds."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k, k))
        for b in slices(batches, 4096):
            y = centred(_matrix(b.column(0), width), n, sums) @ basis
            own += y.T @ y
        yield pa.record_batch([pa.array(np.arange(k * k)), pa.array(own.ravel() / n)], names=["at", "value"])

    rows = fit.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(k * k)
    for r in rows:
        out[r["at"]] = r.value
    return out.reshape(k, k)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean is taken off in whole numbers."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    part = np.array([(int(s) % n) / n for s in sums])
    return (x - whole).astype(float) - part


@dataclass
class Whitening:
    """Components by falling eigenvalue, and what whitens a vector of ``width`` entries."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct whole-number vectors ``x`` of ``width`` entries; None if it has no rows."""
    n, sums = _sums(fit, width)
    if not n:
        return None
    own = spectrum(fit, width, np.array([int(s) // n for s in sums], np.int64))
    basis, _ = np.linalg.qr(own.q)
    for _ in range(2):  # the second pass sees a nearly diagonal matrix, so its rotation is exact to rounding
        ritz = projected(fit, width, n, sums, basis)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        basis, _ = np.linalg.qr(basis @ turn)
    order = np.argsort(-values, kind="stable")
    trace = float(values.sum())
    keep = [i for i in order[:components] if values[i] > NO_VARIANCE * values[order[0]]]
    values, vectors = values[keep], basis[:, keep]
    if not len(keep):
        return Whitening(n, sums, values, vectors, trace, 0.0)
    again = projected(fit, width, n, sums, vectors / np.sqrt(values))
    return Whitening(n, sums, values, vectors, trace, float(np.abs(again - np.eye(len(keep))).max()))


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable row and component.

    The columns vec_id and embedding are read, others are ignored. Vectors that are null or hold null or non-finite entries
    give no rows; rows that repeat or share a vec_id give rows each, and count once in the fit if
    their vectors are equal. Vectors must have one length to be whitened together: those of another length
    than most (of the longer of two as frequent) give no rows, nor do empty ones. There are fewer
    components where the vectors span fewer directions, none for a single vector.
    ``deviation`` is null if it does not fit a long.
    """
    usable = whole_numbers(rows.select(F.col("vec_id").cast("long"), "embedding")).select("vec_id", "x")
    widths = usable.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = widths.width if widths else 0
    usable = usable.filter(F.size("x") == width)
    model = fit_whitening(written(usable.select("x").distinct(), "distinct-vectors"), width, components) if width else None
    if model is None:
        return rows.sparkSession.createDataFrame([], _OUT)
    n, sums = model.n, model.sums
    turn, explained = model.vectors / np.sqrt(model.values), model.values / (model.trace or 1.0)
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([int(s) // n for s in sums], np.int64)
        part = [int(s) % n for s in sums]
        for b in slices(batches):
            x = _matrix(b.column(1), width)
            far = n * (x - whole) - np.array(part, np.int64)
            safe = (np.abs(x - whole).max(1, initial=0).astype(float) + 1) ** 2 * float(n) ** 2 * width < 2.0 ** 62
            exact = (far * far).sum(1)
            deviation = [int(e) if s else _exact(v, whole, part, n) for e, s, v in zip(exact, safe, x, strict=True)]
            y = centred(x, n, sums) @ turn
            yield pa.record_batch([
                b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                pa.array([v for v in deviation for _ in range(k)], pa.int64()), pa.array(y.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return usable.select("vec_id", "x").mapInArrow(run, _OUT)


def _exact(x: np.ndarray, whole: np.ndarray, part: list[int], n: int) -> int | None:
    total = sum((n * (int(a) - int(w)) - p) ** 2 for a, w, p in zip(x, whole, part, strict=True))
    return total if total < 1 << 63 else None
