"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Entries become whole numbers. Moments about a whole-number centre are whole too, so sums over partitions are exact, come out the
same in any order, and give the scatter about the true mean without cancellation. Spark collects one moment a pair of
dimensions, whose number depends on the vectors' length alone; the two factorisations of that matrix are small.

With V = G G' from the pivoted factor G, rotations of G's columns make them orthogonal: their squared norms are V's eigenvalues
and their directions its eigenvectors. V itself is never multiplied out again, so small eigenvalues keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import prepare, store

COMPONENTS = 4
SCALE = 256
LARGEST = 2.0 ** 46  # entries of that size or more, whose scaled products would leave 128 bits, count as non-finite
EXACT = 2.0 ** 53
SWEEPS = 60
ROWS = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, "
    "eigenvalue double"
)
_OUT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()), ("eigenvalue", pa.float64()),
])
_MOMENT = pa.decimal128(38, 0)


def whole_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """floor(256 c) of every entry as 64-bit integers; None for a null vector or one with a null, non-finite or huge entry."""
    out = []
    for v in column:
        if not v.is_valid or v.values.null_count:
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(np.floor(SCALE * x).astype(np.int64) if (np.abs(x) < LARGEST).all() else None)
    return out


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(size, x): each whole-number vector once, as little-endian 64-bit integers; copies meet within tasks first."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in whole_vectors(batch.column(0)) if x is not None and len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) for x in found], pa.int32()), pa.array([x.astype("<i8").tobytes() for x in found], pa.binary())], ["size", "x"]
            )

    return vectors.select("embedding").mapInArrow(whole, "size int, x binary").distinct()


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.asarray(batch.column(0))
    for size in np.unique(sizes).tolist():
        rows = batch.column(1).filter(pa.array(sizes == size)).to_pylist()
        yield size, np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), size)


def _sums(fit: DataFrame, terms) -> dict[int, list[int]]:
    """Exact totals over the fit list of whole-number terms(size, rows) -> array, one total a place, for each size."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, x in _by_size(batch):
                found = terms(size, x).ravel().astype(object)  # whole numbers of any length from batch to batch
                held[size] = held[size] + found if size in held else found
        for size, total in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(total), size, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)),
                pa.array([int(v) for v in total], _MOMENT),
            ], ["size", "place", "value"])

    rows = fit.mapInArrow(partial, "size int, place int, value decimal(38,0)").groupBy("size", "place").agg(F.sum("value").alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in rows.collect():  # an iterator would be a job of its own for every partition
        out.setdefault(r.size, {})[r.place] = int(r.value)
    return {size: [v for _, v in sorted(found.items())] for size, found in out.items()}


def _products(z: np.ndarray) -> np.ndarray:
    """z' z without rounding."""
    if z.size and float(np.abs(z).max()) ** 2 * len(z) < EXACT:
        return (z.astype(np.float64).T @ z).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with G G' = v, rows in v's order: a triangular factor whose rows follow the pivots, up to the numerical rank."""
    rest, size = v.astype(np.float64).copy(), len(v)
    order, factor = np.arange(size), np.zeros((size, size))
    floor = np.diag(rest).max(initial=0.0) * size * np.finfo(float).eps
    for k in range(size):
        pivot = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[pivot, pivot] <= floor:
            factor = factor[:, :k]
            break
        for a in (rest, rest.T, factor, order):
            a[[k, pivot]] = a[[pivot, k]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1:, k] = rest[k + 1:, k] / factor[k, k]
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    out = np.empty_like(factor)
    out[order] = factor
    return out


def one_sided_jacobi(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of g g', falling, and unit eigenvectors as columns: pairs of columns are rotated until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs that are rotated together.
    """
    columns = g.shape[1]
    if columns % 2:
        g = np.concatenate([g, np.zeros((len(g), 1))], 1)
    g, ring = g.copy(), np.arange(g.shape[1])
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(ring) - 1, 0)):
            i, j = ring[:len(ring) // 2], ring[:len(ring) // 2 - 1:-1]
            a, b = g[:, i], g[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            act = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if act.any():
                turned = True
                tau = (bb - aa)[act] / (2 * ab[act])
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
                c = 1 / np.hypot(1.0, t)
                g[:, i[act]], g[:, j[act]] = c * (a[:, act] - t * b[:, act]), c * (b[:, act] + t * a[:, act])
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")[:columns]
    values, g = values[order], g[:, order]
    return values, np.divide(g, np.sqrt(values), out=np.zeros_like(g), where=values > 0)


class Fit:
    """Whitening of the vectors of one length: n, sums S, eigenvalues, components, trace of the covariance."""

    def __init__(self, n: int, sums: list[int], centre: list[int], moments: list[int], components: int):
        size, self.n, self.sums = len(sums), n, sums
        shifted = [s - n * c for s, c in zip(sums, centre)]
        wide = np.array(moments, object).reshape(size, size) * n - np.outer(np.array(shifted, object), np.array(shifted, object))
        v = (wide / (n * n)).astype(np.float64)  # whole numbers until here, so each entry is rounded once
        values, vectors = one_sided_jacobi(pivoted_cholesky(v))
        top = min(components, size)
        self.values = np.zeros(top)
        self.values[:min(top, len(values))] = values[:top]
        self.vectors = np.zeros((size, top))
        self.vectors[:, :min(top, len(values))] = vectors[:, :top]
        trace = float(np.trace(v))
        self.explained = [float(e / trace) if trace > 0 else None for e in self.values]
        self.identity_error: float | None = None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows centred before they are projected; NaN along components without variance."""
        if not x.size or float(np.abs(x).max()) * self.n + max(map(abs, self.sums)) < 2.0 ** 62:
            centred = (self.n * x - np.array(self.sums, np.int64)).astype(np.float64) / self.n
        else:
            centred = ((self.n * x.astype(object) - np.array(self.sums, object)) / self.n).astype(np.float64)
        scale = np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return centred @ self.vectors / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where it leaves 64 bits."""
        far = float(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if far ** 2 * x.shape[1] < 2.0 ** 62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        found = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [int(d) if d < 1 << 63 else None for d in found]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """One fit a vector length from stored distinct vectors; three passes over them, none of which shuffles vectors."""
    first = _sums(fit, lambda size, x: np.append(x.astype(object).sum(0) if np.abs(x).max() > EXACT / len(x) else x.sum(0), len(x)))
    centres = {size: [round(s / found[-1]) for s in found[:-1]] for size, found in first.items()}
    second = _sums(fit, lambda size, x: _products(x - np.array(centres[size], np.int64)))
    fits = {size: Fit(found[-1], found[:-1], centres[size], second[size], components) for size, found in first.items()}

    def whitened_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, x in _by_size(batch):
                w = fits[size].whiten(x)
                held[size] = held.get(size, 0) + np.concatenate([w.sum(0), (w.T @ w).ravel()])
        for size, total in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(total), size, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                ["size", "place", "value"],
            )

    found: dict[int, dict[int, float]] = {}
    for r in fit.mapInArrow(whitened_moments, "size int, place int, value double").groupBy("size", "place").agg(F.sum("value").alias("v")).collect():
        found.setdefault(r.size, {})[r.place] = r.v
    for size, moments in found.items():
        own, top = fits[size], len(fits[size].values)
        flat = np.array([moments[i] for i in range(len(moments))]) / own.n
        error = np.abs(flat[top:].reshape(top, top) - np.outer(flat[:top], flat[:top]) - np.eye(top))
        real = own.values > 0
        own.identity_error = float(error[np.ix_(real, real)].max()) if real.any() else None
    return fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue.

    Rows whose vector is null or holds a null, non-finite or huge (2^46 and more) entry are dropped, as are empty vectors. Vectors
    of each length are whitened among themselves. The fit takes every distinct whole-number vector once; rows that repeat, null
    vec_ids included, each get their rows. Components are numbered by falling eigenvalue, min(components, length) of them; one
    without variance has whitened null, and identity_error is that of the others (null where there are none). explained is null
    where nothing varies at all; deviation is null where it leaves 64 bits. Other columns are ignored; an empty table gives no
    rows.
    """
    prepare(vectors.sparkSession)
    fits = fit_whitening(store(distinct_vectors(vectors), "whole-vectors"), components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), whole_vectors(batch.column(1))
            for size, own in fits.items():
                at = [i for i, x in enumerate(whole) if x is not None and len(x) == size]
                if not at:
                    continue
                x, top = np.stack([whole[i] for i in at]), len(own.values)
                w = own.whiten(x).ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in at for _ in range(top)], pa.int64()), pa.array(list(range(1, top + 1)) * len(at), pa.int32()),
                    pa.array([own.n] * len(w), pa.int64()), pa.array([d for d in own.deviations(x) for _ in range(top)], pa.int64()),
                    pa.array(w, mask=np.isnan(w)), pa.array(own.explained * len(at), pa.float64()),
                    pa.array([own.identity_error] * len(w), pa.float64()), pa.array(np.tile(own.values, len(at))),
                ], schema=_OUT)

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(project, ROWS)
