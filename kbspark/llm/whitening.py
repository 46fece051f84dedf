"""op 13: whitening of embeddings by streamed covariance and a symmetric QR eigen-solve.

Entries become whole numbers x = floor(64 c) + 1000000.  The offset cancels exactly in every result (n x - S, covariances), so
states hold x - 1000000.  Each partition's iterator keeps a count, exact sums, a mean and the sum of outer products of
deviations, and updates them by one rank-one step a vector (Welford), so a large mean of the data never enters a product either.  Partial states are merged by the parallel update formula in a tree of bounded fan-in: tasks merge groups of them,
level by level, and one state of the size of the dimensions squared is left for the driver, however many partitions there were.
Householder reflections and implicitly shifted QR steps (``symmetric_qr``) turn its covariance into eigenvalues and
eigenvectors.  A second pass gathers the covariance of the whitened vectors themselves in the same way and gives the largest
deviation from the identity; the result is a third pass, one row a vector and component, without a shuffle.

Defined cases: null and empty vectors and those with a null, NaN or infinite entry take no part; vectors of unlike lengths raise
``ValueError``, entries of which x leaves the range of a double's whole numbers ``OverflowError``; rows of a repeated or null vec_id each count and each have their rows; components
without variance (under ``RANK`` of the largest, so also those of a single vector) are whitened to 0 and left out of
identity_error, which is 0 where no component is left; a deviation that no long holds is null; an empty table gives an empty result.  Columns other
than vec_id and embedding are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Whole numbers are floor(SCALE c), but for the offset; components given.
SCALE, COMPONENTS = 64, 32
#: Share of the largest eigenvalue, per dimension, under which a component has no variance.
RANK = float(np.finfo(np.float64).eps)
#: States merged by one task at once, and the bytes they may take.
FAN, FAN_BYTES = 32, 64 << 20
_STATE = "part long, state binary"
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """n vectors with sums (exact, if they are whole numbers), mean and outer, the sum of outer products of deviations from the mean."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    outer: np.ndarray

    @classmethod
    def of(cls, size: int, kind: type = np.float64) -> Moments:
        return cls(0, np.zeros(size, kind), np.zeros(size), np.zeros((size, size)))

    def add(self, vectors: np.ndarray) -> None:
        """One rank-one step a vector."""
        step = np.empty_like(self.outer)
        self.sums += vectors.sum(axis=0)
        for x in vectors.astype(np.float64):
            off = x - self.mean
            share = self.n / (self.n + 1)
            self.n += 1
            self.mean += off / self.n
            np.multiply.outer(off, off * share, out=step)
            self.outer += step

    def merged(self, other: Moments) -> Moments:
        if len(self.sums) != len(other.sums):
            raise ValueError(f"vectors of {len(self.sums)} and of {len(other.sums)} entries")
        if not self.n or not other.n:
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        return Moments(n, self.sums + other.sums, self.mean + off * (other.n / n), self.outer + other.outer + np.multiply.outer(off, off * (self.n * other.n / n)))


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns in that order."""
    a = np.array(a, np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):  # Householder: a becomes tridiagonal, q gathers the reflections
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    q = np.ascontiguousarray(q.T)  # rotations then mix rows
    tiny, hi, rounds = np.finfo(np.float64).eps, n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if small[hi - 1]:
            hi, rounds = hi - 1, 0
            continue
        rounds += 1
        if rounds > 100:
            raise ArithmeticError("the eigen-solve doesn't converge")
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2  # Wilkinson's shift: the eigenvalue of the last block nearest its corner
        shift = d[hi] - e[hi - 1] ** 2 / (half + (np.hypot(half, e[hi - 1]) if half >= 0 else -np.hypot(half, e[hi - 1])))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # the bulge is chased down the diagonal by rotations
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * p + 2 * c * s * b + s * s * t, s * s * p - 2 * c * s * b + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * b
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


def _whole(column) -> np.ndarray:
    """x, without its offset, of a column of vectors without nulls, as longs."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries")
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(scaled).max(initial=0.0) > 2.0**52:
        raise OverflowError("an entry leaves the range of whole numbers")
    return scaled.astype(np.int64).reshape(len(column), -1)


def _states(vectors_of, kind: type):
    """A partition's moments, one row."""

    def run(batches):
        held = None
        for batch in batches:
            if len(batch):
                x = vectors_of(batch.column("embedding"))
                if held is None:
                    held = Moments.of(x.shape[1], kind)
                elif len(held.sums) != x.shape[1]:
                    raise ValueError(f"vectors of {len(held.sums)} and of {x.shape[1]} entries")
                held.add(x)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(held)], pa.binary())], names=["part", "state"])

    return run


def _merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    states = [pickle.loads(s) for s in group.sort_values("part")["state"]]
    out = states[0]
    for other in states[1:]:
        out = out.merged(other)
    return pd.DataFrame({"part": [key[0]], "state": [pickle.dumps(out)]})


def moments(vectors: DataFrame, vectors_of=_whole, kind: type = np.int64) -> Moments | None:
    """The moments of all vectors (embedding); None where there are none."""
    level = materialize(vectors.select("embedding").mapInArrow(_states(vectors_of, kind), _STATE), "moments")
    while (found := level.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("state")).alias("size")).first())["n"] > 1:
        # parts are numbers from 0 up, so dividing them by the fan-in ends with one
        fan = max(2, min(FAN, FAN_BYTES // found["size"]))
        groups = level.select(F.expr(f"part div {fan}").alias("g"), "part", "state").groupBy("g")
        merged = materialize(groups.applyInPandas(_merge, _STATE), "merged-moments")
        release(level)
        level = merged
    row = level.first()
    release(level)
    return pickle.loads(row["state"]) if row else None


@dataclass
class Whitening:
    """The fit: n, exact sums, eigenvalues (falling) and unit eigenvectors (rows) of the first components, and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in which the offset cancels: longs where they fit, else Python's whole numbers."""
        fits = self.n * max(1.0, float(np.abs(x).max(initial=0))) < 2.0**62
        return self.n * x - self.sums if fits else self.n * x.astype(object) - self.sums.astype(object)

    def scales(self) -> np.ndarray:
        """1 / sqrt(e); 0 for a component without variance."""
        real = self.real()
        return np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)

    def real(self) -> np.ndarray:
        return self.values > RANK * self.sums.size * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x).astype(np.float64) / self.n) @ self.axes.T * self.scales()


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    held = moments(vectors)
    if held is None:
        return None
    values, axes = symmetric_qr(held.outer / held.n)
    return Whitening(held.n, held.sums, values[:components], np.ascontiguousarray(axes.T[:components]), float(np.trace(held.outer) / held.n))


def identity_error(vectors: DataFrame, white: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, over the components with variance."""
    held, real = moments(vectors, lambda column: white.whitened(_whole(column)), np.float64), white.real()
    return float(np.abs(held.outer / held.n - np.eye(len(real)))[np.ix_(real, real)].max(initial=0.0))


def _squares(off: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None beyond a long."""
    if off.dtype == object or np.abs(off).max(initial=0) ** 2.0 * off.shape[1] >= 2.0**62:
        whole = [sum(v * v for v in r) for r in off.tolist()]
        return [v if v < 2**63 else None for v in whole]
    return (off * off).sum(axis=1).tolist()


def _rows(white: Whitening, error: float):
    k = len(white.values)
    explained = np.maximum(white.values, 0.0) / white.trace if white.trace > 0 else np.zeros(k)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, m = _whole(batch.column("embedding")), len(batch)
            spread = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [spread(batch.column("vec_id").cast(pa.int64()), pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, white.n, np.int64)), spread(_squares(white.deviations(x)), pa.int64()),
                 pa.array(white.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector that takes part."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is above every number
    vectors = embeddings.select("vec_id", "embedding").where("embedding is not null and size(embedding) > 0").where(finite)
    white = fit(vectors, components)
    if white is None:
        return embeddings.sparkSession.createDataFrame([], _ROWS)
    return vectors.mapInArrow(_rows(white, identity_error(vectors, white)), _ROWS)
