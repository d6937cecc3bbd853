"""Whitening of embeddings: Welford's rank-one updates, merged over partitions, and a symmetric QR eigen-solve.

Every task keeps the number, the mean and the centred second moments of the rows it has seen,
updated by one rank-one term a row; two such states become one by the parallel update formula.
States are merged FAN at a time in tasks, so that the driver gets FAN of them at most. A state has
the square of the vectors' dimension, whatever the number of rows. The driver brings the covariance
to tridiagonal form by reflections and then to diagonal form by implicitly shifted QR steps.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are
vectors shorter than the longest, which lack entries; repeated rows count as often as they are
there; a null id stays null; a table without a usable vector gives no row. A component along which
nothing varies has no whitened value (null) and is left out of identity_error, which is null where no
component is left. explained is null where nothing varies. A deviation beyond 64 bits is null;
deviation_exact has it. Entries whose whole value is beyond 2**62 stay there.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hard_negatives import matrix, usable

FAN = 16
COMPONENTS = 8
_STATE = "part long, n long, mean binary, moments binary, total array<decimal(38,0)>"


@dataclass
class Moments:
    """Number, mean and centred second moments (not divided) of rows, and their exact sums."""

    n: int
    mean: np.ndarray
    moments: np.ndarray
    total: list[int]

    @classmethod
    def none(cls, width: int) -> Moments:
        return cls(0, np.zeros(width), np.zeros((width, width)), [0] * width)

    def add(self, row: np.ndarray) -> None:
        self.n += 1
        delta = row - self.mean
        self.mean += delta / self.n
        self.moments += (delta * ((self.n - 1) / self.n))[:, None] * delta

    def merge(self, other: Moments) -> None:
        if not other.n:
            return
        n, delta = self.n + other.n, other.mean - self.mean
        self.moments += other.moments + (delta * (self.n / n * other.n))[:, None] * delta
        self.mean += delta * (other.n / n)
        self.n, self.total = n, [a + b for a, b in zip(self.total, other.total, strict=True)]

    def batch(self, part: int) -> pa.RecordBatch:
        total = pa.array([[Decimal(t) for t in self.total]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.moments.tobytes()], pa.binary()), total], names=["part", "n", "mean", "moments", "total"])

    @classmethod
    def of(cls, n: int, mean: bytes, moments: bytes, total: list) -> Moments:
        middle = np.frombuffer(mean).copy()
        return cls(n, middle, np.frombuffer(moments).reshape(len(middle), -1).copy(), [int(t) for t in total])


def sums(x: np.ndarray) -> list[int]:
    """Exact sums of the columns of integers; of other numbers, zeros."""
    if x.dtype.kind != "i":
        return [0] * x.shape[1]
    if np.abs(x).max(initial=0) < (1 << 62) // max(len(x), 1):
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def moments(vectors: DataFrame, column: str, width: int, change=lambda x: x) -> Moments:
    """Of all rows of a column of vectors, as change() makes them."""

    def run(batches):
        state = Moments.none(width)
        for batch in batches:
            x = change(matrix(batch.column(column)))
            if len(x):
                state.total = [a + b for a, b in zip(state.total, sums(x), strict=True)]
                for row in x.astype(float):
                    state.add(row)
        if state.n:
            yield state.batch(TaskContext.get().partitionId())

    def merged(table: pa.Table) -> pa.Table:
        state = Moments.none(width)
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        for r in rows:
            state.merge(Moments.of(r["n"], r["mean"], r["moments"], r["total"]))
        return pa.Table.from_batches([state.batch(rows[0]["part"] // FAN)])

    states, left = vectors.select(column).mapInArrow(run, _STATE), vectors.rdd.getNumPartitions()
    while left > FAN:
        states, left = states.groupBy(F.expr(f"part div {FAN}")).applyInArrow(merged, _STATE), -(-left // FAN)
    out = Moments.none(width)
    for r in states.orderBy("part").collect():
        out.merge(Moments.of(r.n, r["mean"], r["moments"], r.total))
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q.T @ a @ q of that form, by reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size or not np.any(v[1:]):
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - v * (v @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows, by shifted QR steps on its tridiagonal form."""
    d, e, q = tridiagonal(a)
    q, hi = q.T.copy(), len(d) - 1  # rows are rotated in place
    tiny = np.finfo(float).eps
    while hi > 0:
        e[np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            top, low, off = d[k], d[k + 1], e[k]
            d[k] = c * c * top + 2 * c * s * off + s * s * low
            d[k + 1] = s * s * top - 2 * c * s * off + c * c * low
            e[k] = c * s * (low - top) + (c * c - s * s) * off
            if k < hi - 1:
                x, z, e[k + 1] = e[k], s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order]


@dataclass
class Fit:
    """What whitening needs of the table."""

    n: int
    total: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """The rows of x along the first components; NaN where nothing varies."""
        values = self.values[:components]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.varies(components), (x - self.mean) @ self.vectors[:components].T / np.sqrt(values), np.nan)

    def varies(self, components: int) -> np.ndarray:
        """Whether an eigenvalue is more than rounding leaves of zero."""
        return self.values[:components] > 1e-12 * max(self.trace, 1e-300)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over the entries of (n x - total) ** 2, exact."""
        most = 2 * self.n * max(int(np.abs(x).max(initial=0)), max(map(abs, self.total), default=0) // max(self.n, 1) + 1)
        if most < 1 << 62:
            apart = self.n * x - np.array(self.total, np.int64)
            if int(np.abs(apart).max(initial=0)) ** 2 * max(x.shape[1], 1) < 1 << 62:
                return (apart * apart).sum(1).tolist()
        apart = self.n * x.astype(object) - np.array(self.total, object)
        return (apart * apart).sum(1).tolist()


def fit(vectors: DataFrame, column: str, width: int, components: int = COMPONENTS) -> Fit:
    """Fits all rows of a column of arrays of longs, each of that width."""
    got = moments(vectors, column, width)
    if not got.n:
        return Fit(0, [0] * width, np.zeros(width), np.zeros(width), np.eye(width), 0.0)
    covariance = got.moments / got.n
    values, rows = eigen(covariance)
    out = Fit(got.n, got.total, np.array([float(t / got.n) for t in got.total]), values, rows, float(np.trace(covariance)))
    kept = np.flatnonzero(out.varies(components))
    if len(kept):
        again = moments(vectors, column, len(kept), lambda x: out.whitened(x, components)[:, kept])
        out.identity_error = float(np.abs(again.moments / again.n - np.eye(len(kept))).max())
    return out


def shifted(vector: Column, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift of each entry, as long."""
    most = float(1 << 62)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(float(scale)) * c.cast("double")))).cast("long") + F.lit(shift).cast("long"))


def whiten(rows: DataFrame, scale: int = 1024, shift: int = 100000, components: int = COMPONENTS) -> DataFrame:
    """Rows (id, component, n, deviation, deviation_exact, whitened, explained, identity_error); rows has id and vector."""
    spark = rows.sparkSession
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").alias("x")).where(usable(F.col("x")))
    width = own.agg(F.max(F.size("x"))).first()[0] or 0
    schema = "id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    own = own.where(F.size("x") == width).select("id", shifted(F.col("x"), scale, shift).alias("x"))
    got, many = fit(own, "x", width, components), min(components, width)
    explained = [float(v / got.trace) if got.trace > 0 else None for v in got.values[:many]]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            far, white = got.deviations(x), got.whitened(x, many).ravel()
            size = len(white)
            row = np.repeat(np.arange(len(x)), many)
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)).take(pa.array(row))
            columns = [
                batch.column("id").take(pa.array(row)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, got.n)),
                pa.array([v if v < 1 << 63 else None for v in far], pa.int64()).take(pa.array(row)),
                exact,
                pa.array(white, mask=np.isnan(white)),
                pa.array(explained * len(x), pa.float64()),
                pa.array([got.identity_error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "deviation_exact", "whitened", "explained", "identity_error"])

    return own.mapInArrow(run, schema)
