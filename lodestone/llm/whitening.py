"""Whitening of vectors: covariance by compensated sums over many tasks, and its components.

Entries become integers on a grid, so means are exact fractions. Rows are centred to pairs of doubles (high, low). Outer
products are summed without error: each centred column is cut into slices of BITS bits, so that a product of two slices,
summed over a batch, is exact in one double, whatever order BLAS adds in; these sums enter (high, low) accumulators by
error-free additions, and the accumulators of all tasks are merged in the same way. LAPACK's tridiagonal divide and
conquer (numpy's eigh) gives the components, which two steps of refinement in extended precision bring to full doubles.

Vectors that are null, empty, or hold null or non-finite entries, or entries too large for the grid (|64 c| of 2^52 and
more), are left out. So are vectors of another length than most distinct ones have (the longer length if tied). Components
without variance (an eigenvalue of rounding size beside the largest) are left out, so a table of one distinct vector, like
an empty one, gives no rows. Repeated rows and ids each give rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ARROW_BYTES, arrow_map, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits of a slice and rows of a batch: products of two slices have 2 * BITS bits, ROWS of them 10 more, 52 in all.
BITS, ROWS, SLICES = 21, 1024, 5


def grid(c: Column) -> Column:
    """The array of longs of a vector."""
    return F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT)


def is_whole(c: Column) -> Column:
    """Whether a vector has entries, all of them finite and within the grid."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) * SCALE < 2.0**52)), F.lit(False))


# ---- sums without error


def two_sum(a, b):
    """a + b as a double and what it lacks."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(ah, al, bh, bl):
    """The sum of two numbers of high and low part."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Columns cut into SLICES parts, each whole multiples of a power of two of at most 2^BITS; what is left is below 2^-104 of the column's largest."""
    largest = np.abs(high).max(axis=0)
    unit = np.exp2(np.ceil(np.log2(np.where(largest > 0, largest, 1.0))))
    out = []
    for _ in range(SLICES):
        unit = unit * 2.0**-BITS
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = two_sum(high - part, low)
    return out


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum over rows of each row's outer product with itself, as high and low parts."""
    d = high.shape[1]
    sums = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(high), ROWS):
        parts = slices(high[at : at + ROWS], low[at : at + ROWS])
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                exact = parts[i].T @ parts[j]
                sums = add_pairs(*sums, exact, np.zeros_like(exact))
                if i != j:
                    sums = add_pairs(*sums, exact.T, np.zeros_like(exact))
    return sums


def summed_products(rows: DataFrame, columns: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of what columns() makes of each batch: each task sums its own, and line by line of the matrix they are merged.

    A task sends one row for each line, so merging is dealt over as many tasks as lines; the driver gets one matrix.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    schema = "line int, high array<double>, low array<double>"

    def sent(lines: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(lines), pa.int32()), pa.array([list(h) for h, _ in lines.values()], pa.list_(pa.float64())), pa.array([list(x) for _, x in lines.values()], pa.list_(pa.float64()))], ["line", "high", "low"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = outer_sums(*columns(b))
                total = own if total is None else add_pairs(*total, *own)
        if total is not None:
            yield sent(dict(enumerate(zip(*total, strict=True))))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for line, h, x in zip(b["line"].to_pylist(), b["high"], b["low"], strict=True):
                own = np.asarray(h.values), np.asarray(x.values)
                lines[line] = add_pairs(*lines[line], *own) if line in lines else own
        if lines:
            yield sent(lines)

    found = sorted(rows.mapInArrow(of_task, schema).repartition("line").mapInArrow(merged, schema).collect(), key=lambda r: r["line"])
    return np.array([r["high"] for r in found]), np.array([r["low"] for r in found])


def components(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix of high and low parts."""
    values, start = np.linalg.eigh((high + high.T) / 2)
    a, x = high.astype(np.longdouble) + low, start[:, ::-1].astype(np.longdouble)
    a, values = (a + a.T) / 2, values[::-1].astype(np.longdouble)
    for _ in range(2):
        # how far from orthogonal and from diagonal; close eigenvalues are only made orthogonal
        r, s = np.eye(len(a), dtype=np.longdouble) - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 2 * (np.abs(s - np.diag(values)).sum() + np.abs(values).max() * np.abs(r).sum())
        x = x + x @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


# ---- the operator


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sums by dimension, and for each component its direction over the root of its eigenvalue."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]
    identity_error: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the mean, as high and low parts."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        part = [Fraction(s % self.n, self.n) for s in self.sums]
        high = np.array([float(p) for p in part])
        low = np.array([float(p - Fraction(h)) for p, h in zip(part, high, strict=True)])
        s, e = two_sum((x - whole).astype(float), -high)
        return two_sum(s, e - low)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return high @ self.axes + low @ self.axes

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exact; one that is no long raises when it is sent to Spark."""
        whole, rest = (np.array([f(s, self.n) for s in self.sums], dtype=np.int64) for f in (int.__floordiv__, int.__mod__))
        d = x - whole
        most = self.n * (float(np.abs(d).max(initial=0)) + 1)
        if most**2 * len(self.sums) >= 2.0**62:
            d, rest = d.astype(object), rest.astype(object)
        return [int(v) for v in ((d * self.n - rest) ** 2).sum(axis=1)]


def vectors(batch: pa.RecordBatch, col: str = "x") -> np.ndarray:
    n = batch.num_rows
    return batch[col].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x once, of the length that most have, as a stored table; and their number."""
    fit = materialize(rows.select("x").distinct(), "fit-vectors")
    common = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (fit.where(F.size("x") == common["d"]), common["count"]) if common else (fit, 0)


def exact_sums(fit: DataFrame) -> list[int]:
    """Sums by dimension, of any size."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for b in batches:
            if b.num_rows:
                x = vectors(b)
                for at in range(0, len(x), ROWS):  # below 2^52 each, so ROWS of them are a long
                    total = total + x[at : at + ROWS].sum(axis=0).astype(object)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(v)) for v in total], pa.decimal128(28, 0))], ["dim", "part"])

    found = fit.mapInArrow(of_task, "dim int, part decimal(28,0)").groupBy("dim").agg(F.sum("part").alias("s")).collect()
    return [int(r["s"]) for r in sorted(found, key=lambda r: r["dim"])]


def fit_whitening(fit: DataFrame, n: int, most: int = COMPONENTS) -> Whitening:
    """Reads the fit list three times: for sums, for the covariance, and for that of the whitened rows."""
    plain = Whitening(n, exact_sums(fit), np.zeros((0, 0)), [], 0.0)
    high, low = summed_products(fit, lambda b: plain.centred(vectors(b)))
    values, axes = components(high / n, low / n)
    kept = [k for k in range(min(most, len(values))) if values[k] > len(values) * np.finfo(float).eps * values[0]] if values[0] > 0 else []
    made = Whitening(n, plain.sums, axes[:, kept] / np.sqrt(values[kept]), [float(values[k] / values.sum()) for k in kept], 0.0)
    if not kept:
        return made

    def whitened(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w = made.whiten(vectors(b))
        w = np.hstack([w, np.ones((len(w), 1))])  # a column of ones brings the sums along
        return w, np.zeros_like(w)

    w, _ = summed_products(fit, whitened)
    mean = w[-1, :-1] / n
    error = np.abs(w[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(kept))).max()
    return Whitening(n, made.sums, made.axes, made.explained, float(error))


def whiten_rows(rows: DataFrame, id_col: str = "vec_id", col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    own = rows.where(is_whole(F.col(col))).select(F.col(id_col), grid(F.col(col)).alias("x"))
    fit, n = distinct_vectors(own)
    model = fit_whitening(fit, n, most) if n else None
    if model is None or not model.explained:
        return rows.sparkSession.createDataFrame([], schema)
    k, d = len(model.explained), len(model.sums)

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        x = vectors(b)
        size = len(x) * k
        columns = [
            b[id_col].take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, dtype=np.int64)),
            pa.array([v for v in model.deviation(x) for _ in range(k)], pa.int64()), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(size, model.identity_error)),
        ]
        return pa.RecordBatch.from_arrays(columns, [id_col, *names])

    return arrow_map(own.where(F.size("x") == d), apply, schema)
