"""Whitening of embeddings with covariances recovered by polarisation.

Entries become integers, so all sums are exact. Over the distinct vectors the squares of
the centred value of every dimension, and of the centred sum of every pair of
dimensions, are added up; half of what the square of a sum exceeds its parts by is the
covariance of the pair. The matrix of these goes through ``eigh``; its size is that of
the vector, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.support import settle, vector_sum

SCALE = 256
COMPONENTS = 4
#: products of two limbs over ROWS rows stay below 2**63
LIMB, ROWS = 25, 1 << 12
FIELDS = "deviation: long, whitened: array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry); beyond the range of a long, its end."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, size)


def square_sums(z: np.ndarray, bits: int) -> np.ndarray:
    """Exact sums of squares by column, as Python integers; ``bits`` bounds the entries."""
    if z.dtype == object:
        return (z * z).sum(axis=0) if len(z) else np.zeros(z.shape[1], object)
    parts, rest = [], z
    for _ in range(bits // LIMB):
        parts.append(rest & ((1 << LIMB) - 1))
        rest = rest >> LIMB
    parts.append(rest)
    total = np.zeros(z.shape[1], object)
    for a, left in enumerate(parts):
        for b in range(a, len(parts)):
            total += np.einsum("ij,ij->j", left, parts[b]).astype(object) * ((1 if a == b else 2) << LIMB * (a + b))
    return total


@dataclass
class Whitener:
    """Means and components of a fit list; numbers of the list are exact integers."""

    size: int
    n: int
    sums: list[int]
    top: int
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float | None] = field(default_factory=list)
    identity_error: float | None = None

    @property
    def bits(self) -> int:
        """Bits of a centred entry times n, sign apart."""
        return (self.n * self.top + max(map(abs, self.sums), default=0)).bit_length()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python integers where longs would not hold the sum of two."""
        kind = np.int64 if self.bits < 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of squares by row; null where a long does not hold it."""
        if 2 * self.bits + self.size.bit_length() < 63:
            return np.einsum("ij,ij->i", y, y).tolist()
        y = y.astype(object)
        return [x if x < 1 << 63 else None for x in (y * y).sum(axis=1).tolist()]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened entries by row; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((y / self.n).astype(float) @ self.axes) / np.sqrt(np.where(self.values > 0, self.values, np.nan))


def _sums(fit: DataFrame, size: int) -> list[int]:
    """Exact sums of each dimension, added up in three limbs of a long."""
    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((3, size), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for k, part in enumerate((x & 0xFFFFFF, x >> 24 & 0xFFFFFF, x >> 48)):
                total[k] += part.sum(axis=0)
        return total.ravel()

    low, middle, high = vector_sum(fit, fold, 3 * size, "<i8").reshape(3, size).tolist()
    return [a + (b << 24) + (c << 48) for a, b, c in zip(low, middle, high)]


def _squares(fit: DataFrame, model: Whitener) -> list[int]:
    """Exact sums of squares of every centred dimension, then of every sum of two of them."""
    size, n_sums = model.size, model.size * (model.size + 1) // 2
    bits = model.bits + 1
    limbs = (2 * bits + model.n.bit_length()) // 32 + 1

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(n_sums, object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for begin in range(0, len(x), ROWS):
                y = model.centred(x[begin: begin + ROWS])
                total[:size] += square_sums(y, bits)
                at = size
                for i in range(size - 1):
                    total[at: at + size - 1 - i] += square_sums(y[:, i + 1:] + y[:, i: i + 1], bits)
                    at += size - 1 - i
        return np.array([[int(x) >> 32 * k & 0xFFFFFFFF for k in range(limbs)] for x in total], np.int64).ravel()

    parts = vector_sum(fit, fold, n_sums * limbs, "<i8").reshape(n_sums, limbs).tolist()
    return [sum(x << 32 * k for k, x in enumerate(row)) for row in parts]


def covariances(squares: list[int], size: int, n: int) -> tuple[np.ndarray, float]:
    """Covariance matrix and its trace; each entry is one exact quotient, rounded once."""
    matrix, at, cube = np.zeros((size, size)), size, n**3
    for i in range(size):
        matrix[i, i] = squares[i] / cube
        for j in range(i + 1, size):
            matrix[i, j] = matrix[j, i] = (squares[at] - squares[i] - squares[j]) / (2 * cube)
            at += 1
    return matrix, sum(squares[:size]) / cube


def fit_whitener(frame: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitener:
    """Fit on each distinct scaled vector once; see ``whiten`` for the cases."""
    rows = frame.where(usable(F.col(column))).select(whole_numbers(F.col(column), scale).alias("x"))
    fit = settle(rows.where("size(x) > 0").distinct(), "vectors")
    shape = fit.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least"))
    best = shape.orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return Whitener(0, 0, [], 0)
    fit = fit.where(F.size("x") == best.size)
    model = Whitener(best["size"], best.n, _sums(fit, best["size"]), max(best.most, -best.least))
    matrix, trace = covariances(_squares(fit, model), model.size, model.n)
    values, axes = np.linalg.eigh(matrix)
    keep = min(components, model.size)
    model.values, model.axes = values[::-1][:keep].copy(), np.ascontiguousarray(axes[:, ::-1][:, :keep])
    # rounding alone leaves about this much where there is no variance
    model.values[model.values <= model.size * np.finfo(float).eps * max(trace, 0)] = 0
    model.explained = [float(x) / trace if trace > 0 else None for x in model.values]
    model.identity_error = _identity_error(fit, model)
    return model


def _identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """Largest entry by which the covariance of the whitened fit list differs from the identity, over components with variance."""
    live = np.flatnonzero(model.values > 0)
    k = len(live)
    if not k:
        return None

    def fold(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = model.project(model.centred(_matrix(batch.column(0), model.size)))[:, live]
            total[:k] += w.sum(axis=0)
            total[k:] += (w.T @ w).ravel()
        return total

    total = vector_sum(fit, fold, k + k * k) / model.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(frame: DataFrame, model: Whitener, column: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, Column]:
    """The usable rows with one more column, and that column: a struct of deviation and whitened (one entry a component).

    Rows whose vector is null or holds null or non-finite entries are left out. The
    model has one length of vectors, that of most distinct ones (of equally many the
    longer); other vectors, and empty ones, are returned with no components and a null
    deviation. A component without variance (one distinct vector, or fewer dimensions
    that vary) has null entries. ``deviation`` is null where a long does not hold it.
    Repeated rows are returned each, an empty table gives no rows, other columns pass
    through whatever their names. The matrix of the fit has the square of the vector's
    length; that much comes to the driver.
    """
    state, scaled = "whitening", "scaled"
    while state in frame.columns:
        state = f"_{state}"
    while scaled in frame.columns:
        scaled = f"_{scaled}"
    out = frame.where(usable(F.col(column))).withColumn(state, F.lit(None).cast(f"struct<{FIELDS}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(scaled)
            whole, batch = batch.column(at), batch.remove_column(at)
            at = batch.schema.get_field_index(state)
            kind = batch.schema.field(at)
            fits = np.flatnonzero(whole.value_lengths().to_numpy(zero_copy_only=False) == model.size) if model.size else np.zeros(0, np.int64)
            found: list[dict] = [{"deviation": None, "whitened": []} for _ in range(batch.num_rows)]
            if len(fits):
                y = model.centred(_matrix(whole.take(pa.array(fits)), model.size))
                for row, far, near in zip(fits.tolist(), model.deviations(y), model.project(y).tolist()):
                    found[row] = {"deviation": far, "whitened": [None if math.isnan(w) else w for w in near]}
            yield batch.set_column(at, kind, pa.array(found, kind.type))

    return out.withColumn(scaled, whole_numbers(F.col(column), scale)).mapInArrow(run, out.schema), F.col(state)
