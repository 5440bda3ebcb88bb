"""Whitening of embeddings by an exact covariance: products of digit slices.

Vectors are scaled to whole numbers. With n distinct vectors x (the fit list) and their sums S, y = n x - S is centred and
whole. y is split into limbs of LIMB bits; the product of two limb matrices of CHUNK rows at most is exact in doubles, so BLAS
multiplies them, and the products are put together as Python's whole numbers, shift by shift. Each task so has its exact part of the sum of
y yᵀ; parts are cut into 32-bit digits and added by Spark. The covariance, that sum over n³, is rounded once, then decomposed.

What reaches the driver is a few numbers for each pair of dimensions, however many rows there are. The fit list is found by one
shuffle of the vectors (distinct) and written to the shared folder, as it is read three times: sums, products, and the covariance of the result.

Results in the odd cases. Rows whose vector is null or holds null or non-finite entries are dropped, as are those with an entry outside of a bigint after scaling. Missing entries of
shorter vectors are 0. With fewer dimensions than components there are as many components as dimensions; empty vectors have none, so no rows. A component without variance
(an eigenvalue of at most 1e-12 of the largest, as with one distinct vector) has a null whitened value and no part in identity_error; explained is null if all variance is 0.
Repeated rows each return their rows; a null id stays null. deviation is null beyond a bigint; deviation_digits has it whole. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateloom.llm.common import stored

#: Two limbs' product has 2 * LIMB bits, and CHUNK of them add 13 more: 53 in all, what a double holds.
LIMB, CHUNK = 20, 8192
#: An eigenvalue below this share of the largest counts as none.
FLAT = 1e-12


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """id (of its own type), x array<bigint>: floor(scale * c) of each entry c as double."""
    x = F.transform(F.col(vector_column).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    fits = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (c >= F.lit(-(2.0**63))) & (c < F.lit(2.0**63))), F.lit(False))
    return table.select(F.col(id_column).alias("id"), x.alias("x")).filter(fits).withColumn("x", F.transform("x", lambda c: F.floor(c)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of bigints as rows, filled with zeros to dims."""
    flat, length = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(length), dims), np.int64)
    out[np.arange(dims) < length[:, None]] = flat
    return out


def chunks(batches: Iterable[pa.RecordBatch], rows: int = CHUNK) -> Iterable[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, whole: in 64 bits where they suffice, else as Python's whole numbers."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def limbs(y: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """Matrices of doubles whose sum, the i-th shifted left by i * bits, is y; entries have bits bits at most, the last one's a sign besides."""
    out, mask = [], (1 << bits) - 1
    while True:
        if int(y.max(initial=0)) < 1 << bits and int(y.min(initial=0)) >= -(1 << bits):
            return [*out, y.astype(np.float64)]
        out.append((y & mask).astype(np.float64))
        y = y >> bits


def product(y: np.ndarray, bits: int = LIMB) -> np.ndarray:
    """yᵀ y, exact, of CHUNK rows at most: a matrix of Python's whole numbers."""
    parts = limbs(y, bits)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            p = (a.T @ parts[j]).astype(np.int64).astype(object)
            total += (p if i == j else p + p.T) << (bits * (i + j))
    return total


def digits(value: int) -> list[int]:
    """value in base 2**32, lowest first; the last digit has the sign."""
    out = []
    while not -(2**31) <= value < 2**31:
        out.append(value & 0xFFFFFFFF)
        value >>= 32
    return [*out, value]


@dataclass
class Whitening:
    """dims, n, sums (S) of the fit list; values and vectors (columns) of its covariance, falling."""

    dims: int
    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def kept(self, components: int) -> int:
        return min(components, self.dims)

    def flat(self, component: int) -> bool:
        """Whether a component (from 0) has no variance."""
        return not self.values[component] > FLAT * max(self.values[0], 0)

    def whitened(self, y: np.ndarray, components: int) -> np.ndarray:
        """Of centred rows, by component; NaN where there is no variance."""
        k = self.kept(components)
        scale = [math.nan if self.flat(c) else 1 / math.sqrt(self.values[c]) for c in range(k)]
        return (y.astype(np.float64) / self.n) @ self.vectors[:, :k] * np.array(scale)


def summed(fit: DataFrame, dims: int, of_chunk, cells: int) -> list[int]:
    """The exact sums over all rows of what of_chunk makes of a matrix: cells whole numbers each. Digits are added by Spark."""

    def part(batches):
        total = np.zeros(cells, object)
        for b in chunks(batches):
            total += of_chunk(matrix(b.column("x"), dims))
        rows = [(c, i, d) for c, v in enumerate(total.tolist()) for i, d in enumerate(digits(int(v)))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], names=["cell", "digit", "value"])

    out = [0] * cells
    for r in fit.select("x").mapInArrow(part, "cell int, digit int, value bigint").groupBy("cell", "digit").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] += r["value"] << (32 * r["digit"])
    return out


def fitted(fit: DataFrame) -> Whitening | None:
    """The whitening of a fit list (x: distinct vectors); None if it has no rows or no dimensions."""
    n, dims = fit.agg(F.count("x"), F.max(F.size("x"))).first()
    if not n or not dims:
        return None
    sums = summed(fit, dims, lambda x: x.astype(object).sum(axis=0) if len(x) and int(np.abs(x.astype(float)).max()) >= 2**49 else x.sum(axis=0).astype(object), dims)
    upper = np.triu_indices(dims)
    cells = summed(fit, dims, lambda x: product(centred(x, n, sums))[upper], len(upper[0]))
    covariance = np.zeros((dims, dims))
    covariance[upper] = [c / n**3 for c in cells]  # whole by whole: rounded once
    covariance.T[upper] = covariance[upper]
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(dims, n, sums, covariance, values[::-1].copy(), vectors[:, ::-1].copy())


def identity_error(fit: DataFrame, w: Whitening, components: int) -> float | None:
    """The largest entry of the whitened fit list's covariance minus the identity, measured over all its rows."""
    some = [c for c in range(w.kept(components)) if not w.flat(c)]
    if not some:
        return None

    def rows(batches):
        for b in chunks(batches):
            z = w.whitened(centred(matrix(b.column("x"), w.dims), w.n, w.sums), components)
            yield pa.RecordBatch.from_arrays([pa.array(z[:, c]) for c in some], names=[f"w{c}" for c in some])

    pairs = [(a, b) for i, a in enumerate(some) for b in some[i:]]
    found = fit.select("x").mapInArrow(rows, ", ".join(f"w{c} double" for c in some)).agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def whitened(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits: a row for each row of table that isn't dropped and each component."""
    vectors = whole_vectors(table, id_column, vector_column, scale)
    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"
    # vectors that differ by zeros at their end are one
    longest = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(longest - 1, 0))), lambda i: F.coalesce(F.get("x", i), F.lit(0).cast("bigint")))
    fit = stored(vectors.select((filled if longest else F.col("x")).alias("x")).distinct(), "fit-list")
    w = fitted(fit)
    if w is None:
        return table.sparkSession.createDataFrame([], schema)
    error, trace, k = identity_error(fit, w, components), float(np.trace(w.covariance)), w.kept(components)
    explained = [float(w.values[c]) / trace if trace > 0 else None for c in range(k)]

    def rows(batches):
        for b in chunks(batches):
            m = b.num_rows
            y = centred(matrix(b.column("x"), w.dims), w.n, w.sums)
            z = w.whitened(y, components).reshape(-1)
            whole = y if y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * w.dims >= 2**62 else None
            deviation = (y * y).sum(axis=1).tolist() if whole is None else [sum(int(v) * int(v) for v in r) for r in y.tolist()]
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n), pa.int64()),
                pa.array([d if d < 2**63 else None for d in deviation for _ in range(k)], pa.int64()), pa.array(z, mask=np.isnan(z)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                pa.array([str(d) for d in deviation for _ in range(k)]),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"])

    return vectors.mapInArrow(rows, schema)
