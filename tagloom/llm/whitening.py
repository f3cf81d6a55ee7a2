"""Whitening of vectors by a compensated covariance.

Entries become whole numbers first: x = floor(1024 c) + 100000.  Large offsets
and small differences are what plain sums of squares lose digits on, so the
covariance is taken in two passes: exact sums give the mean to twice the double
precision; then the centred vectors' outer products are summed without error.
Each centred column is cut into slices of so few bits that the matrix product of
two slices over a block of rows is exact in doubles (an error-free
transformation of the product); the exact partial products are added to a high
and a low part by two-sums.  Tasks hand over high and low parts by matrix row,
which Spark merges in two steps.  The matrix, whose size depends on the length of
the vectors alone, is then solved by `numpy.linalg.eigh`, LAPACK's reduction to
tridiagonal form with divide and conquer.

Rows are left out whose vector is null, has a null or non-finite entry, or one
beyond LARGEST, or another length than most of the table's vectors (of equally
frequent lengths the longest counts).  A component's sign makes its largest entry
positive.  Components without variance have the projection 0, the share 0 and no
part in the identity's error.  Rows that repeat a vec_id are rows of their own.
deviation is null where it exceeds a long; deviation_decimal has it then, up to
38 digits.  Only the key and the vector are read, whatever else the table has;
an empty table, or one without vectors, gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, ship

#: Whole numbers are floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this don't become exact whole numbers.
LARGEST = float(1 << 40)
#: Rows of a block: slices of BITS bits have exact products over so many rows.
ROWS, BITS = 1024, 21
#: Partial matrices are merged in so many parts first.
PARTS = 32
#: Length of vectors beyond which the matrix doesn't go to one machine.
MOST_DIMENSIONS = 4096


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a double and what it misses, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) + (a, b)."""
    s, e = two_sum(high, a)
    return two_sum(s, e + (low + b))


def slices_of(d: np.ndarray) -> list[np.ndarray]:
    """Matrices that sum to d exactly, each column's entries multiples of one power of two and of at most BITS bits."""
    out, rest = [], d
    while rest.any():
        top = np.abs(rest).max(axis=0)
        unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - BITS)
        part = np.rint(rest / unit) * unit
        out.append(part)
        rest = rest - part
    return out


class Outer:
    """Sum of outer products of centred rows, high and low parts."""

    def __init__(self, dims: int):
        self.high, self.low = np.zeros((dims, dims)), np.zeros((dims, dims))

    def add(self, d: np.ndarray, e: np.ndarray) -> None:
        """Rows d + e, e being what doubles d miss."""
        parts = slices_of(d)
        cross = d.T @ e
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                p = a.T @ b  # exact
                self.high, self.low = add(self.high, self.low, p)
                if i != j:
                    self.high, self.low = add(self.high, self.low, p.T)
        self.high, self.low = add(self.high, self.low, cross + cross.T + e.T @ e)


@dataclass
class Mean:
    """Rows, exact sums of each dimension, and the mean as high and low part."""

    n: int
    sums: list[int]

    def __post_init__(self):
        exact = [Fraction(s, self.n) for s in self.sums]
        self.high = np.array([float(x) for x in exact])
        self.low = np.array([float(x - Fraction(h)) for x, h in zip(exact, self.high.tolist(), strict=True)])

    @property
    def dims(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, e = two_sum(x.astype(np.float64), -self.high)
        return two_sum(d, e - self.low)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)**2 of every row, exactly."""
        # both sides of n x - S have the common part n c taken off, c a whole number near the mean
        c = [s // self.n for s in self.sums]
        small = x - np.array(c, np.int64)
        rest = [s - self.n * k for s, k in zip(self.sums, c, strict=True)]  # 0 <= rest < n
        # sum (n y - r)**2 = n**2 sum y**2 - 2 n sum y r + sum r**2
        most = int(np.abs(small).max(initial=0))
        if self.dims * max(most, 1) ** 2 < 2**62 and self.dims * max(most, 1) * self.n < 2**62:
            squares = (small * small).sum(axis=1).tolist()
            cross = (small * np.array(rest, np.int64)).sum(axis=1).tolist()
        else:
            squares = [sum(v * v for v in row) for row in small.tolist()]
            cross = [sum(v * r for v, r in zip(row, rest, strict=True)) for row in small.tolist()]
        const, n = sum(r * r for r in rest), self.n
        return [n * n * q - 2 * n * k + const for q, k in zip(squares, cross, strict=True)]


def _whole(batch: pa.RecordBatch, dims: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows of a batch that count, and of each length (row places, x)."""
    column = batch.column("vector").cast(pa.large_list(pa.float64()))
    ok = ~np.asarray(column.is_null())
    offsets = np.asarray(column.offsets)
    sizes = np.diff(offsets)
    flat = column.values
    bad = np.asarray(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(len(flat), bool)
    entries = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        bad = bad | ~(np.abs(entries) <= LARGEST)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    ok &= wrong[offsets[1:]] == wrong[offsets[:-1]]
    found = []
    for size in [dims] if dims is not None else np.unique(sizes[ok]).tolist():
        rows = np.flatnonzero(ok & (sizes == size))
        if size and len(rows):
            x = entries[offsets[rows][:, None] + np.arange(size)]
            found.append((rows, np.floor(x * SCALE).astype(np.int64) + OFFSET))
    return ok, found


def fitted_mean(vectors: DataFrame) -> Mean | None:
    """Of the column `vector`; None without a vector."""

    def sums(batches):
        for batch in batches:
            for rows, x in _whole(batch)[1]:
                size = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([len(rows)] * size, pa.int64()), pa.array(x.sum(axis=0))], names=["dims", "dim", "n", "s"])

    parts = map_batches(vectors, sums, "dims int, dim int, n bigint, s bigint")
    found = parts.groupBy("dims", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    most = found.where("dim = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not most:
        return None
    if (dims := most[0]["dims"]) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries; at most {MOST_DIMENSIONS} are handled")
    rows = sorted(found.where(F.col("dims") == dims).collect(), key=lambda r: r["dim"])
    return Mean(rows[0]["n"], [int(r["s"]) for r in rows])


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum of high and low parts, in the order of the parts."""
    rows = rows.sort_values("part")
    high, low = np.zeros(len(rows["high"].iloc[0])), np.zeros(len(rows["high"].iloc[0]))
    for a, b in zip(rows["high"], rows["low"], strict=True):
        high, low = add(high, low, np.asarray(a), np.asarray(b))
    return high, low


def covariance(vectors: DataFrame, mean: Mean) -> tuple[np.ndarray, np.ndarray]:
    """High and low part of the covariance (divisor n) of the vectors' whole numbers."""

    def outer(batches):
        total = Outer(mean.dims)
        for batch in batches:
            for _, x in _whole(batch, mean.dims)[1]:
                for start in range(0, len(x), ROWS):
                    total.add(*mean.centred(x[start : start + ROWS]))
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        if total.high.any() or total.low.any():
            rows = lambda m: pa.array(list(m), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(mean.dims), pa.int32()), pa.array([part] * mean.dims, pa.int32()), rows(total.high), rows(total.low)], names=["row", "part", "high", "low"])

    def merge(key, rows):
        high, low = _merged(rows)
        return pd.DataFrame({"row": [key[0]], "part": [key[1] if len(key) > 1 else 0], "high": [high], "low": [low]})

    schema = "row int, part int, high array<double>, low array<double>"
    parts = map_batches(vectors, outer, schema)
    some = parts.groupBy("row", (F.col("part") % PARTS).alias("some")).applyInPandas(merge, schema)
    whole = some.groupBy("row").applyInPandas(merge, schema)
    high, low = np.zeros((mean.dims, mean.dims)), np.zeros((mean.dims, mean.dims))
    for r in whole.select("row", "high", "low").collect():
        high[r["row"]], low[r["row"]] = r["high"], r["low"]
    return _divided(high, low, float(mean.n))


def _divided(high: np.ndarray, low: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """(high + low) / n; the remainder of the first quotient is found without error from halves of both factors."""
    q = high / n
    halves = lambda v: ((c := v * 134217729.0) - (c - v), v - (c - (c - v)))
    (qa, qb), (na, nb) = halves(q), halves(n)
    p = q * n
    missed = ((qa * na - p) + qa * nb + qb * na) + qb * nb
    return two_sum(q, ((high - p) - missed + low) / n)


@dataclass
class Whitening:
    """The mean, the first components (columns) with their variances, and the trace of the covariance."""

    mean: Mean
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        d, e = self.mean.centred(x)
        deviation = np.sqrt(np.where(self.variances > 0, self.variances, 1.0))
        return np.where(self.variances > 0, (d @ self.vectors + e @ self.vectors) / deviation, 0.0)


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """On the column `vector`; None without a vector."""
    mean = fitted_mean(vectors)
    if mean is None:
        return None
    high, low = covariance(vectors, mean)
    values, basis = np.linalg.eigh(high)
    order = np.argsort(-values, kind="stable")[:components]
    basis = basis[:, order]
    basis = basis * np.where(np.take_along_axis(basis, np.abs(basis).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    variances = np.einsum("ik,ik->k", basis, high @ basis) + np.einsum("ik,ik->k", basis, low @ basis)
    nothing = mean.dims * np.finfo(float).eps * max(float(values.max()), 0.0)
    return Whitening(mean, basis, np.where(variances > nothing, variances, 0.0), float(np.trace(high) + np.trace(low)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over the components with variance."""
    k = len(model.variances)

    def products(batches):
        for batch in batches:
            for _, x in _whole(batch, model.mean.dims)[1]:
                w = model.project(x)
                a, b = np.indices((k, k))
                yield pa.RecordBatch.from_arrays([pa.array(a.ravel(), pa.int32()), pa.array(b.ravel(), pa.int32()), pa.array((w.T @ w).ravel()), pa.array(np.repeat(w.sum(axis=0), k))], names=["a", "b", "p", "s"])

    found = map_batches(vectors, products, "a int, b int, p double, s double").groupBy("a", "b").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).collect()
    n = model.mean.n
    means = {r["a"]: r["s"] / n for r in found}
    alive = model.variances > 0
    return max((abs(r["p"] / n - means[r["a"]] * means[r["b"]] - (r["a"] == r["b"])) for r in found if alive[r["a"]] and alive[r["b"]]), default=0.0)


def whiten(rows: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """For each vector and component: key, component (from 1), n, deviation, deviation_decimal, whitened, explained, identity_error."""
    spark = rows.sparkSession
    ship(spark)
    vectors = rows.select(F.col(column).alias("vector"))
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n bigint, deviation bigint, deviation_decimal decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(vectors, components)
    if model is None:
        return spark.createDataFrame([], schema)
    error, k, n = identity_error(vectors, model), len(model.variances), model.mean.n
    explained = model.variances / model.trace if model.trace > 0 else np.zeros(k)

    def projected(batches):
        for batch in batches:
            for places, x in _whole(batch, model.mean.dims)[1]:
                m = len(places)
                each, exact = np.repeat(np.arange(m), k), model.mean.deviations(x)
                columns = [
                    batch.column("key").take(pa.array(np.repeat(places, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array([v if v < 2**63 else None for v in exact], pa.int64()).take(pa.array(each)),
                    pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(model.project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "deviation_decimal", "whitened", "explained", "identity_error"])

    return map_batches(rows.select(F.col(key).alias("key"), F.col(column).alias("vector")), projected, schema)
