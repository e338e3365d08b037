"""Whitening of embeddings: a compensated covariance in double-double, and projections on its leading eigenvectors.

Entries become integers x = floor(64 c) + 1000000. Sums are exact: tasks add high and low halves of 32 bits, and Spark adds
those as decimals. With the exact mean as a double-double number, tasks centre the vectors, multiply them without error
(Dekker's product) and add the products by error-free sums. High and low parts are merged over tasks in two shuffles, a
matrix row at a time. numpy's eigh solves the small matrix: a reduction to tridiagonal form, then divide and conquer.

Rows whose vector is null, or has null or non-finite entries, are left out; so are empty vectors, and those of another
length than most (of equally common lengths, the longest counts). Entries beyond 2^62 / 64 are clipped to that. Null ids,
repeated ids and repeated rows are rows like others. A component without variance (an eigenvalue of no more than rounding
errors) has null whitened values, and explained is null if nothing varies. An empty table gives no rows. Columns other than
the two named aren't read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Products of pairs of dimensions that a task holds at once.
BLOCK = 1 << 17
#: Partial sums of tasks that are merged by one group of the first of two shuffles: about the square root of their number.
MERGED = 64
_LOW = (1 << 32) - 1

Pair = tuple[np.ndarray, np.ndarray]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id: long, vec: array of double) of the rows whose vector is there and has finite entries only."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("vec").isNotNull() & F.forall("vec", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))  # NaN is larger


def quantised(rows: DataFrame, scale: int, shift: int = 0) -> DataFrame:
    """rows of usable() with vec as integers floor(scale * c) + shift, clipped to 2^62."""
    top = float(1 << 62)
    return rows.withColumn("vec", F.transform("vec", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(top)), F.lit(-top))) + shift))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long, whole rows as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# --- double-double numbers: (high, low) pairs of arrays

def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def dd_add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    h = s + e
    return h, e - (h - s)


def _split(a: np.ndarray) -> Pair:
    """Halves of a's 53 bits, by Veltkamp's constant."""
    t = a * 134_217_729.0
    high = t - (t - a)
    return high, a - high


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """Integers less a mean."""
    high = x.astype(np.float64)
    low = (x - high.astype(np.int64)).astype(np.float64)
    s, e = two_sum(high, -mean[0])
    e = e + (low - mean[1])
    h = s + e
    return h, e - (h - s)


def dd_total(a: Pair) -> Pair:
    """The sum over rows, by halves."""
    while len(a[0]) > 1:
        k = len(a[0]) // 2
        rest = tuple(p[2 * k :] for p in a)
        a = tuple(np.concatenate(p) for p in zip(dd_add(tuple(p[:k] for p in a), tuple(p[k : 2 * k] for p in a)), rest))
    return a[0][0], a[1][0]


def products(c: Pair) -> Pair:
    """The sum over rows of the products of their pairs of dimensions i <= j, in the order of np.triu_indices."""
    d = c[0].shape[1]
    i, j = np.triu_indices(d)
    total = (np.zeros(len(i)), np.zeros(len(i)))
    step = max(1, BLOCK // max(1, len(i)))
    for lo in range(0, len(c[0]), step):
        h, w = c[0][lo : lo + step], c[1][lo : lo + step]
        a, b = _split(h)
        p = h[:, i] * h[:, j]
        e = ((a[:, i] * a[:, j] - p) + a[:, i] * b[:, j] + b[:, i] * a[:, j]) + b[:, i] * b[:, j]
        e += h[:, i] * w[:, j] + w[:, i] * h[:, j]
        total = dd_add(total, dd_total((p + e, e - ((p + e) - p))))
    return total


# --- over all rows

def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, high, low): sums of x's halves."""
    n, high, low = 0, 0, 0
    for b in batches:
        if len(b):
            x = matrix(b.column(1))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & _LOW).sum(axis=0)
    if n:
        dims = pa.array(range(len(high)), pa.int32())
        yield pa.RecordBatch.from_arrays([dims, pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])


def _merged(table: pa.Table) -> pa.Table:
    high, low = dd_total((matrix(table["high"].combine_chunks()), matrix(table["low"].combine_chunks())))
    return pa.table({"row": table["row"][:1], "part": table["part"][:1], "high": pa.array([high]), "low": pa.array([low])})


_PARTS = "row int, part int, high array<double>, low array<double>"


def second_moments(rows: DataFrame, centre: Callable[[np.ndarray], Pair], d: int) -> np.ndarray:
    """The d x d sums over rows of the products of what centre makes of a batch's vectors, as doubles with a low part (2, d, d)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                own = products(centre(matrix(b.column(1))))
                total = dd_add(total, own) if total else own
        if total:
            ends = np.cumsum(np.arange(d, 0, -1))[:-1]
            high, low = (pa.array(np.split(p, ends), pa.list_(pa.float64())) for p in total)
            part = pa.array(np.full(d, TaskContext.get().partitionId(), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), part, high, low], ["row", "part", "high", "low"])

    parts = rows.mapInArrow(task, _PARTS).withColumn("part", F.pmod("part", F.lit(MERGED)).cast("int"))
    parts = parts.groupBy("row", "part").applyInArrow(_merged, _PARTS).groupBy("row").applyInArrow(_merged, _PARTS)
    out = np.zeros((2, d, d))
    for r in parts.toLocalIterator():  # d rows
        for k, values in enumerate((r["high"], r["low"])):
            out[k, r["row"], r["row"] :] = out[k, r["row"] :, r["row"]] = values
    return out


@dataclass
class Whitening:
    """n vectors' exact sums, mean, the covariance, its trace, and its leading eigenvalues with eigenvectors as columns."""

    n: int
    sums: list[int]
    mean: Pair
    covariance: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x's rows on the components; NaN where a component has no variance."""
        high, low = centred(x, self.mean)
        at = high @ self.vectors + low @ self.vectors
        return np.where(self.varies(), at / np.sqrt(np.where(self.varies(), self.values, 1.0)), np.nan)

    def varies(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n x - sum)^2, exact; null beyond 38 digits."""
        near = self.n * x.astype(np.float64) - np.array([float(s) for s in self.sums])
        kind = pa.decimal128(38, 0)
        if self.n * float(np.abs(x).max()) < 2.0**62 and float((near**2).sum(axis=1).max()) < 2.0**61:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)).cast(kind)
        whole = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return pa.array([v if v < 10**38 else None for v in whole], kind)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows that count, as the integers x."""
    rows = usable(df, id_col, vec_col).filter(F.size("vec") > 0)
    most = rows.groupBy(F.size("vec").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()["d"]
    return quantised(rows.filter(F.size("vec") == (most or 0)), SCALE, SHIFT)


def fit_whitening(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of integer_vectors(); None of none. The driver gets a number for each pair of dimensions, no rows."""
    sums = vectors.mapInArrow(_task_sums, "dim int, n long, high long, low long").groupBy("dim")
    sums = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]).collect()  # a row a dimension
    if not sums:
        return None
    n, d = sums[0]["n"], len(sums)
    exact = [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(sums, key=lambda r: r["dim"])]
    high = np.array([float(Fraction(s, n)) for s in exact])
    mean = (high, np.array([float(Fraction(s, n) - Fraction(float(h))) for s, h in zip(exact, high)]))
    total = second_moments(vectors, lambda x: centred(x, mean), d)
    covariance = (total[0] + total[1]) / n
    values, q = np.linalg.eigh(covariance)
    top = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, exact, mean, covariance, float(np.trace(covariance)), values[top], q[:, top])


def identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, over components with variance; None without any."""
    own = w.varies()
    if not own.any():
        return None

    def centre(x: np.ndarray) -> Pair:
        at = w.whitened(x)[:, own]
        return at, np.zeros_like(at)

    total = second_moments(vectors, centre, int(own.sum()))
    return float(np.abs((total[0] + total[1]) / w.n - np.eye(int(own.sum()))).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """(id_col, component from 1, n, deviation: decimal, whitened, explained, identity_error): a row for each vector and component."""
    shape = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    vectors = integer_vectors(df, id_col, vec_col)
    w = fit_whitening(vectors, components)
    if w is None:
        return df.sparkSession.createDataFrame([], shape).withColumnRenamed("id", id_col)
    error = identity_error(vectors, w)
    explained = w.values / w.trace if w.trace > 0 else np.full(len(w.values), np.nan)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            of = lambda v: pa.array(np.tile(v, len(x)), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(each), of(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(len(each), w.n)), w.deviation(x).take(each),
                    pa.array(w.whitened(x).ravel(), from_pandas=True), of(explained), pa.array([error] * len(each), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(rows, shape).withColumnRenamed("id", id_col)
