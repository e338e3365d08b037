"""Centroid clustering of integer vectors, with Hamerly's bounds.

Components become integers floor(256 c). The first centroids are the k vectors with the smallest hashes. Every vector keeps
its centroid, an upper bound of the distance to it and a lower bound of that to any other one. After each round the bounds
are loosened by how far centroids moved; only vectors whose bounds meet are scanned in full, in exact integers. The state
is saved each round, and sums of a cluster's vectors are aggregated in tasks before they are shuffled.

Rows whose vector is null, has another number of components than dims, or null or non-finite entries, are left out.
Components beyond 2^62 are clipped to that. Null ids hash last. Repeated rows are vectors like others, and may be several
of the first centroids; rows with one id and different vectors are taken in the order of their vectors. Fewer vectors than
k are as many centroids; no vectors, no rows. Sums of distances that aren't longs are null. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.whitening import matrix, quantised, usable
from cairn.operators.tables import saved

#: Vectors that a task compares with all centroids at once.
BLOCK = 8192
#: Bounds are floating-point numbers: they count only if they are apart by more than this part of them.
SLACK = 1e-9
_LONG = (1 << 63) - 1


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c: products in doubles where they are exact, else Python integers."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2.0**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def to_own(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to c[own]."""
    top = max(float(np.abs(x).max(initial=0)), float(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 2.0**62:
        return ((x - c[own]) ** 2).sum(axis=1)
    return ((x.astype(object) - c.astype(object)[own]) ** 2).sum(axis=1)


def _roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number of equally near ones; its distance; the distance of the next one)."""
    d2 = squared(x, c)
    own = np.array(d2.argmin(axis=1), np.int32)
    at = np.arange(len(x))
    first = _roots(d2[at, own])
    if len(c) == 1:
        return own, first, np.full(len(x), np.inf)
    d2[at, own] = d2.max() + 1
    return own, first, _roots(d2.min(axis=1))


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower, which vectors were scanned in full) after the centroids became c, each by its drift."""
    own, upper, lower = own.copy(), upper + drift[own], lower - drift.max(initial=0.0)
    gaps = squared(c, c)
    gaps[np.arange(len(c)), np.arange(len(c))] = gaps.max() + 1
    half = _roots(gaps.min(axis=1)) / 2 if len(c) > 1 else np.full(len(c), np.inf)
    safe = np.maximum(lower, half[own])

    def unsure(rows: np.ndarray) -> np.ndarray:
        return rows[~(upper[rows] * (1 + SLACK) + SLACK < safe[rows])]

    left = unsure(np.arange(len(x)))
    upper[left] = _roots(to_own(x[left], c, own[left]))  # tightened first
    left = unsure(left)
    if len(left):
        own[left], upper[left], lower[left] = nearest(x[left], c)
    scanned = np.zeros(len(x), bool)
    scanned[left] = True
    return own, upper, lower, scanned


_STATE = "id long, vec array<long>, cluster int, upper double, lower double, scanned boolean"


def _stepped(state: DataFrame, c: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The state after an assignment; drift: None at first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), BLOCK):
                part = b.slice(lo, BLOCK)
                x = matrix(part.column(1))
                if drift is None:
                    own, upper, lower = nearest(x, c)
                    scanned = np.ones(len(x), bool)
                else:
                    before = [part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4)]
                    own, upper, lower, scanned = reassigned(x, *before, c, drift)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own), pa.array(upper), pa.array(lower), pa.array(scanned)], ["id", "vec", "cluster", "upper", "lower", "scanned"])

    return saved(state.mapInArrow(task, _STATE))


def _moved(state: DataFrame, c: np.ndarray, wide: bool) -> np.ndarray:
    """Centroids as the floors of their vectors' means; those without vectors stay. A row a centroid comes to the driver."""
    part = lambda i: F.get("vec", F.lit(i)).cast("decimal(19,0)") if wide else F.get("vec", F.lit(i))
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(part(i)).alias(f"s{i}") for i in range(c.shape[1])])
    new = c.copy()
    for r in sums.collect():
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(c.shape[1])]
    return new


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:id, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "vec").orderBy(F.col("name").asc_nulls_last(), "vec").limit(k).collect()  # k rows
    return np.array([r["vec"] for r in rows], np.int64)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, vec, cluster, upper, lower, scanned) of every vector, the final centroids).

    scanned tells which vectors' bounds met in the last assignment.
    """
    vectors = quantised(usable(df, id_col, vec_col).filter(F.size("vec") == dims), scale)
    c = first_centroids(vectors, k, seed)
    if not len(c):
        return df.sparkSession.createDataFrame([], _STATE), c
    state = _stepped(vectors, c, None)
    n, top = state.agg(F.count("*"), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    wide = n * top > _LONG  # sums that are no longs are added as decimals
    for _ in range(rounds):
        new = _moved(state, c, wide)
        drift = np.array([float(sum((int(a) - int(b)) ** 2 for a, b in zip(p, q))) ** 0.5 for p, q in zip(c, new)]) * (1 + SLACK)
        c, state = new, _stepped(state, new, drift)
    return state, c


def cluster_report(df: DataFrame, **options) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector; options as cluster()'s."""
    spark, id_col = df.sparkSession, options.get("id_col", "vec_id")
    state, c = cluster(df, **options)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d2 = to_own(matrix(b.column(1)), c, b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v if v <= _LONG else None for v in d2.tolist()], pa.int64())], ["id", "cluster", "distance"])

    far = state.mapInArrow(task, "id long, cluster int, distance long")
    hashes = [(i, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for i, row in enumerate(c)]
    sums = saved(far.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("own")))  # a row a centroid
    total = sums.agg(F.sum("own")).first()[0]
    named = sums.join(F.broadcast(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")), "cluster")
    named = named.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.lit(int(total) if total is not None and total <= _LONG else None).cast("long").alias("inertia"), "centroid_sha256")
    return far.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
