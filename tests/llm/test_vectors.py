"""Whitening and centroid clustering against exact plain versions."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from cairn.llm import centroids, whitening

SHAPE = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SHAPE).repartition(3)


def gaussian(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    return [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(scale * rng.normal(size=(n, d)) @ mix)]


def exact(rows, d):
    """(x-vectors, sums, exact covariance) with fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(r[i] for r in x) for i in range(d)]
    u = [[n * r[i] - s[i] for i in range(d)] for r in x]
    return x, s, np.array([[float(Fraction(sum(r[i] * r[j] for r in u), n**3)) for j in range(d)] for i in range(d)])


def test_whitening_equals_the_exact_one(spark):
    d, rows = 40, gaussian(130, 40, 1)
    x, s, v = exact(rows, d)
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 130 * 32 and {r.component for r in got} == set(range(1, 33))
    at = {(r.vec_id, r.component): r for r in got}
    n = len(rows)
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert {int(r.deviation) for r in got if r.vec_id == 5} == {sum((n * c - t) ** 2 for c, t in zip(x[5], s))} and {r.n for r in got} == {n}
    w = np.array([[at[i, k].whitened for k in range(1, 33)] for i in range(n)])
    u = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(r, s)] for r in x])
    assert np.abs(w.T @ w / n - np.eye(32)).max() < 1e-9
    # What is projected is an eigenvector: V q = e q, with q from the whitened values themselves.
    q = u.T @ w / n / np.sqrt(values[:32])
    assert np.abs(np.linalg.norm(q, axis=0) - 1).max() < 1e-9 and np.abs(v @ q - q * values[:32]).max() < 1e-8 * values[0]
    assert np.allclose([at[0, k].explained for k in range(1, 33)], values[:32] / np.trace(v), rtol=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


def test_covariance_is_compensated(spark):
    """Large offsets and a wide range of sizes: a plain sum of squares would lose the small dimension."""
    rng = random.Random(2)
    rows = [(i, [1e9 + rng.randint(-3, 3) * 1e3, rng.randint(-2, 2) / 64, rng.randint(-9, 9) * 1e6]) for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").repartition(5)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(r[i] for r in x) for i in range(3)]
    w = whitening.fit_whitening(whitening.integer_vectors(df))
    assert w.sums == s
    for i in range(3):
        for j in range(3):
            want = Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)
            assert w.covariance[i, j] == pytest.approx(float(want), rel=1e-15)


def test_double_double_sums_are_nearly_exact():
    rng = np.random.default_rng(3)
    c = rng.normal(size=(1000, 6)) * 10.0 ** rng.integers(-6, 7, size=(1000, 6))
    high, low = whitening.products((c, np.zeros_like(c)))
    for k, (i, j) in enumerate(zip(*np.triu_indices(6))):
        want = sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(c[:, i], c[:, j]))
        assert abs(Fraction(float(high[k])) + Fraction(float(low[k])) - want) <= abs(want) * Fraction(1, 2**85) + Fraction(1, 10**16)


def test_whitening_of_odd_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], SHAPE)).count() == 0
    odd = [(1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(None, [1.0, 5.0]), (8, [2.0, 3.0]), (8, [2.0, 3.0]), (9, [4.0, 4.0])]
    df = vectors(spark, odd + good)
    for c in ("id", "vec", "component", "n", "part", "whitened"):
        df = df.withColumn(c, df.label)
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or -1, r.component) for r in got) == [(-1, 1), (-1, 2), (8, 1), (8, 1), (8, 2), (8, 2), (9, 1), (9, 2)]
    assert whitening.whiten(vectors(spark, odd[:5])).count() == 0
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(4)])).collect()  # one component varies
    assert {r.component for r in line if r.whitened is None} == {2} and all(r.identity_error < 1e-9 for r in line)
    wide = whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert [abs(r.whitened) for r in wide] == [1.0, 1.0] and int(wide[0].deviation) == (2 << 62) ** 2


def lloyd(rows, k, rounds, dims, scale, seed):
    x = {i: [math.floor(scale * float(np.float32(c))) for c in v] for i, v in rows}
    first = sorted(x, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    c = [x[i] for i in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for r in range(rounds + 1):
        own = {i: min(range(len(c)), key=lambda j: (far(v, c[j]), j)) for i, v in x.items()}
        if r < rounds:
            of = [[x[i] for i in x if own[i] == j] for j in range(len(c))]
            c = [[sum(v[t] for v in m) // len(m) for t in range(dims)] if m else c[j] for j, m in enumerate(of)]
    d = {i: far(x[i], c[own[i]]) for i in x}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return {i: (own[i], d[i], sum(d[j] for j in x if own[j] == own[i]), sum(d.values()), sha[own[i]]) for i in x}


@pytest.mark.parametrize("k,scale,size", [(7, 256, 0.2), (12, 256, 40.0), (5, 1, 0.6), (4, 256, 1e9), (30, 256, 0.2)])
def test_clusters_equal_plain_rounds(spark, k, scale, size):
    rows = gaussian(220, 6, int(k), size)  # a scale of 1 makes ties, 1e9 needs more than doubles
    got = centroids.cluster_report(vectors(spark, rows), k=k, rounds=5, dims=6, scale=scale).collect()
    want = lloyd(rows, k, 5, 6, scale, 2)
    long = lambda v: v if v < 1 << 63 else None
    assert {r.vec_id: tuple(r)[1:] for r in got} == {i: (v[0], *map(long, v[1:4]), v[4]) for i, v in want.items()} and len(got) == 220


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in 10 * (i % 8) * np.eye(8)[i % 8] + rng.normal(size=8) / 20]) for i in range(800)]
    state, _ = centroids.cluster(vectors(spark, rows), k=8, rounds=5, dims=8)
    assert state.filter("scanned").count() < 400


def test_clusters_of_odd_rows(spark):
    assert centroids.cluster_report(spark.createDataFrame([], SHAPE), dims=2).count() == 0
    odd = [(1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("-inf"), 1.0]), (5, []), (6, [1.0])]
    assert centroids.cluster_report(vectors(spark, odd), dims=2).count() == 0
    df = vectors(spark, odd + [(None, [0.0, 1.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0]), (8, [3.0, 3.5])])
    for c in ("id", "vec", "cluster", "upper", "own", "distance"):
        df = df.withColumn(c, df.label)
    got = centroids.cluster_report(df, k=40, dims=2).collect()
    assert sorted((r.vec_id or -1, r.distance) for r in got) == [(-1, 0), (7, 0), (7, 0), (8, 0)]
    far = centroids.cluster_report(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>"), k=1, dims=1).collect()
    assert [r.distance for r in far] == [None, None] and far[0].inertia is None
