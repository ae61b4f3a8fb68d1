"""Centroid clustering against plain rounds over all centroids, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from trendloom.llm import centroids


def plain(rows, clusters, rounds, length, scale=256):
    def whole(x):
        return int(x) * scale if abs(x) >= 2**52 else math.floor(x * scale)

    kept = [(i, tuple(whole(float(x)) for x in v)) for i, v in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in start[:clusters]]
    for turn in range(rounds + 1):
        own = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in points]
            own.append((d.index(min(d)), min(d)))
        if turn < rounds:
            for c in range(len(points)):
                mine = [v for (_, v), (k, _) in zip(kept, own, strict=True) if k == c]
                if mine:
                    points[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    each = [sum(d for k, d in own if k == c) for c in range(len(points))]
    long = lambda x: x if x < 2**63 else None
    return sorted((str(i), k, long(d), long(each[k]), long(sum(each)), sha[k]) for (i, _), (k, d) in zip(kept, own, strict=True))


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS v", "2 AS own", "3 AS part", "4 AS cluster")


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_rounds(spark):
    """Groups of their own, so that most vectors are bounded, copies, and values on a grid, where ties abound."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(9, 6)) * 4
    rows = [(i, [float(np.float32(x)) for x in centers[i % 9] + rng.normal(size=6)]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + rows[:20]
    got = result(centroids.cluster(table(spark, rows), clusters=12, rounds=4, length=6))
    assert got == plain(rows, 12, 4, 6)
    grid = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)]
    got = result(centroids.cluster(table(spark, grid), clusters=20, rounds=3, length=4, scale=1))
    assert got == plain(grid, 20, 3, 4, 1)


def test_bounded_vectors_scan_few_centroids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 8)) * 20
    x = np.floor((centers[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8))) * 256)
    numbers = centroids.Numbers(False)
    first = centroids.Centroids(numbers, np.floor(centers * 256))
    own, upper, lower, scanned = first.assign(x)
    moved = centroids.Centroids(numbers, first.points + rng.integers(-40, 40, first.points.shape))
    away = numbers.root(((moved.points - first.points) ** 2).sum(axis=1), True)
    again = moved.exponion(x, own, upper + away[own], np.maximum(lower - away.max(), 0))
    assert scanned == 4000 * 30 and again[3] < 8000
    want = moved.assign(x)
    assert (again[0] == want[0]).all() and (again[1] >= want[1]).all() and (again[2] <= want[2]).all()


@pytest.mark.parametrize("seed", range(4))
def test_search_from_any_bounds(seed):
    """However loose the bounds are, the nearest of the smallest number is found."""
    rng = np.random.default_rng(seed)
    numbers, k = centroids.Numbers(False), 15
    c = centroids.Centroids(numbers, rng.integers(-4, 5, (k, 3)).astype(float))
    x = rng.integers(-5, 6, (3000, 3)).astype(float)
    d = numbers.squared(x, c.points)
    own = rng.integers(0, k, len(x))
    upper = numbers.root(d[np.arange(len(x)), own], True) + rng.integers(0, 4, len(x))
    other = d.copy()
    other[np.arange(len(x)), own] = 1e9
    lower = np.maximum(numbers.root(other.min(axis=1), False) - rng.integers(0, 4, len(x)), 0)
    got = c.exponion(x, own, upper, lower)[0]
    assert (got == d.argmin(axis=1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (None, [0.5, 0.5]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]), (1, [3.0, 2.0]), (8, [-0.001, 0.0]), (None, [-7.0, 0.5])]
    for k in (1, 3, 40):
        assert result(centroids.cluster(table(spark, rows), clusters=k, rounds=5, length=2)) == plain(rows, k, 5, 2), k
    assert centroids.cluster(table(spark, []), length=2).count() == 0
    assert centroids.cluster(table(spark, rows[2:8]), length=2).count() == 0


def test_large_components(spark):
    """Beyond what doubles and longs hold everything is exact; a distance beyond a long is null."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 9)]) for i in range(60)] + [(100, [1e300, -1e300, 5.5]), (101, [1e300, -1e300, 5.0])]
    got = result(centroids.cluster(table(spark, rows, "double"), clusters=5, rounds=3, length=3))
    assert got == plain(rows, 5, 3, 3) and any(r[2] is None or r[4] is None for r in got)
