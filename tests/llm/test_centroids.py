import hashlib
import math
import random

import numpy as np
import pytest

from wardlight.llm import centroids


def brute(rows, size, k=8, rounds=10):
    """Every vector against every centroid in whole numbers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    points = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(points))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(points)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                points[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    by = {j: sum(d for _, d, a in last if a == j) for j in range(len(points))}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in points]
    return sorted(((i, j, d, by[j], sum(by.values()), shas[j]) for i, d, j in last), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_clusters_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, [rng.gauss((i % 3) * 0.4, 0.2) for _ in range(64)]) for i in range(n)]
    rows += [(i % 7, [0.5] * 64) for i in range(n // 3)]  # ties and repeated vectors
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [math.nan] + [0.0] * 63), (905, [math.inf] * 64), (906, [None] + [0.0] * 63), (907, [-math.inf] + [1.0] * 63)]
    if n > 1:
        rows.append((None, [0.25] * 64))
    df = spark.createDataFrame([(*r, "x", 3) for r in rows + odd], "vec_id long, embedding array<float>, id string, cluster int").repartition(5)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 64)
    assert rows_of(centroids.cluster(df)) == want


def test_bounds_skip_exact_distances_and_change_nothing():
    rng = np.random.default_rng(4)
    middles = rng.integers(-3000, 3000, (12, 64))
    rows = middles[rng.integers(0, 12, 4000)] + rng.integers(-60, 60, (4000, 64))
    pivots = centroids.draw_pivots(rows[:500], 6)
    far = np.stack([np.sqrt(centroids.squares(rows, p).astype(float)) for p in pivots], axis=1)
    points = np.concatenate([middles, middles[:2], rows[:3]])
    at, best, exact = centroids.nearest(rows, far, points, pivots)
    every = np.stack([centroids.squares(rows, c) for c in points], axis=1)
    assert (best == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()
    assert exact < every.size / 3  # of 17 centroids

    big = rng.integers(-(1 << 27) + 1, 1 << 27, (200, 64))
    far = np.stack([np.sqrt(centroids.squares(big, p).astype(float)) for p in big[:4]], axis=1)
    at, best, _ = centroids.nearest(big, far, big[:20], big[:4])
    every = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in big[:20]] for v in big]
    assert [int(x) for x in best] == [min(e) for e in every] and at.tolist() == [e.index(min(e)) for e in every]


def test_other_sizes_and_too_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [rng.random(), rng.random()]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(df, size=2, k=3, rounds=4, pivots=2)
    assert rows_of(got) == brute(rows, 2, 3, 4)
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(huge, size=2).collect()
