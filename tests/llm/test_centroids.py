"""Centroid clustering against plain rounds over all distances."""

import hashlib
import math

import numpy as np
import pytest

from scriptoria.llm import centroids


def brute(rows, k, rounds, seed=3, scale=1024, width=64):
    """[(vec_id, cluster, distance)] and the centroids, with Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cs)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=repr), cs


def got(df):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=repr)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    want, cs = brute([(r.vec_id, r.embedding) for r in table.collect()], 8, 10)
    found = centroids.cluster(table)
    assert got(found) == want
    for r in found.collect():
        assert r.centroid == cs[r.cluster]
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for _, _, d in want)
    assert got(centroids.cluster(table.repartition(7))) == want


def test_odd_vectors(spark):
    one = [float(i) for i in range(-2, 2)]
    rows = [
        (1, one, "a"), (2, one, "b"), (2, one, "b"), (3, None, "c"), (4, [1.0], "c"), (5, [1.0, None, 2.0, 3.0], "d"), (6, [1.0, float("nan"), 2.0, 3.0], "d"),
        (7, [1.0, 2.0, float("-inf"), 3.0], "d"), (None, [5.0, 5.0, 5.0, 5.5], "e"), (None, [0.0] * 4, "e"), (8, [-0.0001, 0.0, 0.0, 0.0], "f"), (9, [], "g"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    for k in (1, 3, 20):
        want, _ = brute([(i, v) for i, v, _ in rows], k, 4, width=4)
        assert got(centroids.cluster(table, k=k, rounds=4, width=4)) == want
    assert got(centroids.cluster(table.where("false"), width=4)) == []
    with pytest.raises(Exception, match="after scaling"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), width=4).collect()


def test_bounds_prune_and_never_lose():
    rng = np.random.default_rng(5)
    middle = rng.integers(-900, 900, (6, 64))
    x = middle[rng.integers(0, 6, 800)] + rng.integers(-40, 40, (800, 64))
    x[:40] = middle[0]  # copies
    cs = np.vstack([middle, middle[:1]])  # a tie of two centroids
    pivots = centroids.far_pairs(x[::10], 8)
    assert len(pivots) % 2 == 0
    d = np.sqrt(centroids.squared(x[:, None], pivots[None]).astype(float))
    c_pivot = np.sqrt(centroids.squared(cs[:, None], pivots[None]).astype(float))
    apart = np.sqrt(centroids.squared(pivots[::2], pivots[1::2]).astype(float))
    every = centroids.squared(x[:, None], cs[None])
    assert (centroids.bounds(d, c_pivot, apart) <= every).all()
    near, distance, measured = centroids.nearest(x, d, cs, c_pivot, apart)
    assert (near == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.6 * every.size  # the bounds spare exact distances
