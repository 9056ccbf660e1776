"""Centroid clustering of integer vectors with Ptolemaic pivots (operator 12).

Vectors are turned into integers once and written with their distances to a few fixed pivots. In each round a vector is
assigned to its nearest centroid: for pivots p and q, Ptolemy's inequality gives d(x, c) d(p, q) >= |d(x, p) d(c, q) -
d(x, q) d(c, p)|, so cached distances bound the distance from below. The centroid with the smallest bound is measured
first; others are measured, in integers, only if their bound is not above it. Bounds are rounded down by more than the
error of the arithmetic, so no nearest centroid is ever lost and ties go to the smaller number. A round is one pass over
the written vectors whose sums are added up in Spark; only ``k`` centroids reach the driver.

Contract: only vectors with exactly ``width`` components, none null or non-finite, take part; other rows give no row. A null
id hashes as an empty text. Vectors with equal ids are told apart by their components when centroids are picked; rows equal
in both are interchangeable. With fewer than ``k`` vectors each is a centroid; an empty table gives no rows. Components of
2**26 or more after scaling are refused with an error, as their squared distances would leave a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, record, table

WIDTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
PIVOTS = 8
PIVOT_SAMPLE = 64  # vectors, by the same hash, among which far pairs are picked as pivots
LIMIT = 1 << 26
BATCH = 8192

VECTORS = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("to_pivots", pa.binary())])
ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
SUMS = pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("total", pa.int64())])


def scaled(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer components floor(scale * x) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    whole = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ints = F.transform(v, lambda x: F.floor(x * scale))
    fits = F.forall(v, lambda x: F.abs(x * scale) < LIMIT)
    safe = F.when(fits, ints).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling")).cast("array<bigint>"))
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias(vector)).where(F.coalesce(whole, F.lit(False))).select("vec_id", safe.alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exactly."""
    d = a - b
    return (d * d).sum(axis=-1)


def far_pairs(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Up to ``pivots`` vectors in pairs that lie far apart: each pair is the farthest one among those left."""
    left, chosen = list(range(len(sample))), []
    d = squared(sample[:, None], sample[None])
    while len(left) > 1 and len(chosen) + 1 < pivots:
        part = d[np.ix_(left, left)]
        i, j = divmod(int(part.argmax()), len(left))
        if not part[i, j]:
            break
        chosen += [left[i], left[j]]
        left = [x for x in left if x not in (chosen[-1], chosen[-2])]
    return sample[chosen]


def bounds(x_pivot: np.ndarray, c_pivot: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of vectors and centroids from their distances to the pairs of pivots."""
    low = np.zeros((len(x_pivot), len(c_pivot)))
    for k in range(len(apart)):
        one = x_pivot[:, 2 * k, None] * c_pivot[None, :, 2 * k + 1]
        two = x_pivot[:, 2 * k + 1, None] * c_pivot[None, :, 2 * k]
        np.maximum(low, (np.abs(one - two) - 1e-12 * (one + two)) / apart[k], out=low)
    return np.square(np.maximum(low * (1 - 1e-9) - 1e-6, 0))


def nearest(x: np.ndarray, x_pivot: np.ndarray, centroids: np.ndarray, c_pivot: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many distances were measured."""
    n, low = len(x), bounds(x_pivot, c_pivot, apart)
    best = low.argmin(axis=1)
    distance = squared(x, centroids[best])
    measured = n
    guess = best.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((guess != c) & (low[:, c] <= distance))
        measured += len(rows)
        d = squared(x[rows], centroids[c])
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        rows, d = rows[closer], d[closer]
        best[rows], distance[rows] = c, d
    return best, distance, measured


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(-1, width)


def _packed(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    step = a.itemsize * (a.shape[1] if a.ndim == 2 else 1)
    offsets = np.arange(len(a) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(a)]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def _cache(pivots: np.ndarray, width: int):
    """Vectors as bytes, with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = _rows(batch, width)
                d = np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64)) if len(pivots) else np.zeros((len(x), 0))
                yield record(VECTORS, vec_id=batch.column("vec_id"), v=_packed(x.astype(np.int32)), to_pivots=_packed(d))

    return run


def _assign(centroids: np.ndarray, pivots: np.ndarray, sums: bool):
    """Assignments of a batch, or the sum of each cluster over a whole task."""
    k, width = centroids.shape
    c_pivot = np.sqrt(squared(centroids[:, None], pivots[None]).astype(np.float64)) if len(pivots) else np.zeros((k, 0))
    apart = np.sqrt(squared(pivots[::2], pivots[1::2]).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                x = _unpacked(batch.column("v"), np.int32, width).astype(np.int64)
                near, distance, _ = nearest(x, _unpacked(batch.column("to_pivots"), np.float64, len(pivots)), centroids, c_pivot, apart)
                if sums:
                    for c in np.unique(near):
                        total[c] += x[near == c].sum(axis=0)
                    count += np.bincount(near, minlength=k)
                else:
                    yield record(ASSIGNED, vec_id=batch.column("vec_id"), cluster=near.astype(np.int32), distance=distance)
        if sums:  # a cluster's count stands after its components
            both = np.hstack([total, count[:, None]])
            yield record(SUMS, cluster=np.repeat(np.arange(k), width + 1).astype(np.int32), component=np.tile(np.arange(width + 1), k).astype(np.int32), total=both.ravel())

    return run


def moved(vectors: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the exact mean of each cluster; empty ones stay."""
    k, width = centroids.shape
    parts = vectors.mapInArrow(_assign(centroids, pivots, True), "cluster int, component int, total long")
    totals = np.zeros((k, width + 1), object)
    for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect():  # k * (width + 1) rows
        totals[r.cluster, r.component] = r.total
    after = centroids.copy()
    for c, (*sums, n) in enumerate(totals.tolist()):
        if n:
            after[c] = [s // n for s in sums]
    return after


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) of every vector that takes part."""
    ints = scaled(vectors, id_column, vector, width, scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r.v for r in ints.orderBy(order, "v").limit(max(k, PIVOT_SAMPLE)).collect()]
    sample = np.array(first, np.int64).reshape(-1, width)
    centroids, chosen = sample[:k].copy(), far_pairs(sample, pivots)
    cached = materialize(ints.mapInArrow(_cache(chosen, width), "vec_id long, v binary, to_pivots binary"), "vectors")
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(cached, centroids, chosen)
    assigned = materialize(cached.mapInArrow(_assign(centroids, chosen, False), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    about = [(c, sums.get(c), sum(sums.values()), v, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    named = assigned.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def _sql() -> str:
    """The same rounds in SQL, over all vectors, without bounds or pivots."""
    near = """{name} AS MATERIALIZED (
        SELECT vec_id, x, d.c AS cluster, d.d AS distance FROM (
            SELECT vec_id, x, list_min(list_transform(cs, lambda e: {{'d': list_sum(list_transform(list_zip(x, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': e.c}})) AS d
            FROM kept, (SELECT list({{'c': c, 'v': v}} ORDER BY c) AS cs FROM {centroids})))"""
    move = """{name} AS MATERIALIZED (
        SELECT c, coalesce(m.v, o.v) AS v FROM {centroids} o LEFT JOIN (
            SELECT cluster AS c, list(s ORDER BY i) AS v FROM (
                SELECT cluster, i, floor(sum(y) / count(*))::BIGINT AS s
                FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM {near}) GROUP BY cluster, i)
            GROUP BY cluster) m USING (c))"""
    # sums of at most 2**26 * rows are exact in a double up to 2**53; the floor of an inexact quotient is put right below
    exact = "CASE WHEN sum(y) >= 0 THEN sum(y)::HUGEINT // count(*) ELSE -((-sum(y)::HUGEINT + count(*) - 1) // count(*)) END"
    move = move.replace("floor(sum(y) / count(*))", f"({exact})")
    parts = [f"""kept AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"""c0 AS MATERIALIZED (
        SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x AS v FROM (
            SELECT sha256('{SEED}:' || vec_id::VARCHAR) AS h, x FROM kept ORDER BY h LIMIT {CLUSTERS}))"""]  # fmt: skip
    for r in range(ROUNDS):
        parts.append(near.format(name=f"n{r}", centroids=f"c{r}"))
        parts.append(move.format(name=f"c{r + 1}", centroids=f"c{r}", near=f"n{r}"))
    parts.append(near.format(name="last", centroids=f"c{ROUNDS}"))
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance,
            (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
            sha256(list_aggregate(list_transform(v, lambda y: y::VARCHAR), 'string_agg', ',')) AS centroid_sha256
        FROM last JOIN c{ROUNDS} ON c = cluster"""


@query("op12_centroids", _sql())
def op12(spark, sf_dir):
    """Cluster of every vector of 64 components after ten exact rounds from eight hashed starts."""
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")
