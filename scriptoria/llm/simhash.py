"""SimHash near-duplicates by multi-index hashing (operator 10).

Fingerprints of 64 bits are cut into two halves. If two of them differ in at most ``2 * r + 1`` bits, one half differs
in at most ``r``. Both sides enumerate the ball of radius ``ceil(r / 2)`` around that half, so two halves at distance
``r`` meet in a common table entry; entries are fetched bucket by bucket and the whole distance is verified. Buckets
above ``direct`` members (large groups of near copies) are not compared pairwise: their members enumerate the ball of
half the link distance around the whole fingerprint, and two fingerprints link exactly if such balls meet.

Contract: a null or empty text has fingerprint zero and links like any other; copies of a fingerprint are one node;
a null ``doc_id`` never names a component unless nothing else is in it (then ``component_id`` is null); rows are never
merged, repeated rows come back repeated; only ``doc_id`` and ``text`` are read, other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import U64, Texts, deal, gather, mix, numbered, popcount, query, record, scatter, starts, table, tasks
from .components import components

SEED = 42
DIRECT = 64  # members of a bucket that are compared with each other; larger buckets take the exact way by balls


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words (fewer words: of the whole sequence)."""
    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(line, SEED)]
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begin = [0, *(gaps[: len(words) - size] + 1).tolist()]
    end = [*gaps[size - 1 :].tolist(), len(line)]
    return [digest(line[s:e], SEED) for s, e in zip(begin, end)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each text: bits set in over half of its hashes."""
    out = np.zeros(len(counts), U64)
    some = counts > 0
    if some.any():
        first = (np.cumsum(counts) - counts)[some]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        on = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(on, axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): the SimHash of every text as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            texts, ids = Texts(batch.column("text")), batch.column("doc_id")
            for i, j in texts.chunks(2 << 20):
                each = [shingle_hashes(texts.text(k), size) for k in range(i, j)]
                counts = np.array([len(x) for x in each])
                fp = majority(np.array([h for x in each for h in x], U64), counts)
                yield record(schema, doc_id=ids.slice(i, j - i), fp=fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` set bits among the lowest ``bits``."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], U64)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links: the others would not change any component."""
    up: dict[int, int] = {}
    keep: tuple[list[int], list[int]] = ([], [])

    def top(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        s, t = top(x), top(y)
        if s != t:
            up[max(s, t)] = min(s, t)
            keep[0].append(x)
            keep[1].append(y)
    return keep


def _variants(masks: np.ndarray, halves: bool, buckets: int):
    def run(batches):
        for batch in batches:
            all_fp = batch.column("fp").to_numpy(zero_copy_only=False).view(U64)
            step = max(1, (1 << 20) // len(masks))
            for i in range(0, len(all_fp), step):
                fp = all_fp[i : i + step]
                if halves:
                    low, high = fp & U64(0xFFFFFFFF), fp >> U64(32)
                    key = np.concatenate([(low[:, None] ^ masks).ravel(), ((high[:, None] ^ masks) | U64(1 << 32)).ravel()])
                    own = np.tile(np.repeat(fp, len(masks)), 2)
                else:
                    key, own = (fp[:, None] ^ masks).ravel(), np.repeat(fp, len(masks))
                yield scatter(mix(key) % U64(buckets), key=key, fp=own)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.bool_())])


def _verify(distance: int, direct: int):
    """Links of the buckets in a task; members of buckets above ``direct`` are given as hot."""

    def run(batches):
        got = gather(batches, key=U64, fp=U64)
        order = np.lexsort((got["fp"], got["key"]))
        key, fp = got["key"][order], got["fp"][order]
        first = np.flatnonzero(starts(key))
        length = np.diff(np.append(first, len(key)))
        size = np.repeat(length, length)
        small, hot = (size > 1) & (size <= direct), np.unique(fp[size > direct])
        key, fp = key[small], fp[small]
        left, right = [np.zeros(0, U64)], [np.zeros(0, U64)]
        for d in range(1, direct):
            same = np.flatnonzero(key[d:] == key[:-d])
            if not len(same):
                break
            same = same[popcount(fp[same] ^ fp[same + d]) <= distance]
            left.append(fp[same])
            right.append(fp[same + d])
        a, b = _forest(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64))
        yield record(LINKS, a=a, b=b, hot=[False] * len(a))
        yield record(LINKS, a=hot.view(np.int64), b=hot.view(np.int64), hot=[True] * len(hot))

    return run


def _meet(batches):
    """Fingerprints whose balls share a point are linked: each to the least one at that point."""
    got = gather(batches, key=U64, fp=U64)
    order = np.lexsort((got["fp"], got["key"]))
    key, fp = got["key"][order], got["fp"][order]
    new = starts(key)
    least = fp[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(fp) else fp
    a, b = _forest(fp[~new].view(np.int64), least[~new].view(np.int64))
    yield record(LINKS, a=a, b=b, hot=[False] * len(a))


def links(fps: DataFrame, distance: int = 4, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give the components of "at most ``distance`` bits differ"."""
    spark = fps.sparkSession
    radius = -(-(distance // 2) // 2)  # of each side's ball around a half
    buckets = tasks(spark)
    nodes = fps.select("fp").distinct()
    cells = nodes.mapInArrow(_variants(ball(32, radius), True, buckets), "bucket int, key binary, fp binary")
    found = materialize(deal(cells, spark).mapInArrow(_verify(distance, direct), "a long, b long, hot boolean"), "near")
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    balls = hot.mapInArrow(_variants(ball(64, distance // 2), False, buckets), "bucket int, key binary, fp binary")
    met = deal(balls, spark).mapInArrow(_meet, "a long, b long, hot boolean")
    if distance % 2:
        raise ValueError("distance must be even: two balls of half of it meet exactly within it")
    return found.where("not hot").unionByName(met).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 4, distance: int = 4, direct: int = DIRECT) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach."""
    fps = materialize(fingerprints(docs, size), "fp")
    roots = components(links(fps, distance, direct)).withColumnRenamed("node", "fp")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = materialize(least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(labelled.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 4, distance: int = 4) -> DataFrame:
    """One row of each component: the first by doc_id, of repeated ids by a hash of the text. Null ids stay."""
    rows = numbered(docs.where("doc_id is not null").select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    found = near_duplicates(rows.select(F.col("ord").alias("doc_id"), "text"), size, distance)
    kept = rows.join(found.where("doc_id = component_id").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


@query("op10_simhash")
def op10(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
