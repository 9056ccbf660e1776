"""Near copies at a word-shingle similarity of 0.8 or more, by long SimHash fingerprints (operator 10 for pipelines).

At a similarity of 0.8 two fingerprints of 64 bits differ in about ten bits, more than small balls around a few segments can
bridge. So a text gets 192 bits, from the set of its shingles, in eight segments of 24: the balls of radius one around both
segments meet if these differ in two bits at most, which of eight segments one does for 12 of 13 pairs at 0.8 and for
nearly all closer ones. Balls are enumerated where a segment's bucket is; a text is sent once to each bucket that its ball
touches. Whole distances are verified within a bucket, links are thinned to its forest of nearest links, and each link that
is left is checked by the exact Jaccard similarity of both sets of shingles.

Crowded places (over ``DIRECT`` members) are not compared pair by pair: members join the first leader within the distance,
and two leaders' groups are only searched for a link while nothing else connects them.

Fingerprints tell most links, not all. An exact pass finds the rest: with shingles in one order for all texts, two sets of
the least similarity share a shingle among the first ``n - ceil(least * n) + 1`` of each. Texts of different components that
share such a shingle, and whose lengths and places allow the similarity, are compared by their sets. The order puts crowded
shingles last; a table of counts per hash slot, of fixed size, tells them, and no result depends on it.

Contract: a null or empty text has no shingles and equals other such texts; a text of fewer words than a shingle is one
shingle; rows with null or repeated ids are compared as any other (see ``numbered`` for their order); an empty table gives
no rows; extra columns are kept, whatever their names. Sets of shingles are sets of their 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .common import U64, Texts, deal, gather, mix, numbered, record, scatter, starts, tasks
from .components import components
from .simhash import DIRECT, shingle_hashes

WORDS = 3  # of 64 bits
SEGMENT = 3  # bytes
SEGMENTS = 8 * WORDS // SEGMENT
BITS = 8 * SEGMENT
DEVIATIONS = 1.75  # how far beyond the expected distance a pair of the least similarity is still looked at
TURNS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # a hash gives its further words by scrambling with these

SLOTS = 20  # bits of a hash that name its slot in the table of counts
PART = 10  # bits of a slot within a row of this table

FP = pa.schema([("ord", pa.int64()), *((f"f{k}", pa.int64()) for k in range(WORDS)), ("shingles", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int32())])


def distance_of(similarity: float, bits: int = 64 * WORDS) -> int:
    """Largest distance that is looked at: the expected one for this similarity and ``DEVIATIONS`` deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def _majorities(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints (n x WORDS) of sets of hashes."""
    counts = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), WORDS), U64)
    some = counts > 0
    if some.any():
        hashes = np.concatenate(sets)
        first = (np.cumsum(counts) - counts)[some]
        for w, turn in enumerate(TURNS):
            bits = np.unpackbits(mix(hashes ^ U64(turn)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            on = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > counts[some][:, None]
            out[some, w] = np.packbits(on, axis=1, bitorder="little").view(U64).ravel()
    return out


def _shingles(texts: Texts, i: int, j: int, size: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(texts.text(k), size), U64)) for k in range(i, j)]


def _fingerprints(size: int):
    """Fingerprint of each text and digest of its set; then the task's counts of texts per slot of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOTS, np.int64)
        for batch in batches:
            texts, ids = Texts(batch.column("text")), batch.column("ord")
            for i, j in texts.chunks(1 << 20):
                sets, none = _shingles(texts, i, j, size), pa.nulls(j - i)
                fp = _majorities(sets).view(np.int64)
                counts += np.bincount((np.concatenate(sets) >> U64(64 - SLOTS)).astype(np.int64), minlength=1 << SLOTS)
                words = {f"f{w}": np.ascontiguousarray(fp[:, w]) for w in range(WORDS)}
                yield record(FP, ord=ids.slice(i, j - i), **words, shingles=[md5(s.tobytes()).digest() for s in sets], part=none.cast(pa.int32()), counts=none.cast(pa.binary()))
        rows = counts.reshape(-1, 1 << PART)
        some = np.flatnonzero(rows.any(axis=1))
        if len(some):
            empty = {f.name: pa.nulls(len(some), f.type) for f in FP}
            yield record(FP, **empty | {"part": some.astype(np.int32), "counts": [r.tobytes() for r in rows[some]]})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of counts by part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["part", "counts"])


def _levels(counts: DataFrame) -> np.ndarray:
    """How crowded each slot is, in steps of two (2 ** SLOTS bytes whatever the input)."""
    sums = np.zeros((1 << SLOTS - PART, 1 << PART), np.int64)
    for row in counts.repartition(tasks(counts.sparkSession), "part").mapInArrow(_added, "part int, counts binary").collect():
        sums[row.part] = np.frombuffer(row.counts, np.int64)
    return np.ceil(np.log2(np.maximum(1, sums.ravel() / (sums.mean() + 4)))).astype(np.uint8)


def _segment(fp: np.ndarray, s: int) -> np.ndarray:
    b = np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 8 * WORDS)[:, SEGMENT * s : SEGMENT * (s + 1)].astype(np.int64)
    return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16


def _send(top: int):
    """Each node to the bucket of each segment's top bits, and to those that a flip of one of these bits leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            fp = np.stack([batch.column(f"f{w}").to_numpy() for w in range(WORDS)], axis=1).view(U64)
            buckets, flips, n = [], [], len(ids)
            for s in range(SEGMENTS):
                high = _segment(fp, s) >> (BITS - top)
                for flip in range(-1, top):
                    buckets.append(s << top | (high if flip < 0 else high ^ (1 << flip)))
                    flips.append(np.full(n, flip, np.int8))
            times = len(buckets)
            yield scatter(np.concatenate(buckets), id=np.tile(ids, times), fp=np.tile(fp, (times, 1)).view(f"V{8 * WORDS}").ravel(), flip=np.concatenate(flips))

    return run


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


class _Forest:
    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def top(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def add(self, links: list[tuple[int, int, int]]) -> None:
        """(bits, a, b), nearest first; links inside a tree are not needed."""
        for d, a, b in sorted(links):
            s, t = self.top(a), self.top(b)
            if s != t:
                self.up[max(s, t)] = min(s, t)
                self.kept.append((a, b, d))


def _crowd(members: np.ndarray, fp: np.ndarray, distance: int, forest: _Forest) -> None:
    """Links of many members: each to the first leader within the distance, then between groups not yet connected."""
    left, groups = members, []
    while len(left):
        d = _bits(fp[left], fp[left[0]])
        near = d <= distance
        forest.add([(int(x), int(left[0]), int(y)) for x, y in zip(d[near][1:], left[near][1:])])
        groups.append(left[near])
        left = left[~near]
    for i, one in enumerate(groups):
        for two in groups[:i]:
            if forest.top(int(one[0])) == forest.top(int(two[0])) or _bits(fp[one[0]], fp[two[0]]) > 3 * distance:
                continue
            for at in range(0, len(one), 256):
                d = _bits(fp[one[at : at + 256], None], fp[None, two])
                if d.min() <= distance:
                    x, y = np.unravel_index(d.argmin(), d.shape)
                    forest.add([(int(d.min()), int(one[at + x]), int(two[y]))])
                    break


def _meet(top: int, distance: int, direct: int):
    low = np.array([0, *(1 << b for b in range(BITS - top))], np.int64)

    def bucket(s: int, ids: np.ndarray, fp: np.ndarray, flip: np.ndarray) -> pa.RecordBatch:
        ids, first, back = np.unique(ids, return_index=True, return_inverse=True)  # a node may come by several flips
        value = _segment(fp, s)
        own = flip < 0
        key = np.concatenate([(value[own][:, None] ^ low).ravel(), value[~own] ^ (1 << (flip[~own].astype(np.int64) + BITS - top))])
        node = np.concatenate([np.repeat(back[own], len(low)), back[~own]])
        fp = fp[first]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        length = np.diff(np.append(np.flatnonzero(starts(key)), len(key)))
        size = np.repeat(length, length)
        few = (size > 1) & (size <= direct)
        forest, found = _Forest(len(ids)), []
        k, x = key[few], node[few]
        for step in range(1, direct):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            a, b = x[same], x[same + step]
            d = _bits(fp[a], fp[b])
            near = (d <= distance) & (a != b)
            found.append(np.stack([d[near].astype(np.int64), a[near], b[near]], axis=1))
        if found:
            forest.add([tuple(r) for r in np.unique(np.concatenate(found), axis=0).tolist()])
        many = np.flatnonzero(starts(key) & (size > direct))
        for at in many:
            _crowd(np.unique(node[at : at + size[at]]), fp, distance, forest)
        a, b, d = zip(*forest.kept) if forest.kept else ((), (), ())
        return record(LINK, a=ids[list(a)] if a else [], b=ids[list(b)] if b else [], bits=list(d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered_rows():
            for batch in batches:  # the number of a bucket is told by its rows; entries of a row belong to one bucket
                sizes = np.array([len(x) // 8 for x in batch.column("id").to_pylist()])
                where.append(np.repeat(batch.column("bucket").to_numpy(), sizes))
                yield batch

        where: list[np.ndarray] = []
        got = gather(numbered_rows(), id=np.int64, fp=U64, flip=np.int8)
        if not where:
            return
        of, fp = np.concatenate(where), got["fp"].reshape(-1, WORDS)
        order = np.argsort(of, kind="stable")
        cut = np.flatnonzero(np.append(starts(of[order]), True))
        for lo, hi in zip(cut[:-1], cut[1:]):
            rows = order[lo:hi]
            yield bucket(int(of[rows[0]]) >> top, got["id"][rows], fp[rows], got["flip"][rows])

    return run


def candidates(nodes: DataFrame, distance: int, direct: int = DIRECT) -> DataFrame:
    """Links (a, b, bits) of each bucket's forest between ``nodes`` (id, f0, f1, f2; ids are distinct)."""
    spark = nodes.sparkSession
    top = min(16, max(4, math.ceil(math.log2(max(1, 4 * tasks(spark) / SEGMENTS)))))  # about four buckets a task; no matter for the result
    sent = nodes.mapInArrow(_send(top), "bucket int, id binary, fp binary, flip binary")
    found = deal(sent, spark).mapInArrow(_meet(top, distance, direct), "a long, b long, bits int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").distinct()


def least_shared(n, similarity: float):
    """Least number of common elements of two sets that have ``n`` elements in their union (or a bound for one of ``n``)."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _prefixes(size: int, similarity: float, levels, buckets: int):
    """The first shingles of each text, as many as one must be shared, to the buckets of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in batches:
            texts, ids, roots = Texts(batch.column("text")), batch.column("id").to_numpy(), batch.column("root").to_numpy()
            for i, j in texts.chunks(4 << 20):
                sets = [s[np.argsort(level[s >> U64(64 - SLOTS)], kind="stable")] for s in _shingles(texts, i, j, size)]
                n = np.array([len(s) for s in sets])
                first = np.where(n > 0, n - least_shared(n, similarity) + 1, 0)
                hashes, of = np.concatenate([s[:k] for s, k in zip(sets, first)]), np.repeat(np.arange(j - i), first)
                place = np.arange(len(of)) - np.repeat(np.cumsum(first) - first, first)
                out = scatter((hashes & U64(buckets - 1)).astype(np.int64), hash=hashes, id=ids[i:j][of], root=roots[i:j][of], n=n[of].astype(np.int32), place=place.astype(np.int32))
                if out is not None:
                    yield out

    return run


def _share(similarity: float, direct: int):
    """Pairs (a, b) of different roots that share a first shingle and may have the similarity, by lengths and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gather(batches, hash=U64, id=np.int64, root=np.int64, n=np.int32, place=np.int32)
        order = np.lexsort((got["n"], got["hash"]))
        key = got["hash"][order]
        new = starts(key)
        length = np.diff(np.append(np.flatnonzero(new), len(key)))
        size = np.repeat(length, length)
        order, key, size, new = (x[size > 1] for x in (order, key, size, new))
        ids, root, n, place = (got[c][order] for c in ("id", "root", "n", "place"))
        found: list[np.ndarray] = []
        held = 0

        def allowed(a, b):
            """a stands before b in its group, so it is not the longer one."""
            shared = 1 + np.minimum(n[a] - place[a], n[b] - place[b]) - 1
            ok = (root[a] != root[b]) & (n[a] >= similarity * n[b] - 1e-9)
            return ok & (shared * (1 + similarity) >= similarity * (n[a].astype(np.int64) + n[b]) - 1e-6)

        def pairs() -> pa.RecordBatch:
            both = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        few = np.flatnonzero(size <= direct)
        k = key[few]
        for step in range(1, direct):
            same = np.flatnonzero(k[step:] == k[:-step])
            if not len(same):
                break
            a, b = few[same], few[same + step]
            ok = allowed(a, b)
            found.append(np.sort(np.stack([ids[a[ok]], ids[b[ok]]], axis=1), axis=1))
            held += int(ok.sum())
        for at in np.flatnonzero(new & (size > direct)):
            end = at + size[at]
            for a in range(at, end):
                b = np.arange(a + 1, end)
                b = b[allowed(a, b)]
                found.append(np.sort(np.stack([np.full(len(b), ids[a]), ids[b]], axis=1), axis=1))
                held += len(b)
                if held > 1 << 20:
                    yield pairs()
                    found.clear()
                    held = 0
        if held:
            yield pairs()

    return run


def exact_candidates(members: DataFrame, levels: np.ndarray, size: int, similarity: float, direct: int = DIRECT) -> DataFrame:
    """Every pair (a, b) of ``members`` (id, root, packed text) of different roots that may reach the similarity."""
    spark = members.sparkSession
    buckets = 1 << max(4, math.ceil(math.log2(4 * tasks(spark))))  # no matter for the result
    table = spark.sparkContext.broadcast(levels)
    sent = members.mapInArrow(_unpacked(_prefixes(size, similarity, table, buckets)), "bucket int, hash binary, id binary, root binary, n binary, place binary")
    return deal(sent, spark).mapInArrow(_share(similarity, direct), "a long, b long").distinct()


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, as they go through joins: a third of the bytes of their sets of shingles."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = Texts(batch.column("text"))
        for i, j in texts.chunks(8 << 20):
            packed = pa.array([pack(texts.text(k)) for k in range(i, j)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("ord").slice(i, j - i), packed], ["ord", "packed"])


def _unpacked(step):
    """``step`` over batches whose compressed texts are texts again."""

    def texts(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            for i in range(0, len(packed), 256):
                part = batch.slice(i, 256)
                text = pa.array([unpack(x) for x in packed[i : i + 256]], pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([text if n == "packed" else part.column(n) for n in part.schema.names], ["text" if n == "packed" else n for n in part.schema.names])

    return lambda batches: step(texts(batches))


def _similar(size: int, least: float):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}  # the sets of the latest texts; rows come in the order of one side
        held = 0

        def shingles(number: int, packed: bytes) -> np.ndarray:
            nonlocal held
            if number not in known:
                if held > 1 << 21:
                    known.clear()
                    held = 0
                known[number] = np.unique(np.array(shingle_hashes(unpack(packed), size), U64))
                held += len(known[number])
            return known[number]

        for batch in batches:
            ok = []
            for a, one, b, two in zip(*(batch.column(c).to_pylist() for c in ("a", "one", "b", "two"))):
                x, y = shingles(a, one), shingles(b, two)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])

    return run


def _verified(packed: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets of shingles have the similarity; ``packed`` (ord, packed) has the texts."""
    linked = pairs.select(F.col("a").alias("ord")).unionByName(pairs.select(F.col("b").alias("ord"))).distinct()
    met = materialize(packed.join(broadcast_if_small(linked), "ord", "left_semi"), "texts")
    both = pairs.join(met.select(F.col("ord").alias("a"), F.col("packed").alias("one")), "a").join(met.select(F.col("ord").alias("b"), F.col("packed").alias("two")), "b")
    return materialize(both.mapInArrow(_similar(size, similarity), "a long, b long"), "links")


def groups(rows: DataFrame, size: int = 5, similarity: float = 0.8, direct: int = DIRECT) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` (ord, text): the links (a, b) that were verified, and (ord, id) with the first row of its equal sets.

    Rows are connected by these links and equal sets exactly if they are by all pairs of the similarity.
    """
    texts = rows.select("ord", F.col("text").cast("string").alias("text"))
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    told = materialize(texts.mapInArrow(_fingerprints(size), ", ".join(f"{f.name} {kinds[f.type]}" for f in FP)), "fp")
    fps = told.where("part is null").drop("part", "counts")
    words = [f"f{k}" for k in range(WORDS)]
    nodes = materialize(fps.groupBy("shingles").agg(F.min("ord").alias("id"), *[F.first(w).alias(w) for w in words]), "nodes")
    found = materialize(candidates(nodes.drop("shingles"), distance_of(similarity), direct).select("a", "b").distinct(), "near")
    packed = texts.mapInArrow(_pack, "ord long, packed binary")
    near = _verified(packed, found, size, similarity)

    roots = components(near).select(F.col("node").alias("id"), "root")
    members = nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    levels = _levels(told.where("part is not null").select("part", "counts"))
    rest = exact_candidates(packed.withColumnRenamed("ord", "id").join(members, "id"), levels, size, similarity, direct)
    links = near.unionByName(_verified(packed, materialize(rest, "rest"), size, similarity))
    return links, fps.join(nodes.select("shingles", "id"), "shingles").select("ord", "id")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: the first by id (null ids first), of equal ids by a hash of the text."""
    rows = numbered(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    links, nodes = groups(rows, size, similarity)
    # Those that go are fewer than those that stay: each row has one entry in ``nodes``, a node's own copies go with it or for it.
    gone = nodes.where("ord <> id").select("ord").unionByName(components(links).where("node <> root").select(F.col("node").alias("ord")))
    return rows.join(broadcast_if_small(materialize(gone, "gone")), "ord", "left_anti").select("row.*")
