"""Shards by a consistent-hash ring with virtual nodes and bounded loads (operator 9).

Every shard has ``vnodes`` points on a ring of 64-bit positions; a row belongs to the first point clockwise of its own
position (a hash of its key). A shard takes its rows in ring order up to its load bound, and the rest go on clockwise to
the next point whose shard has room. With n rows and m shards the bounds are n / m rounded up for the first n mod m
shards and down for the others, so they add up to n: every shard ends full, row counts differ by one at most, and only
the overflow moves away from its place on the ring (the ``rows`` law).

Rows are only counted by cell (a piece of an arc of the ring); the placing works on runs of ranks in an arc, whose number
is bounded by the ring and not by the rows. A row finds its run from its arc and rank, and the run gives shard and slot.
Ranks are taken within cells over entries, the distinct pairs of key and text, with their numbers of rows, so they depend
on nothing but key and text: the same rows in other partitions get the same shards and slots. Texts of one key spread over
``SALT`` cells, and the rows of one entry are numbered in ``SALT`` parts, so neither is a hot group.

Contract: a null text has size 16 and the checksum of an empty text; a null key has a place on the ring as any value;
repeated rows are placed each (which of them gets which slot is not told apart); an empty table gives no rows; extra
columns are kept, except that the added ones (size, text_crc32, shard, slot) replace columns of their names.
"""

from __future__ import annotations

from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table

VNODES = 64
PREFIX_BITS = 12
SALT = 16
ADDED = ("size", "text_crc32", "shard", "slot")


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every point, clockwise; positions are signed 64-bit values as Spark hashes are."""
    points = {xxhash.xxh64_intdigest(f"{s}:{v}".encode()) - (1 << 63): s for s in range(shards) for v in range(vnodes)}
    return sorted(points.items())


def place(counts: list[int], owner: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (arc, first rank, end rank, shard, first slot): the rows of each arc in order, overflow going clockwise."""
    room, filled = list(bounds), [0] * len(bounds)
    runs: list[tuple[int, int, int, int, int]] = []
    waiting = {a: [(a, 0, n)] for a, n in enumerate(counts) if n}
    while waiting:
        onward: dict[int, list] = {}
        for at in sorted(waiting):
            s = owner[at]
            for arc, lo, hi in waiting[at]:
                take = min(room[s], hi - lo)
                if take:
                    runs.append((arc, lo, lo + take, s, filled[s]))
                    room[s] -= take
                    filled[s] += take
                if take < hi - lo:
                    onward.setdefault((at + 1) % len(owner), []).append((arc, lo + take, hi))
        waiting = onward
    return runs


def shard_rows(docs: DataFrame, shards: int = 40, vnodes: int = VNODES, key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or ``columns``) with size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    positions = [p for p, _ in points]
    step = 1 << (64 - PREFIX_BITS)
    by_prefix = [(k, bisect_left(positions, lo), [p for p in positions[bisect_left(positions, lo) :][:vnodes * shards] if p < lo + step]) for k, lo in ((k, (k << (64 - PREFIX_BITS)) - (1 << 63)) for k in range(1 << PREFIX_BITS))]
    cells = F.broadcast(spark.createDataFrame(by_prefix, "_ring_prefix long, _ring_before int, _ring_points array<long>"))  # 2 ** PREFIX_BITS rows
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [c for c in (docs.columns if columns is None else columns) if c not in ADDED]
    placed = docs.select(
        *dict.fromkeys([*kept, key]),
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(key).alias("_ring_at"),
    )
    placed = (
        placed.withColumn("_ring_prefix", F.shiftright("_ring_at", 64 - PREFIX_BITS) + (1 << (PREFIX_BITS - 1)))
        .join(cells, "_ring_prefix")
        .withColumn("_ring_arc", (F.col("_ring_before") + F.size(F.filter("_ring_points", lambda p: p < F.col("_ring_at")))) % len(points))
        .withColumn("_ring_id", F.xxhash64(F.lit("id"), key))
        .withColumn("_ring_part", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(SALT)))
        .withColumn("_ring_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALT)))  # fixed by the cut below
        .drop("_ring_before", "_ring_points")
    )
    placed = materialize(placed, "placed")
    cell = ["_ring_arc", "_ring_prefix", "_ring_part"]
    sizes = placed.groupBy(cell).count().orderBy(cell).collect()  # at most SALT * (points + 2 ** PREFIX_BITS) rows
    counts, before = [0] * len(points), []
    for r in sizes:
        arc = r["_ring_arc"]
        before.append((arc, r["_ring_prefix"], r["_ring_part"], counts[arc]))
        counts[arc] += r["count"]
    n = sum(counts)
    runs = place(counts, [s for _, s in points], [n // shards + (s < n % shards) for s in range(shards)])
    offsets = spark.createDataFrame(before, "_ring_arc int, _ring_prefix long, _ring_part long, _ring_before long")
    entry = ["_ring_at", "_ring_id", "text_crc32", "_ring_salt"]
    earlier = Window.partitionBy(*cell).orderBy(*entry).rowsBetween(Window.unboundedPreceding, -1)
    entries = placed.groupBy(*cell, *entry).count().withColumn("_ring_start", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    entries = entries.join(F.broadcast(offsets), cell).select(*entry, (F.col("_ring_start") + F.col("_ring_before")).alias("_ring_start"))
    spans = spark.createDataFrame(runs, "_ring_arc int, _ring_lo long, _ring_hi long, shard int, _ring_slot long")
    number = F.row_number().over(Window.partitionBy(*entry).orderBy("size")) - 1
    ranked = placed.withColumn("_ring_n", number).join(entries, entry).withColumn("_ring_rank", F.col("_ring_n") + F.col("_ring_start"))
    found = ranked.join(F.broadcast(spans), "_ring_arc").where("_ring_rank >= _ring_lo and _ring_rank < _ring_hi")
    found = found.withColumn("slot", F.col("_ring_slot") + F.col("_ring_rank") - F.col("_ring_lo"))
    return found.select(*kept, "size", "text_crc32", "shard", "slot")


@query("op9_ring")
def op9(spark, sf_dir):
    """Shard and slot of every document; counts of the 40 shards differ by one at most."""
    found = shard_rows(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
