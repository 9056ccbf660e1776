"""Shared helpers: table access, bounded text chunks, and numpy arrays as shuffle payload.

Rows that only exist to be grouped (names of positions, fingerprint variants) are shuffled as arrays: a map task sorts
its entries by bucket and emits one row per bucket whose binary columns hold the arrays. Spark deals the buckets out to
tasks, and a task works on the arrays of its share. An entry costs its own bytes and no row overhead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

U64 = np.uint64
SPACE = "[^\\x20\\x09-\\x0D]+"  # a word is a run of these


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under a name, with its SQL equivalent where there is one."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts of an Arrow batch


class Texts:
    """The texts of one Arrow column as UTF-8 bytes without copies; a null is an empty text."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        self.ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.n = len(column)

    def chunks(self, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
        """Row ranges of about ``max_bytes``; a longer text is a range of its own."""
        i = 0
        while i < self.n:
            j = int(np.searchsorted(self.ends, self.ends[i] + max_bytes, side="right")) - 1
            j = min(max(j, i + 1), self.n)
            yield i, j
            i = j

    def joined(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts i..j-1 and their j-i+1 bounds within them."""
        lo = self.ends[i]
        return self.data[lo : self.ends[j]], self.ends[i : j + 1] - lo

    def text(self, i: int) -> bytes:
        return self.data[self.ends[i] : self.ends[i + 1]].tobytes()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


# ---------------------------------------------------------------- arrays as shuffle payload


def scatter(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch | None:
    """One row per bucket: its number and, for each column, the bytes of the bucket's entries in their order."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
    names, arrays = ["bucket"], [pa.array(b[cut[:-1]].astype(np.int32))]
    for name, c in columns.items():
        c = np.ascontiguousarray(c[order])
        offsets = (cut * c.itemsize).astype(np.int32)
        names.append(name)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(c)]))
    return pa.RecordBatch.from_arrays(arrays, names)


def deal(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Deal scattered rows out so that each bucket is in one task."""
    n = tasks(spark)
    return df.repartitionById(n, (F.col("bucket") % n).cast("int"))


def gather(batches: Iterator[pa.RecordBatch], **types) -> dict[str, np.ndarray]:
    """The entries of all rows that a task got."""
    parts: dict[str, list] = {name: [] for name in types}
    for batch in batches:
        for name, kind in types.items():
            column = batch.column(name).cast(pa.large_binary())
            _, offsets, data = column.buffers()
            if len(column) and data is not None:
                ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
                parts[name].append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].copy().view(kind))
    return {name: np.concatenate(p) if p else np.zeros(0, types[name]) for name, p in parts.items()}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of a multiplicative hash)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns sorted together."""
    new = np.zeros(len(columns[0]), bool)
    if len(new):
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def numbered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a unique ``ord``: the key itself where it is unique and never null, else its rank.

    Rows that share a key, or have none, are ordered by a hash of the text (null keys first); rows that are equal in
    both are interchangeable.
    """
    from ..session import materialize

    twice = docs.groupBy(key).count().where("count > 1").limit(1)
    if not docs.where(F.col(key).isNull()).limit(1).count() and not twice.count():
        return docs.withColumn("ord", F.col(key).cast("long"))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(text).asc()]
    return materialize(docs.repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id()), "ord")
