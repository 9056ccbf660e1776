"""Packing of documents into sequences of a fixed number of tokens by minimum bin slack (operator 13).

Every text becomes token ids and an end id; only what is longer than a sequence is cut, into whole sequences with the
shorter piece first. Which pieces share a sequence depends on their lengths alone, so the plan is made from the number of
pieces per length (``capacity`` numbers, whatever the input): for each bin the longest remaining length is taken, and a
bitset subset-sum dynamic program over the lengths that remain finds the fullest combination beside it, preferring longer
pieces. The combination is removed as often as the remaining counts allow; each time at least one length runs short, so the
plan has a bounded number of combinations. Pieces are numbered per length in Spark and find their place in the plan by that
number, so no piece passes through the driver and no length is one group.

Contract: a null text is empty (its only id is the end id); the empty table gives no rows; a null ``doc_id`` is kept;
repeated rows are packed each, and which of them gets which place is not told apart; strings of special tokens in a text
are ordinary text; very long texts are tokenised whole; other columns are ignored. The ids are those of the ``tokenizers``
library for ``byte_bpe_50k.json``: they are computed from the rank file of the same vocabulary, which is faster.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize
from .common import Texts, query, record, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of this vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
END = 0

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("ids", pa.binary()),
])
PLACED = pa.schema([*(PIECES.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


# ---------------------------------------------------------------- pieces


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, the rest in front."""
    first = n - capacity * (-(-n // capacity) - 1)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of every text; ``nth`` numbers those of one length within a task.

    ``with_ids`` keeps the ids as little-endian unsigned 32-bit values.
    """
    with open(vocabulary, "rb") as lines:  # of fixed size, read where the job is defined: executors need no such file
        ranks = docs.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks.value, special_tokens={})
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), Texts(batch.column("text"))
            for i, j in texts.chunks(2 << 20):
                rows = []
                for k in range(i, j):
                    text = texts.text(k).decode()
                    tokens = np.append(encoding.encode_to_numpy(text), end).astype("<u4")
                    for piece, (start, length) in enumerate(_cut(len(tokens), capacity)):
                        body = tokens[start : start + length].tobytes()
                        rows.append((ids[k], piece, start, length, zlib.crc32(body), task, int(seen[length]), body if with_ids else None))
                        seen[length] += 1
                yield record(PIECES, **dict(zip(PIECES.names, map(list, zip(*rows)))))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ddl(PIECES))


# ---------------------------------------------------------------- plan


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Length -> count of the fullest combination within ``room``; ``available`` has (length, count), longest first.

    Bit s of the bitset says that some combination of the lengths so far sums to s. A count is taken in powers of two, so
    a length costs the logarithm of its count. Once ``room`` itself can be reached, nothing fuller exists.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, sums that could be reached before
    for length, count in available:
        left, chunk = min(count, room // length), 1
        while left:
            take = min(chunk, left)
            steps.append((length, take, reach))
            reach |= reach << (take * length) & mask
            left, chunk = left - take, chunk * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length -> pieces of it in one bin, longest first) and how many bins each fills."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    made = []
    while left:
        longest = next(iter(left))
        others = [(n, c - (n == longest)) for n, c in left.items() if c > (n == longest)]
        combination = {longest: 1}
        for n, c in fullest(others, capacity - longest).items() if capacity > longest else ():
            combination[n] = combination.get(n, 0) + c
        times = min(left[n] // c for n, c in combination.items())
        made.append((dict(sorted(combination.items(), reverse=True)), times))
        for n, c in combination.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return made


class Spans(NamedTuple):
    """For each length, numbers of pieces in order; a span of numbers belongs to the bins of one combination."""

    first: np.ndarray  # of the spans of each length (capacity + 2 bounds)
    lo: np.ndarray  # number at which a span starts
    bin: np.ndarray  # its first bin
    per_bin: np.ndarray  # pieces of this length in each of its bins
    offset: np.ndarray  # where they start within the bin


def spans(made: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> Spans:
    rows, used, bins = [], [0] * (capacity + 1), 0
    for combination, times in made:
        at = 0
        for n, c in combination.items():
            rows.append((n, used[n], bins, c, at))
            used[n] += c * times
            at += n * c
        bins += times
    rows.sort()
    length, lo, first_bin, per_bin, offset = np.array(rows, np.int64).reshape(-1, 5).T
    return Spans(np.searchsorted(length, np.arange(capacity + 2)), lo, first_bin, per_bin, offset)


def _place(plan_of: Spans, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            span = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = plan_of.first[n], plan_of.first[n + 1]
                span[own] = a + np.searchsorted(plan_of.lo[a:b], number[own], side="right") - 1
            nth = number - plan_of.lo[span]
            per = plan_of.per_bin[span]
            yield record(
                PLACED, **{c: batch.column(c) for c in columns},
                sequence_id=plan_of.bin[span] + nth // per, offset=plan_of.offset[span] + nth % per * length,
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids) of every piece; ids are null unless wanted."""
    cut = materialize(pieces(docs, capacity, vocabulary, end, with_ids), "pieces")
    parts = materialize(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    if not counts:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = parts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    columns = [n for n in PIECES.names if n not in ("task", "nth")]
    numbers = cut.join(broadcast_if_small(offsets), ["length", "task"]).select(*columns, (F.col("earlier") + F.col("nth")).alias("number"))
    return numbers.mapInArrow(_place(spans(plan(counts, capacity), capacity), columns), _ddl(PLACED))


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids array<long>, doc_ids array<long>), at most ``capacity`` ids each."""
    placed = pack(docs, capacity, vocabulary, end, with_ids=True)

    def ids(batches):
        for batch in batches:
            got = [np.frombuffer(b, "<u4").astype(np.int64).tolist() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("sequence_id", "offset", "doc_id")), pa.array(got, pa.list_(pa.int64()))], ["sequence_id", "offset", "doc_id", "ids"])

    rows = placed.select("sequence_id", "offset", "doc_id", "ids").mapInArrow(ids, "sequence_id long, offset long, doc_id long, ids array<long>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return rows.groupBy("sequence_id").agg(ordered.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


@query("op13_packing")
def op13(spark, sf_dir):
    """Sequence and place of every piece of every document, at most 2048 tokens a sequence."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
