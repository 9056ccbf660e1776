"""Benchmark decontamination by pigeonhole edit matching (operator 6).

Texts and test items are compared in lower case with runs of white space as one space. An item of n characters has an
error budget of k = n * error_rate edits (at least ``min_piece`` characters a piece). Cut into k + 1 pieces, at least one
piece survives k edits unchanged, so exact hits of pieces (Aho-Corasick over whole texts) find every place where the
item can occur within its budget. Hits of one item with overlapping search windows are one candidate; Myers'
bit-parallel algorithm computes, over the candidate's window, the least edit distance of the item to any substring.

The items are the stated query set: they are taken in blocks of at most ``block_bytes``, each sent to all tasks, and every
block meets every text. There is no cap on hits, candidates or pairs; hits in one text merge before they are verified.

Contract: null or blank items are ignored, an item that is shorter than ``min_piece`` is matched exactly; a null text has no
matches; repeated items count each by item_id (null ids too); repeated rows come back each; extra columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import query, record, table

ERROR_RATE = 0.05
MIN_PIECE = 16
BLOCK_BYTES = 2 << 20
SPACES = re.compile(r"\s+")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float = ERROR_RATE, min_piece: int = MIN_PIECE) -> int:
    return max(0, min(int(length * error_rate), length // min_piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their places."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(s, item[s:e]) for s, e in zip(cut, cut[1:])]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.m = len(item)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str, limit: int) -> tuple[int, int] | None:
        """Least distance to a substring of ``text`` and the first end of such a substring; None above ``limit``."""
        m, full, top = self.m, (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, found = full, 0, self.m, None
        get = self.peq.get
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = (ph << 1) & full, (mh << 1) & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score <= limit and (found is None or score < found[0]):
                found = (score, j + 1)
        return found


class Matcher:
    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, min_piece: int):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), error_rate, min_piece)
            for at, piece in pieces(text, k):
                hits.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, k, Pattern(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """(item_id, distance, start, end, places) of every item that occurs in the normalised text; the best place."""
        if not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for i, at in places:
                begin = end + 1 - n - at
                k = self.items[i][2]
                windows.setdefault(i, []).append((max(0, begin - k), min(len(text), begin + len(self.items[i][1]) + k)))
        out = []
        for i, spans in windows.items():
            item_id, item, k, pattern = self.items[i]
            merged: list[list[int]] = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
            places, best = 0, None
            for s, e in merged:
                part = text[s:e]
                exact = part.find(item)
                hit = (0, exact + len(item)) if exact >= 0 else pattern.best(part, k)
                if hit:
                    places += 1
                    if best is None or hit[0] < best[0]:
                        best = (hit[0], s + hit[1])
            if best:
                start = text.rfind(item, 0, best[1]) if best[0] == 0 else max(0, best[1] - len(item))
                out.append((item_id, best[0], start, best[1], places))
        return out


FOUND = pa.schema([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("places", pa.int32())])


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int | None, str]]]:
    """The items in blocks that fit a broadcast; a block is read from the table when it is its turn."""
    used = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = used.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // (block_bytes // 2)))
    for b in range(n):
        yield [tuple(r) for r in used.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def _scan(model, key: str):
    built: list = []

    def run(batches):
        if not built:
            built.append(Matcher(*model.value))
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for hit in built[0].find(normal(text)) if text else ():
                    at.append(i)
                    rows.append(hit)
            found = record(FOUND, **dict(zip(FOUND.names, zip(*rows) if rows else ([],) * 5)))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int32())), *found.columns], [key, *FOUND.names])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_piece: int = MIN_PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, end, places): every item that a document holds within the item's budget."""
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, block_bytes):
        model = spark.sparkContext.broadcast((items, error_rate, min_piece))
        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(model, "doc_id"), "doc_id long, item_id long, distance int, start long, end long, places int")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold an item; rows that share a doc_id with one are judged by their own text."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.struct(*docs.columns).alias("row"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    dirty = matches(keyed, benchmark, **options).select(F.col("doc_id").alias("k")).distinct()
    return rows.join(dirty, "k", "left_anti").select("row.*")


@query("op6_decontaminate")
def op6(spark, sf_dir):
    """Every benchmark item found in a document within its error budget."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
