"""Prediction by partial matching over bytes, trained on one part of a corpus and scored on all of it (operator 1).

The model is the byte-context trie of order ``order``: for every context of up to that many bytes the counts of the
symbols that followed it. Coding a byte starts at the longest context that training met. A symbol seen there has
probability (2c - 1) / 2n, an unseen one escapes with d / 2n (n: occurrences, d: distinct symbols) to the context that
is one byte shorter, where the symbols of the longer one are excluded from n and d; a shorter context counts a symbol
once for each longer context it followed (update exclusion). Below order 0 all symbols not yet excluded are equally
likely. A text is coded after ``order`` start marks and closed by an end mark (bytes 0xFE and 0xFF,
which UTF-8 never uses), so the probabilities of all texts sum to one.

Training counts the windows of order + 1 bytes of every training text: counts are merged in each task and summed by
Spark. A window determines its code length, so scoring needs one lookup per byte, in a hash table of the windows of
training; windows not met in training take the escape chain. The trie is cut into blocks by the last two context bytes
(all contexts longer than one byte and their suffixes of two or more bytes fall into one block, shorter contexts are in
every block); a block has at most ``block`` windows, or one such group. Blocks are broadcast one after another and each
adds its windows' share to every text, so no task or driver ever holds the whole trie, at any input size.

The base line needs the training count of each token. Tokens that make up at least 1 / ``heads`` of all occurrences
are at most ``heads`` many and are broadcast; all others are counted per document and joined. Both paths are exact.

Contract: a null text is empty (one end mark); a null doc_id is trained on as if its text form were empty; repeated
rows are scored and counted each; with no training text at all every symbol is equally likely; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import U64, Texts, deal, gather, mix, query, record, scatter, starts, table, tasks

START, END = 0xFE, 0xFF
ORDER = 5  # at least 3
HEADS = 1 << 18
BLOCK = 4 << 20
FOLDS, HELD = 5, 1


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD


def windows(data: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of order + 1 bytes that end at each byte of each text and at its end mark, and the texts' bounds in them."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    gap = np.array([END] + [START] * order, np.uint8)
    framed = np.empty(len(data) + len(gap) * (n + 1), np.uint8)
    ends = bounds[1:] + order + np.arange(n) * len(gap)  # of the end marks
    mask = np.ones(len(framed), bool)
    for k in range(order):
        mask[np.append(0, ends[:-1] + 1) + k] = False
    mask[ends] = False
    tail = order + len(data) + (order + 1) * max(n - 1, 0) + (n > 0)
    framed, mask = framed[:tail], mask[:tail]
    framed[mask] = lower
    framed[~mask] = START
    framed[ends] = END
    word = np.zeros(max(len(framed) - order, 0), U64)
    for k in range(order + 1):
        word = (word << U64(8)) | framed[k : k + len(word)].astype(U64)
    at = ends - order  # index of the window that ends at each end mark
    lengths = sizes + 1
    keep = np.repeat(at - lengths + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    return word[keep], np.append(0, np.cumsum(lengths))


def merge(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of their counts."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(starts(keys))
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(starts(keys))
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts).astype(np.int64)


TRAINED = "bucket int, key binary, n binary, token binary, times long"


def _train(order: int, buckets: int):
    """Window counts as arrays by bucket, and token counts as rows (bucket null)."""
    names = ["bucket", "key", "n", "token", "times"]

    def packed(keys, counts):
        got = scatter(mix(keys) % U64(buckets), key=keys, n=counts)
        n = got.num_rows
        return pa.RecordBatch.from_arrays([*got.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)

    def counted(tokens):
        n = len(tokens)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(list(tokens), pa.binary()), pa.array(list(tokens.values()), pa.int64())], names)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tokens: Counter = Counter()
        for batch in batches:
            learn = np.array([not is_held_out(x) for x in batch.column("doc_id").to_pylist()], bool)
            texts = Texts(batch.column("text").filter(pa.array(learn)))
            for i, j in texts.chunks():
                keys, _ = windows(*texts.joined(i, j), order)
                held.append(merge(keys))
                for k in range(i, j):
                    tokens.update(texts.text(k).lower().split())
                if sum(len(k) for k, _ in held) > 4 << 20:
                    held = [merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) > 3 << 20:
                        yield packed(*held.pop())
                if len(tokens) > 600_000:
                    yield counted(tokens)
                    tokens = Counter()
        if held:
            keys, counts = merge(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            if len(keys):
                yield packed(keys, counts)
        if tokens:
            yield counted(tokens)

    return run


def _sum(batches):
    got = gather(batches, key=U64, n=np.int64)
    keys, counts = merge(got["key"], got["n"])
    for i in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(counts[i : i + (1 << 16)])], ["key", "n"])


class Level:
    """Symbol and context counts of one order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        context = keys >> U64(8)
        first = np.flatnonzero(starts(context))
        self.contexts = context[first]
        self.total = np.add.reduceat(counts, first) if len(first) else counts
        self.distinct = np.diff(np.append(first, len(keys)))

    @staticmethod
    def find(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted key, -1 if absent."""
        if not len(table):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, at, -1)


class Trie:
    """The levels of order 0 to ``order`` and the code length (log10) of any window."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: list[tuple[np.ndarray, np.ndarray]]):
        """low: counts of orders 0 and 1 over the whole corpus; the rest follows from this block's windows."""
        self.order = order
        own = [(keys, counts)]
        for k in range(order - 1, len(low) - 1, -1):
            own.append(merge(own[-1][0] & U64((1 << 8 * (k + 1)) - 1)))
        self.levels = [Level(*x) for x in [*low, *own[::-1]]]
        for k in range(1, order + 1):  # what a context's symbols take up in the context that is one byte shorter
            upper, below = self.levels[k], self.levels[k - 1]
            at = Level.find(below.keys, upper.keys & U64((1 << 8 * k) - 1))
            first = np.flatnonzero(starts(upper.keys >> U64(8)))
            upper.covered = np.add.reduceat(below.counts[at], first) if len(first) else first
        top = self.levels[order]
        self.hit = np.zeros(0, np.float32)
        if len(top.keys):
            group = np.cumsum(starts(top.keys >> U64(8))) - 1
            self.hit = np.log10((2 * top.counts - 1) / (2 * top.total[group])).astype(np.float32)
        size = 1 << max(4, int(len(top.keys) * 2).bit_length())
        self.shift = U64(64 - size.bit_length() + 1)
        self.slots, self.value = np.full(size, np.iinfo(np.uint64).max, U64), np.zeros(size, np.float32)
        left, at, spin = np.arange(len(top.keys)), self.slot(top.keys), size - 1
        while len(left):
            free = self.slots[at] == np.iinfo(np.uint64).max
            tried, where = left[free], at[free]
            self.slots[where] = top.keys[tried]
            self.value[where] = self.hit[tried]
            won = self.slots[at] == top.keys[left]
            left, at = left[~won], (at[~won] + 1) & spin

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last byte after the bytes before it."""
        out = np.zeros(len(keys), np.float64)
        left, at, spin = np.arange(len(keys)), self.slot(keys), len(self.slots) - 1
        want, missing = keys, []
        while len(left):
            got = self.slots[at]
            hit = got == want
            out[left[hit]] = self.value[at[hit]]
            gone = got == np.iinfo(np.uint64).max
            missing.append(left[gone])
            more = ~(hit | gone)
            left, at, want = left[more], (at[more] + 1) & spin, want[more]
        miss = np.concatenate(missing) if missing else left
        if len(miss):
            unique, back = np.unique(keys[miss], return_inverse=True)
            out[miss] = self.escape(unique)[back]
        return out

    def escape(self, keys: np.ndarray) -> np.ndarray:
        """Code of windows that training did not meet."""
        n = len(keys)
        out, open_ = np.zeros(n), np.ones(n, bool)
        covered, excluded = np.zeros(n, np.int64), np.zeros(n, np.int64)  # in the level at hand, by the longer context
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            part = keys & U64((1 << 8 * (k + 1)) - 1)
            ctx = Level.find(level.contexts, part >> U64(8))
            sym = Level.find(level.keys, part)
            seen = open_ & (ctx >= 0)
            if not len(level.keys):
                continue
            total = np.where(seen, level.total[ctx], 0) - covered
            fresh = np.where(seen, level.distinct[ctx], 0) - excluded
            hit = seen & (sym >= 0)
            out[hit] += np.log10((2 * level.counts[sym[hit]] - 1) / (2 * total[hit]))
            open_ &= ~hit
            go = seen & ~hit & (fresh > 0)  # where nothing is left to predict, the escape is certain
            out[go] += np.log10(fresh[go] / (2 * total[go]))
            away = seen & ~hit
            covered = np.where(away, level.covered[ctx], 0) if k else covered
            excluded = np.where(away, level.distinct[ctx], 0)
        out[open_] -= np.log10(256 - excluded[open_])
        return out


def _low(trained: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of orders 0 and 1 (at most 65,536 of them): a symbol counts once for each context that is a byte longer."""
    rows = trained.select(F.expr(f"key & {(1 << 24) - 1}L").alias("key")).distinct().groupBy(F.expr("key & 65535L").alias("key")).count().toArrow()
    one = merge(rows.column("key").to_numpy().view(U64), rows.column("count").to_numpy())
    return [merge(one[0] & U64(255)), one]


def _blocks(trained: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of groups (last two context bytes, 65,536 in all) with at most ``block`` windows each, or one group."""
    rows = trained.groupBy(F.expr("shiftright(key, 8) & 65535L").alias("g")).count().orderBy("g").collect()
    cuts, size = [0], 0
    for r in rows:
        if size and size + r["count"] > block:
            cuts.append(r.g)
            size = 0
        size += r["count"]
    return list(zip(cuts, [*cuts[1:], 65536]))


_latest: list = [None, None]  # the model a worker built last, so that its tasks share it


def _trie(value, order: int) -> Trie:
    if _latest[0] is not value:
        keys, counts, low, _ = value
        _latest[:] = [value, Trie(keys, counts, order, low)]
    return _latest[1]


PART = "uid long, part double"
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, logs double, part double, tail array<struct<token:binary,times:bigint>>"


def _score(order: int, model):
    """Share of one block in the score of each text."""

    def values(texts, i, j):
        (lo, hi), trie = model.value[3], _trie(model.value, order)
        word, bounds = windows(*texts.joined(i, j), order)
        if (lo, hi) == (0, 65536):
            return np.add.reduceat(trie.score(word), bounds[:-1])
        group = (word >> U64(8)) & U64(65535)
        own = (group >= U64(lo)) & (group < U64(hi))
        value = np.zeros(len(word))
        value[own] = trie.score(word[own])
        return np.add.reduceat(value, bounds[:-1])

    def run(batches):
        for batch in batches:
            texts = Texts(batch.column("text"))
            for i, j in texts.chunks(1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("uid").slice(i, j - i), pa.array(values(texts, i, j))], ["uid", "part"])

    run.values = values
    return run


def _score_first(order: int, model, tokens):
    """The first block's share, the base score over frequent tokens, and the other tokens of each text."""
    values = _score(order, model).values

    def run(batches):
        words, counts = tokens.value
        index = dict(zip(words, range(len(words))))
        none = len(words)
        logs = np.append(np.log10(counts + 0.5), 0.0)
        for batch in batches:
            texts = Texts(batch.column("text"))
            for i, j in texts.chunks(1 << 20):
                known, total, base, tail, times, cuts = [], [], [], [], [], [0]
                for k in range(i, j):
                    words = texts.text(k).lower().split()
                    at = np.fromiter((index.get(w, none) for w in words), np.int64, len(words))
                    rest = Counter([words[x] for x in np.flatnonzero(at == none).tolist()])
                    total.append(len(words) + 1)
                    known.append(int((at < none).sum()))
                    base.append(float(logs[at].sum()))
                    tail.extend(rest)
                    times.extend(rest.values())
                    cuts.append(len(tail))
                ids = batch.column("doc_id").slice(i, j - i)
                held = [is_held_out(x) for x in ids.to_pylist()]
                pairs = pa.StructArray.from_arrays([pa.array(tail, pa.binary()), pa.array(times, pa.int64())], ["token", "times"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(i, j - i), ids, pa.array(held), pa.array(total, pa.int64()), pa.array(known, pa.int64()), pa.array(np.diff(texts.ends[i : j + 1])), pa.array(base, pa.float64()), pa.array(values(texts, i, j)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)],
                    ["uid", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "logs", "part", "tail"],
                )

    return run


def score_texts(docs: DataFrame, order: int = ORDER, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    both = materialize(docs.mapInArrow(_train(order, tasks(spark)), TRAINED), "trained")
    trained = materialize(deal(both.where("bucket is not null").select("bucket", "key", "n"), spark).mapInArrow(_sum, "key long, n long"), "trie")
    words = materialize(both.where("bucket is null").groupBy("token").agg(F.sum("times").alias("c")), "tokens")
    fold = F.expr(f"pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), {FOLDS})")
    learned = docs.where(fold != HELD).count()
    occurrences, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = occurrences + learned, distinct + (learned > 0)
    floor = math.log10(n + 0.5 * (v + 1))
    head = words.where(F.col("c") >= max(1, -(-occurrences // heads))).toArrow()  # at most `heads` rows
    tokens = spark.sparkContext.broadcast((head.column("token").to_pylist(), head.column("c").to_numpy()))
    low = _low(trained)
    blocks = _blocks(trained, block)
    texts = docs.withColumn("uid", F.monotonically_increasing_id())
    if len(blocks) > 1:  # several passes must agree on the numbers
        texts = materialize(texts, "texts")
    parts = []
    for lo, hi in blocks:
        rows = trained.where(F.expr(f"(shiftright(key, 8) & 65535L) between {lo} and {hi - 1}")).toArrow()
        keys, counts = merge(rows.column("key").to_numpy().view(U64), rows.column("n").to_numpy())
        model = spark.sparkContext.broadcast((keys, counts, low, (lo, hi)))
        if not parts:
            parts.append(materialize(texts.mapInArrow(_score_first(order, model, tokens), SCORED), "scored"))
        else:
            parts.append(materialize(texts.select("uid", "text").mapInArrow(_score(order, model), PART), "part"))
    first, rest = parts[0], parts[1:]
    rare = first.select("uid", F.explode("tail").alias("t")).select("uid", "t.token", "t.times").join(words, "token", "left")
    worth = F.expr("times * log10(coalesce(c, 0) + 0.5)")
    added = rare.groupBy("uid").agg(F.sum(worth).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = first.drop("tail").join(added, "uid", "left")
    score = F.col("part")
    if rest:
        union = rest[0]
        for p in rest[1:]:
            union = union.unionByName(p)
        out = out.join(union.groupBy("uid").agg(F.sum("part").alias("others")), "uid", "left")
        score = score + F.coalesce("others", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0)) + (1 if learned else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) + math.log10(learned + 0.5) - F.col("n_tokens") * floor).alias("base_score"),
        score.alias("score"),
        (score / -math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


@query("op1_ppm")
def op1(spark, sf_dir):
    """Held-out and training scores of every document under a byte model learned from four fifths of them."""
    return score_texts(table(spark, sf_dir, "documents"))
