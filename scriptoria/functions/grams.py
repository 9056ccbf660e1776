"""Windows of characters in Arrow batches: numpy over the code points of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

CHUNK = 1 << 20  # bytes of text that are looked at together; a longer text is a chunk of its own
STEP = np.uint64(0x9E3779B97F4A7C15)  # odd: base of the window hashes


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (with the end)."""
    joined = "".join(texts)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of pieces of a column; a null is an empty text."""
    at, held, size = 0, [], 0
    for i, text in enumerate(column.to_pylist()):
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _trigram_keys(cps: np.ndarray) -> np.ndarray:
    wide = cps.astype(np.int64)
    return wide[:-2] << 42 | wide[1:-1] << 21 | wide[2:]


def _rows(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of ``length`` lies in one text, and the number of this text."""
    counts = np.maximum(np.diff(starts) - length + 1, 0)
    of = np.repeat(np.arange(len(counts)), counts)
    return starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts), of


def _terms(keys: np.ndarray) -> pa.Array:
    chars = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], axis=1).astype(np.uint32)
    joined = chars.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([joined[i : i + 3] for i in range(0, len(joined), 3)], pa.string())


def _counted(texts: list[str], groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(trigram, group, occurrences) of texts, each of which belongs to a group."""
    cps, starts = code_points(texts)
    places, of = _rows(starts, 3)
    if not len(places):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = pa.array(_trigram_keys(cps)[places]).dictionary_encode()
    both = np.sort(groups[of].astype(np.int64) << 32 | found.indices.to_numpy())
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    tf = np.diff(np.append(first, len(both)))
    return _terms(found.dictionary.to_numpy()).take(pa.array(both[first] & 0xFFFFFFFF)), both[first] >> 32, tf


def count_trigrams(rows: DataFrame, doc: str, text: str) -> DataFrame:
    """``(term, doc, tf)`` of ``rows`` whose equal documents stand next to each other in one partition.

    The trigrams of a document are counted in its task, so no trigram is shuffled.
    """
    schema = StructType([StructField("term", StringType()), rows.schema[doc], StructField("tf", LongType())])

    def out(docs: pa.Array, texts: list[str], groups: np.ndarray) -> pa.RecordBatch:
        terms, of, tf = _counted(texts, groups)
        return pa.RecordBatch.from_arrays([terms, docs.take(pa.array(of)), pa.array(tf, pa.int64())], ["term", doc, "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # texts of the last document, which may go on
        for batch in batches:
            docs = batch.column(0)
            for at, texts in _chunks(batch.column(1)):
                here = docs.slice(at, len(texts))
                codes = here.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new = np.concatenate([[not (held and here.slice(0, 1).equals(last))], codes[1:] != codes[:-1]])
                cuts = np.flatnonzero(new)
                if len(cuts):  # another document begins, so those before it are whole
                    end = cuts[-1]
                    owners = pa.concat_arrays([here.slice(0, 1) if last is None else last, here.take(pa.array(cuts[:-1]))])
                    yield out(owners, held + texts[:end], np.concatenate([np.zeros(len(held), np.int64), np.cumsum(new)[:end]]))
                    held = []
                    texts = texts[end:]
                held = held + texts
                last = here.slice(len(here) - 1, 1)
        if held:
            yield out(last, held, np.zeros(len(held), np.int64))

    return rows.select(doc, text).mapInArrow(run, schema)


def _hash(cps: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` characters of each row."""
    h = np.zeros(len(cps), np.uint64)
    for k in range(size):
        h = h * STEP + cps[:, k] + np.uint64(1)
    return h


def _needle_table(needles: list[str], prefix: int) -> tuple[np.ndarray, list[tuple]]:
    """Hashes of the first characters; for each length the hashes, characters and texts of its needles, by hash."""
    sizes: dict[int, list[str]] = {}
    for n in needles:
        sizes.setdefault(len(n), []).append(n)
    table, anchors = [], np.zeros(0, np.uint64)
    for size, names in sorted(sizes.items()):
        cps = code_points(names)[0].reshape(len(names), size)
        order = np.argsort(_hash(cps, size), kind="stable")
        table.append((size, _hash(cps, size)[order], cps[order], np.array(names, object)[order]))
        anchors = np.union1d(anchors, _hash(cps, prefix))
    return anchors, table


def _found(cps: np.ndarray, starts: np.ndarray, prefix: int, anchors: np.ndarray, table: list[tuple]) -> Iterator[tuple]:
    """(text, place in it, needle) of all occurrences of the needles of a table that is not empty."""

    def among(values: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == h)

    places, of = _rows(starts, prefix)
    h = np.zeros(len(places), np.uint64)
    for k in range(prefix):
        h = h * STEP + cps[places + k] + np.uint64(1)
    near, done = among(anchors, np.searchsorted(anchors, h), h), prefix
    places, of, h = places[near], of[near], h[near]
    for size, hashes, chars, needles in table:  # lengths rise
        inside = places + size <= starts[of + 1]
        places, of, h = places[inside], of[inside], h[inside]
        for k in range(done, size):
            h = h * STEP + cps[places + k] + np.uint64(1)
        done, at, some = size, np.searchsorted(hashes, h), np.arange(len(h))
        while len(some := some[among(hashes, at[some], h[some])]):  # needles of one hash stand together
            same = np.ones(len(some), bool)
            for k in range(size):
                same &= cps[places[some] + k] == chars[at[some], k]
            hit = some[same]
            yield of[hit], places[hit] - starts[of[hit]], needles[at[hit]]
            at[some] += 1


def find_needles(texts: DataFrame, ids: list[str], text: str, needles: list[str], name: str, prefix: int) -> DataFrame:
    """``(ids, pos, name)`` of every occurrence of the needles, which go to all tasks."""
    sent = texts.sparkSession.sparkContext.broadcast(_needle_table(needles, prefix))
    schema = StructType([*(texts.schema[i] for i in ids), StructField("pos", IntegerType()), StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, table = sent.value
        for batch in batches if table else ():
            for at, some in _chunks(batch.column(len(ids))):
                for of, pos, found in _found(*code_points(some), prefix, anchors, table):
                    keys = [batch.column(k).take(pa.array(of + at)) for k in range(len(ids))]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), pa.array(found, pa.string())], [*ids, "pos", name])

    return texts.select(*ids, F.col(text).cast("string")).mapInArrow(run, schema)
