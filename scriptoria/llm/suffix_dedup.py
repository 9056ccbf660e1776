"""Removal of repeated byte strings by distributed prefix doubling (operator 4).

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the corpus. As in the construction of
a suffix array by doubling, positions carry names (ranks) of the string of length L that starts there; the name at a
larger offset is made from the pair of names at p and p + offset, Spark brings equal names together, and positions whose
name is unique are done. Two things keep it affordable:

* Names are hashes of the pair instead of dense ranks, so a round needs no join back to the positions, and a task makes
  all the names below the first compared length on its own.
* The first compared length is half the threshold, and there only the minimisers of the windows of ``length`` bytes are
  compared: equal windows have the same minimiser, so a window can only repeat if the name at its minimiser does.

Rounds: (1) names of half length at minimisers; a bit table of bounded size of those seen twice is sent to all tasks.
(2) names of the whole neighbourhood of a minimiser (all windows that it stands for); the earliest document of each
name owns it, and in every other document all these windows are repeats. A second bit table tells which minimisers may
have several neighbourhoods. (3) names of full length at every window of the owners of these; all places of a name but the
earliest are marked as repeats. The text is read once more to cut. Every round is written before the next begins and its
shuffle files are deleted then, so the disk holds one round at a time. Names compared in rounds 2 and 3 have 128 bits, and entries are
dealt by both halves, so a passage that all documents share is spread by what surrounds it.

Contract: a null text is empty; documents are ordered by doc_id, rows that share one or have none by a hash of the text
(null keys first); extra columns are ignored; every input row comes back once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import U64, Texts, deal, gather, mix, numbered, query, record, scatter, starts, table, tasks

TABLE_BITS = 28  # size of the bit table of names seen twice: 32 MB at any input size; a full table only filters less
SLOT_BITS = 32
CHUNK = 1 << 18  # bytes named at a time: the arrays of a run of texts stay in the processor's cache


class Names:
    """Names of the strings at every position of a run of texts, by doubling the offset."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int):
        self.data, self.length, self.half = data, length, length // 2
        whole = np.diff(bounds) >= length
        self.begin, self.stop = bounds[:-1][whole], bounds[1:][whole] - length + 1  # windows within one text
        if self.half >= 8 and len(data) >= 8:  # strings of eight bytes are their own names
            self.name, done = np.array(np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))), 8
        else:
            self.name, done = data.astype(U64) + U64(1), 1
        while done < self.half and len(self.begin):
            step = min(done, self.half - done)
            self.name = self.double(self.name, step)
            done += step

    @staticmethod
    def double(name: np.ndarray, step: int) -> np.ndarray:
        """Names of strings longer by ``step`` from the pairs (p, p + step)."""
        a = name[: len(name) - step] * U64(0x9E3779B97F4A7C15)
        high = a >> U64(29)
        a ^= high
        a += name[step:]
        a *= U64(0xBF58476D1CE4E5B9)
        np.right_shift(a, U64(32), out=high)
        a ^= high
        return a

    def full(self) -> np.ndarray:
        return self.double(self.name, self.length - self.half)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimisers and the first and last window each stands for."""
        if not len(self.begin):
            return (np.zeros(0, np.int64),) * 3
        least = self.name & U64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=U64)
        span, wide = 1, self.length - self.half + 1
        while span < wide:
            step = min(span, wide - span)
            np.minimum(least[:-step], least[step:], out=least[:-step])
            least = least[:-step]
            span += step
        cut = np.unique(np.concatenate((np.flatnonzero(least[1:] != least[:-1]) + 1, self.begin, self.stop)))
        first, last = cut[:-1], cut[1:] - 1
        row = np.searchsorted(self.begin, first, side="right") - 1
        inside = (row >= 0) & (first < self.stop[row])
        first, last = first[inside], last[inside]
        return (least[first] & U64(0xFFFFFFFF)).astype(np.int64), first, last

    def around(self, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Names of the neighbourhoods [first, last + length), with the place of the anchor in them."""
        raw, length, digest = self.data.tobytes(), self.length, xxhash.xxh3_64_intdigest
        spans = zip(first.tolist(), last.tolist(), (anchor - first).tolist())
        return np.fromiter((digest(raw[s : e + length], k) for s, e, k in spans), U64, len(anchor))


def _slots(name: np.ndarray) -> np.ndarray:
    return mix(name ^ U64(0x5851F42D4C957F2D)) >> U64(64 - SLOT_BITS)


def _in(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    slot = (_slots(name) >> U64(SLOT_BITS - TABLE_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


RANGES = 256  # of slots; a task of round 1 works on one range at a time


def _slot_rows(parts):
    slot = np.sort(np.concatenate(parts))
    new = starts(slot)
    again = np.append(~new[1:], False)[new] if len(slot) else new
    slot = slot[new]
    rng = (slot >> U64(SLOT_BITS - 8)).astype(np.int64)
    return scatter(rng, slot=slot.astype(np.uint32), again=again.astype(np.uint8))


def _round1(length: int):
    """Slots of the names in this task, once each; those met twice come in a second array."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            texts = Texts(batch.column("text"))
            for i, j in texts.chunks(CHUNK):
                names = Names(*texts.joined(i, j), length)
                parts.append(_slots(names.name[names.anchors()[0]]))
                held += len(parts[-1])
                if held > 8 << 20:
                    yield _slot_rows(parts)
                    parts, held = [], 0
        if held:
            yield _slot_rows(parts)

    return run


def _twice(batches):
    """Bytes of the bit table whose slots were met twice in the ranges of this task."""
    width = 1 << (SLOT_BITS - 8)
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for rng, slots, again in zip(batch.column("bucket").to_pylist(), batch.column("slot").to_pylist(), batch.column("again").to_pylist()):
            seen, more = once.setdefault(rng, np.zeros(width >> 3, np.uint8)), twice.setdefault(rng, np.zeros(width >> SLOT_BITS - TABLE_BITS >> 3, np.uint8))
            slot = np.frombuffer(slots, np.uint32).astype(np.int64) & (width - 1)
            hit = (seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 | np.frombuffer(again, np.uint8)
            np.bitwise_or.at(seen, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
            s = slot[hit == 1] >> (SLOT_BITS - TABLE_BITS)
            np.bitwise_or.at(more, s >> 3, (1 << (s & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array(list(twice), pa.int32()), pa.array([x.tobytes() for x in twice.values()], pa.binary())], ["rng", "bits"])


def _first_of(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Indices of the earliest entry of each key; entries come in the order of their positions."""
    order = np.lexsort((np.arange(len(doc)), doc, *keys[::-1]))
    return order[starts(*[k[order] for k in keys])]


def _round2(length: int, bits, buckets: int):
    """For each neighbourhood in this task: its names, its earliest document here and its place in it."""

    def flush(parts):
        name, around, doc, pos = (np.concatenate(x) for x in zip(*parts))
        keep = np.sort(_first_of(doc, name, around))
        name, around = name[keep], around[keep]  # the name alone would bring all documents at the edges of one passage together
        return scatter(mix(name ^ mix(around)) % U64(buckets), name=name, around=around, doc=doc[keep], pos=pos[keep])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            texts, ords = Texts(batch.column("text")), batch.column("ord").to_numpy(zero_copy_only=False)
            for i, j in texts.chunks(CHUNK):
                data, bounds = texts.joined(i, j)
                names = Names(data, bounds, length)
                anchor, first, last = names.anchors()
                hit = _in(bits.value, names.name[anchor])
                anchor, first, last = anchor[hit], first[hit], last[hit]
                row = np.searchsorted(bounds, anchor, side="right") - 1
                parts.append((names.name[anchor], names.around(anchor, first, last), ords[i + row], (anchor - bounds[row]).astype(np.int32)))
                held += len(anchor)
                if held > 2 << 20:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _owners(buckets: int):
    """Earliest document of each neighbourhood, with the name of its anchor there."""

    def run(batches):
        got = gather(batches, name=U64, around=U64, doc=np.int64, pos=np.int32)
        keep = _first_of_pos(got["doc"], got["pos"], got["name"], got["around"])
        out = scatter(mix(got["doc"][keep].view(U64)) % U64(buckets), doc=got["doc"][keep], name=got["name"][keep], pos=got["pos"][keep])
        if out is not None:
            yield out

    return run


def _owner_names(batches):
    """Slots of the names of owned anchors, as in round 1: those met twice have several neighbourhoods."""
    for batch in batches:
        got = gather(iter([batch]), name=U64)
        if len(got["name"]):
            yield _slot_rows([_slots(got["name"])])


def _owned(buckets: int, several):
    """Marks of owned anchors: the place, and whether the anchor's name may have several neighbourhoods."""

    def run(batches):
        for batch in batches:
            got = gather(iter([batch]), doc=np.int64, name=U64, pos=np.int32)
            yield from _marked(got["doc"], got["pos"].astype(np.int64) * 2 + _in(several.value, got["name"]), buckets)

    return run


def _first_of_pos(doc: np.ndarray, pos: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((pos, doc, *keys[::-1]))
    return order[starts(*[k[order] for k in keys])]


def _marked(doc: np.ndarray, value: np.ndarray, buckets: int):
    got = scatter(mix(doc.view(U64)) % U64(buckets), doc=doc, value=value)
    if got is not None:
        yield got


MARKED = "bucket int, doc binary, value binary"


def _per_doc(batches):
    """One row per document with its marks in order."""
    got = gather(batches, doc=np.int64, value=np.int64)
    order = np.lexsort((got["value"], got["doc"]))
    doc, value = got["doc"][order], got["value"][order]
    cut = np.flatnonzero(np.append(starts(doc), True))
    for i in range(0, len(cut) - 1, 20_000):
        c = cut[i : i + 20_001]
        block = np.ascontiguousarray(value[c[0] : c[-1]])
        blobs = pa.Array.from_buffers(pa.binary(), len(c) - 1, [None, pa.py_buffer(((c - c[0]) * 8).astype(np.int32)), pa.py_buffer(block)])
        yield pa.RecordBatch.from_arrays([pa.array(doc[c[:-1]]), blobs], ["ord", "marks"])


def _pack(batches):
    """Texts in compressed form, as they go through the two joins with their marks."""
    pack = zstandard.ZstdCompressor(level=5).compress
    for batch in batches:
        texts = Texts(batch.column("text"))
        packed = pa.array([pack(texts.text(i)) for i in range(texts.n)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), packed], ["doc_id", "ord", "packed"])


def _unpacked(step):
    """``step`` over batches whose compressed texts are texts again."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress

        def plain():
            for batch in batches:
                texts = pa.array([unpack(x) for x in batch.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())
                at = batch.schema.get_field_index("packed")
                yield batch.set_column(at, "text", texts)

        yield from step(plain())

    return run


class Parts:
    """What one text repeats for certain, and the windows that round 3 decides."""

    def __init__(self, names: Names, bits: np.ndarray, own: np.ndarray):
        anchor, first, last = names.anchors()
        hit = _in(bits, names.name[anchor])
        anchor, first, last = anchor[hit], first[hit], last[hit]
        at = np.searchsorted(own >> 1, anchor)
        mine = np.zeros(len(anchor), bool)
        if len(own):
            inside = at < len(own)
            mine[inside] = (own >> 1)[at[inside]] == anchor[inside]
        several = np.zeros(len(anchor), bool)
        several[mine] = own[at[mine]] & 1 == 1
        self.first, self.last = first[~mine], last[~mine]
        f, e = first[several], last[several]
        count = e - f + 1
        self.pending = np.repeat(f - (np.cumsum(count) - count), count) + np.arange(count.sum())
        self.name = np.repeat(names.name[anchor[several]], count)


def _longs(blobs: list, at: np.ndarray) -> np.ndarray:
    """Marks of several texts (longs or nothing), each moved by its text's place."""
    some = [np.frombuffer(b, np.int64) + x for b, x in zip(blobs, at.tolist()) if b]
    return np.concatenate(some) if some else np.zeros(0, np.int64)


def _chunks(batch, length):
    """Runs of texts with their names, and the anchors that each text owns."""
    texts, own = Texts(batch.column("text")), batch.column("own").to_pylist()
    for i, j in texts.chunks(CHUNK):
        data, bounds = texts.joined(i, j)
        yield i, j, data, bounds, Names(data, bounds, length), _longs(own[i:j], bounds[:-1] * 2)


def _round3(length: int, bits, buckets: int):
    """Names of the windows in question at their first place in this task; their other places are repeats already."""

    def flush(parts):
        name, full, doc, pos = (np.concatenate(x) for x in zip(*parts))
        first = np.zeros(len(doc), bool)
        first[_first_of_pos(doc, pos, name, full)] = True
        n, f = name[first], full[first]  # the name alone would bring all documents around one passage together
        out = scatter(mix(n ^ mix(f)) % U64(buckets), name=n, full=f, doc=doc[first], pos=pos[first])
        yield _wide(out, out, None)
        again = scatter(mix(doc[~first].view(U64)) % U64(buckets), doc=doc[~first], pos=pos[~first])
        if again is not None:
            yield _wide(again, None, again)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ords = batch.column("ord").to_numpy(zero_copy_only=False)
            for i, _, _, bounds, names, own in _chunks(batch, length):
                cut = Parts(names, bits.value, own)
                if not len(cut.pending):
                    continue
                row = np.searchsorted(bounds, cut.pending, side="right") - 1
                parts.append((cut.name, names.full()[cut.pending], ords[i + row], (cut.pending - bounds[row]).astype(np.int32)))
                held += len(row)
                if held > 2 << 20:
                    yield from flush(parts)
                    parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


WIDE = "bucket int, name binary, full binary, doc binary, pos binary, again_doc binary, again_pos binary"


def _wide(rows: pa.RecordBatch, named: pa.RecordBatch | None, again: pa.RecordBatch | None) -> pa.RecordBatch:
    none = pa.nulls(rows.num_rows, pa.binary())
    first = [named.column(n) if named is not None else none for n in ("name", "full", "doc", "pos")]
    rest = [again.column(n) if again is not None else none for n in ("doc", "pos")]
    return pa.RecordBatch.from_arrays([rows.column("bucket"), *first, *rest], [x.split()[0] for x in WIDE.split(", ")])


def _repeated(buckets: int):
    """Windows that an earlier document, or an earlier place, has."""

    def run(batches):
        got = gather(batches, name=U64, full=U64, doc=np.int64, pos=np.int32, again_doc=np.int64, again_pos=np.int32)
        first = np.zeros(len(got["doc"]), bool)
        first[_first_of_pos(got["doc"], got["pos"], got["name"], got["full"])] = True
        doc, pos = (np.concatenate((got[k][~first], got[f"again_{k}"])) for k in ("doc", "pos"))
        yield from _marked(doc, pos.astype(np.int64), buckets)

    return run


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, bits, fields: str, with_text: bool):
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            again = batch.column("again").to_pylist()
            for i, j, data, bounds, names, own in _chunks(batch, length):
                cut = Parts(names, bits.value, own)
                gone = _longs(again[i:j], bounds[:-1])
                step = np.zeros(len(data) + 1, np.int32)
                np.add.at(step, np.concatenate((cut.first, gone)), 1)
                np.add.at(step, np.concatenate((cut.last, gone)) + length, -1)
                drop = np.cumsum(step)[:-1] > 0
                begins = drop.copy()
                begins[1:] &= ~drop[:-1]
                inner = bounds[1:-1][bounds[1:-1] < len(data)]
                begins[inner] = drop[inner]
                removed, spans = (np.diff(np.append(0, np.cumsum(x))[bounds]) for x in (drop, begins))
                rests = np.append(0, np.cumsum(~drop))[bounds]
                raw = data[~drop].tobytes()
                rest = [raw[s:e] for s, e in zip(rests[:-1].tolist(), rests[1:].tolist())]
                out = record(schema, n_bytes=np.diff(bounds), n_removed=removed, n_spans=spans, kept_sha256=[hashlib.sha256(x).hexdigest() for x in rest])
                arrays, heads = [batch.column(fields).slice(i, j - i), *out.columns], [fields, *schema.names]
                if with_text:
                    arrays, heads = [*arrays, pa.array(rest, pa.binary())], [*heads, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, heads)

    return run


def _seen_twice(slots: DataFrame):
    """The bit table of slots met twice, broadcast; its size is fixed."""
    spark = slots.sparkSession
    tab = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    part = len(tab) // RANGES
    ranges = materialize(deal(slots, spark).mapInArrow(_twice, "rng int, bits binary"), "twice")
    for row in ranges.toLocalIterator():  # RANGES rows of fixed size
        tab[row.rng * part : (row.rng + 1) * part] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(tab)


SLOTS = "bucket int, slot binary, again binary"


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text: also the remaining bytes (kept)."""
    spark = docs.sparkSession
    buckets = tasks(spark)
    docs = numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    bits = _seen_twice(docs.select("text").mapInArrow(_round1(length), SLOTS))
    areas = docs.select("ord", "text").mapInArrow(_round2(length, bits, buckets), "bucket int, name binary, around binary, doc binary, pos binary")
    owners = materialize(deal(areas, spark).mapInArrow(_owners(buckets), "bucket int, doc binary, name binary, pos binary"), "owners")
    several = _seen_twice(owners.select("name").mapInArrow(_owner_names, SLOTS))
    marks = owners.mapInArrow(_owned(buckets, several), MARKED)
    owned = materialize(deal(marks, spark).mapInArrow(_per_doc, "ord long, marks binary").withColumnRenamed("marks", "own"), "owned")
    packed = docs.select("doc_id", "ord", "text").mapInArrow(_pack, "doc_id long, ord long, packed binary")
    wide = packed.join(owned, "ord").select("ord", "packed", "own").mapInArrow(_unpacked(_round3(length, bits, buckets)), WIDE)
    left = deal(wide, spark).mapInArrow(_repeated(buckets), MARKED)
    again = materialize(deal(left, spark).mapInArrow(_per_doc, "ord long, marks binary").withColumnRenamed("marks", "again"), "again")
    last = packed.join(owned, "ord", "left").join(again, "ord", "left").select("doc_id", "packed", "own", "again")
    return last.mapInArrow(_unpacked(_cut(length, bits, "doc_id", with_text)), f"doc_id long, {CUT}" + ", kept binary" * with_text)


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    """Bytes of every document that a string of 100 bytes seen earlier covers."""
    return remove_repeats(table(spark, sf_dir, "documents"))
