"""Personal data by patterns and by information-theoretic sanitisation (operator 5).

Patterns find e-mail addresses, IP addresses, card and phone numbers; these are the protected entities. A term (a word
near an entity) reveals entity e as far as knowing the term raises the probability of e: the disclosure of a term is its
pointwise mutual information with e over the information of e, log(p(e|t) / p(e)) / log(1 / p(e)), with probabilities over
the documents of the corpus. It is 1 if the term occurs with e only. Terms at or above ``disclosure`` that stand near e in
at least ``support`` different contexts (the words beside e) are sanitised wherever they occur: as spans of kind ``term``, and in the
sanitised text as [TERM], or by the generalisation given for the word.

Counts cover all documents. Only words near entities are candidates (few, as entities are); their document counts need
one more pass, filtered by a bit table of bounded size and then joined exactly by 64-bit hash of the word. A term that
many documents hold is a count, never a group; copies of a context count once.

Contract: a null text is empty; base spans follow the patterns leftmost without overlaps, a match that fails its check is
dropped without a retry; documents equal in doc_id and text share their term spans; repeated rows come back each; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, record, table

KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: The patterns that could start anywhere in a run, held to its first character.
RUNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])" + PATTERNS["email"].pattern),
    "ip": re.compile(r"(?<![0-9])" + PATTERNS["ip"].pattern),
}
WORD = re.compile(r"[^\W\d_]{3,}")
TOKEN = re.compile(r"\S+")
NEAR = 6  # words on each side of an entity
SUPPORT = 3
DISCLOSURE = 0.85
BITS = 26


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def leftmost(kind: str, pattern: re.Pattern, text: str):
    """Leftmost non-overlapping matches in linear time.

    Within a run of first characters an e-mail or ip address that can start at all can start at the run's first one, or
    where the match before ended, so only these places are tried.
    """
    if kind not in RUNS:
        yield from pattern.finditer(text)
        return
    at = 0
    while m := pattern.match(text, at) or RUNS[kind].search(text, at):
        yield m
        at = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        out.extend((m.start(), k, m.end()) for m in leftmost(kind, pattern, text) if valid(kind, m[0]))
    return sorted(out)


def name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def term_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.lower().encode()) - (1 << 63)


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(entity, context, term) as hashes for the words near each entity; words inside entities are none."""
    out = []
    for s, k, e in spans:
        left = [m for m in TOKEN.finditer(text, max(0, s - 40 * NEAR), s)][-NEAR:]
        right = []
        for m in TOKEN.finditer(text, e):
            right.append(m)
            if len(right) == NEAR:
                break
        around = [m[0].lower() for m in [*left, *right]]
        beside = [m[0].lower() for m in [*left[-1:], *right[:1]]]  # copies with edits further off are one context
        context = xxhash.xxh64_intdigest(" ".join(beside).encode()) - (1 << 63)
        entity = xxhash.xxh64_intdigest(f"{k}:{text[s:e].lower()}".encode()) - (1 << 63)
        out.extend((entity, context, term_hash(w)) for w in {w for x in around if "@" not in x for w in WORD.findall(x)})
    return out


BASE = pa.schema(
    [("doc_id", pa.int64()), ("h", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("base", pa.string())]
    + [("near", pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.int64())])))]
)


def _base(batches):
    for batch in batches:
        rows = []
        for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
            spans = base_spans(text) if text else []
            counts = Counter(k for _, k, _ in spans)
            listed = name(spans)
            near = [{"entity": e, "context": c, "term": t} for e, c, t in contexts(text, spans)] if spans else []
            rows.append((doc_id, h, *(counts[k] for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), listed, near))
        yield record(BASE, **dict(zip(BASE.names, zip(*rows) if rows else ([],) * len(BASE.names))))


def _bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes; the words of the table are made by Spark and are at most 2 ** (BITS - 6)."""
    slot = f"shiftrightunsigned({column}, {64 - BITS})"
    words = hashes.groupBy(F.expr(f"shiftright({slot}, 5)").alias("w"))
    rows = words.agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 31 as int)))").alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[rows.column("w").to_numpy().astype(np.int64)] = rows.column("b").to_numpy().astype(np.uint32)
    return out


def _hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1


class Candidates:
    """Which words the bit table holds; words met before are not hashed again while the memo has room."""

    def __init__(self, bits: np.ndarray, room: int = 300_000):
        self.bits, self.room, self.memo = bits, room, {}

    def among(self, words: set[str]) -> dict[str, int]:
        if len(self.memo) > self.room:
            self.memo.clear()
        new = [w for w in words if w not in self.memo]
        if new:
            hashes = np.fromiter((term_hash(w) for w in new), np.int64, len(new))
            self.memo.update((w, h if x else None) for w, h, x in zip(new, hashes.tolist(), _hit(self.bits, hashes).tolist()))
        return {w: h for w in words if (h := self.memo[w]) is not None}


def _document_counts(bits):
    """How many documents of this task hold each candidate."""

    def run(batches):
        total: Counter = Counter()
        candidates = Candidates(bits.value)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    total.update(candidates.among({w.lower() for w in set(WORD.findall(text))}).values())
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], ["term", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return run


def _places(bits):
    """Where the words of the bit table stand."""
    names = ["doc_id", "h", "term", "start", "end"]

    def run(batches):
        candidates = Candidates(bits.value)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text"))):
                held = candidates.among({w.lower() for w in set(WORD.findall(text))}) if text else {}
                if held:
                    found = ((m.start(), m.end(), held.get(m[0].lower())) for m in WORD.finditer(text))
                    out.extend((doc_id, h, t, s, e) for s, e, t in found if t is not None)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 5)], names)

    return run


def disclosing(base: DataFrame, docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, entity, n_both, n_term, n_entity, score) of the terms that reveal an entity."""
    spark = docs.sparkSession
    flat = base.select("doc_id", "h", F.explode("near").alias("x")).select("doc_id", "h", "x.*")
    one = flat.select("entity", "term", "context").distinct()
    often = one.groupBy("entity", "term").count().where(F.col("count") >= support).select("entity", "term")
    both = flat.join(often, ["entity", "term"]).select("entity", "term", "doc_id", "h").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    both = materialize(both, "pairs")
    entity = flat.select("entity", "doc_id", "h").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = both.select("term").distinct()
    if not terms.limit(1).count():
        return both.select("term", "entity", "n_both", F.lit(0).cast("long").alias("n_term"), F.lit(0).cast("long").alias("n_entity"), F.lit(0.0).alias("score"))
    bits = spark.sparkContext.broadcast(_bit_table(terms, "term"))
    n = docs.count()
    held = docs.select("text").mapInArrow(_document_counts(bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    scored = both.join(held, "term").join(entity, "entity")
    score = F.log(F.col("n_both") * F.lit(float(n)) / (F.col("n_term") * F.col("n_entity"))) / F.log(F.lit(float(n)) / F.col("n_entity"))
    return materialize(scored.withColumn("score", F.least(F.lit(1.0), score)).where(F.col("score") >= disclosure).select("term", "entity", "n_both", "n_term", "n_entity", "score"), "disclosing")


def _merge(base: str, terms: list) -> str:
    """All spans in order of start, then kind; terms inside a base span are part of it."""
    spans = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
    spans += [(t["start"], 4, t["end"]) for t in terms or () if not any(s < t["end"] and t["start"] < e for s, _, e in spans)]
    return name(sorted(set(spans)))


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, with_terms: bool = False) -> DataFrame:
    """doc_id, h (hash of the text), counts, base_sha256, base and spans of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    base = materialize(docs.mapInArrow(_base, f"doc_id long, h long, {counts}, base_sha256 string, base string, near array<struct<entity:bigint,context:bigint,term:bigint>>"), "entities")
    terms = disclosing(base, docs, support, disclosure)
    words = terms.select("term").distinct()
    plain = base.drop("near")
    if not words.limit(1).count():
        return plain.withColumn("spans", F.col("base"))
    bits = spark.sparkContext.broadcast(_bit_table(words, "term"))
    places = docs.mapInArrow(_places(bits), "doc_id long, h long, term long, start long, end long").join(words, "term", "left_semi").distinct()
    listed = places.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("terms"))
    joined = plain.alias("a").join(listed.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.h = b.h"), "left").select("a.*", "b.terms")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", spans string"

    def merged(batches):
        for batch in batches:
            spans = [_merge(b, t) if t else b for b, t in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist())]
            kept = [c for c in batch.schema.names if c != "terms"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(spans, pa.string())], [*kept, "spans"])

    return joined.mapInArrow(merged, schema)


def sanitise(docs: DataFrame, general: dict[str, str] | None = None, **options) -> DataFrame:
    """(doc_id, text, spans): every span replaced by its kind in brackets, a term by its generalisation if one is given."""
    found = find(docs, **options).select("doc_id", "h", "spans").dropDuplicates(["doc_id", "h"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    joined = keyed.alias("a").join(found.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.h = b.h")).select("a.doc_id", "a.text", "b.spans")
    wider = {k.lower(): v for k, v in (general or {}).items()}

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for kind, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
                    if s >= at:
                        parts += [text[at:s], wider.get(text[s:e].lower(), f"[{kind.upper()}]") if kind == "term" else f"[{kind.upper()}]"]
                        at = e
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), batch.column("spans")], ["doc_id", "text", "spans"])

    return joined.mapInArrow(run, "doc_id long, text string, spans string")


@query("op5_private")
def op5(spark, sf_dir):
    """Personal data and disclosing terms in every document."""
    return find(table(spark, sf_dir, "documents")).select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans")
