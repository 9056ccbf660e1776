"""Quality rules on tokeniser fertility (operator 3).

Public vocabularies measure every text: characters per token and token entropy under a byte-level BPE for many languages,
and the byte-fallback share under a piece vocabulary (bytes of characters that have no piece of their own, which it can
only spell byte by byte). The entropy is taken over consecutive blocks of ``BLOCK`` tokens and relative to the most it can
be, so it does not depend on the length of the text. Each measure has a rejection band per language: quartiles of the
documents that pass the base rule, widened by multiples (``spread``) of their distance. Quartiles come from counts per bin
(exact, mergeable, of bounded size per language); languages with fewer than ``least`` such documents use the bands of all.

Base rule: fewer than 50 words, or more than half of the words inside repeated windows of three words.

Contract: a null text has no words and fails the base rule; a null language is a language of its own; documents without
tokens have null measures; repeated rows are measured and returned each; extra columns are ignored by the measures.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, record, starts, table

VOCABULARIES = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
#: The published pre-tokenisation pattern of these byte-level vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SYMBOLS = b"#*$%&|<>"
BLOCK = 256
BIN = 0.005
#: How many distances of the quartiles a band reaches below and above them. Low entropy (repetition) and low characters
#: per token (odd spelling) are what junk shows; short clean texts lie above the others.
SPREAD = {"chars_per_token": (5.0, 8.0), "fallback_share": (5.0, 8.0), "token_entropy": (3.5, 8.0)}
LEAST = 40
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


def load(folder: str) -> tuple[dict[bytes, int], frozenset[str]]:
    """Ranks of the byte-level vocabulary and the characters of the piece vocabulary; both have a fixed size."""
    import sentencepiece

    with open(f"{folder}/{RANKS}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
    chars = {p for p in (pieces.id_to_piece(i) for i in range(pieces.get_piece_size())) if len(p) == 1}
    return ranks, frozenset(chars)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    v = len(index)
    pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
    _, back, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    twice = count[back] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def entropy(ids: np.ndarray) -> float | None:
    """Mean relative entropy of blocks of ``BLOCK`` tokens; a rest below half a block joins no other block's mean."""
    n = len(ids)
    if n < 2:
        return None
    block = np.arange(n) // BLOCK
    whole = n if n < BLOCK else n - n % BLOCK if n % BLOCK < BLOCK // 2 else n
    key = np.sort(block[:whole] * 65536 + ids[:whole])
    first = np.flatnonzero(starts(key))
    count = np.diff(np.append(first, whole))
    of = key[first] >> 16
    size = np.bincount(block[:whole])
    h = np.bincount(of, -count / size[of] * np.log2(count / size[of]))
    return float((h / np.log2(np.maximum(size, 2))).mean())


def _measure(model, key: list[str]):
    schema = pa.schema([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(n, pa.float64()) for n in MEASURES])
    built: list = []

    def run(batches):
        if not built:
            ranks, chars = model.value
            built.extend([tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), chars, {}])
        encoding, chars, known = built
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                raw = text.encode()
                words = raw.split()
                lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
                used = b"".join(words)
                ids = encoding.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
                odd = 0
                for c in set(text):
                    if c not in chars and not c.isspace():
                        odd += text.count(c) * len(c.encode())
                rows.append((
                    len(words), len(used) - (np.frombuffer(used, np.int8) < -64).sum(), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
                    len(text) / len(ids) if len(ids) else None, odd / len(raw) if raw else None, entropy(ids.astype(np.int64)),
                ))
            out = record(schema, **dict(zip(schema.names, zip(*rows) if rows else ([],) * len(schema.names))))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in key], *out.columns], [*key, *schema.names])

    return run


def measure(docs: DataFrame, folder: str = VOCABULARIES) -> DataFrame:
    """Key columns of ``docs`` (all but text), base counts and measures of every row."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(load(folder))
    key = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    found = docs.mapInArrow(_measure(model, key), f"{fields}, {counts}, " + ", ".join(f"{m} double" for m in MEASURES))
    return found.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def bands(found: DataFrame, spread: dict[str, tuple[float, float]] = SPREAD, least: int = LEAST) -> DataFrame:
    """(lang, measure, low, high) of every language, and of all under the key '*'."""
    both = found.where("not base_failed").withColumn("lang", F.explode(F.array("lang", F.lit("*"))))
    long = both.select("lang", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) / BIN).cast("long").alias("bin")) for m in MEASURES])).alias("x"))
    count = long.select("lang", "x.*").where("bin is not null").groupBy("lang", "measure", "bin").count()
    run = Window.partitionBy("lang", "measure").orderBy("bin")
    whole = Window.partitionBy("lang", "measure")
    placed = count.withColumn("upto", F.sum("count").over(run)).withColumn("n", F.sum("count").over(whole))
    at = [F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin"))).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))]
    quart = placed.groupBy("lang", "measure").agg(F.max("n").alias("n"), *at).where((F.col("n") >= least) | (F.col("lang") == "*"))
    wide = F.greatest(F.col("q3") - F.col("q1"), F.lit(2))
    below, above = (F.coalesce(*[F.when(F.col("measure") == m, F.lit(spread[m][k])) for m in MEASURES]) for k in (0, 1))
    return quart.select("lang", "measure", ((F.col("q1") - wide * below) * BIN).alias("low"), ((F.col("q3") + wide * above) * BIN).alias("high"))


def judge(docs: DataFrame, lang: str | None = "lang", folder: str = VOCABULARIES, spread: dict[str, tuple[float, float]] = SPREAD, least: int = LEAST) -> DataFrame:
    """Measures of every row of ``docs`` (its columns but the text), base_failed and kept; these replace columns of their names."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES}
    named = docs.drop(*made).withColumn("lang", F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit(""))
    found = materialize(measure(named, folder), "measures")
    limits = bands(found, spread, least).groupBy("lang").agg(*[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in MEASURES for side in ("low", "high")])
    limits = materialize(limits, "bands")
    common = limits.where("lang = '*'").first()
    joined = found.join(limits, "lang", "left")
    inside = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(F.col(f"{s}_{m}"), F.lit(common[f"{s}_{m}"] if common else None).cast("double")) for s in ("low", "high"))
        inside = inside & F.coalesce(F.col(m).between(low, high), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(*[f"{s}_{m}" for m in MEASURES for s in ("low", "high")])


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and, where there is one, lang) that the rules keep, with their columns as they were.

    Rows equal in id, language and text are judged as one; rows without an id by their text. An empty table stays empty.
    """
    given = [c for c in ("doc_id", "lang", "text") if c in docs.columns]
    rows = docs.select(F.xxhash64(*given).alias("k"), F.struct(*docs.columns).alias("row"))
    keyed = docs.select(F.xxhash64(*given).alias("k"), *given[1:])
    kept = judge(keyed, **options).where("kept").select("k").distinct()
    return rows.join(kept, "k", "left_semi").select("row.*")


@query("op3_fertility")
def op3(spark, sf_dir):
    """Base counts, measures and verdict of every document."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *MEASURES)
