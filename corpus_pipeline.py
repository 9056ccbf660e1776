"""From raw documents to sharded training text: each stage works on all that its predecessor kept.

Every stage takes rows with null ids, texts or languages, empty and very long texts, ties and repeated rows, empty tables
(they stay empty) and extra columns of any name, which come back as they were; what becomes of such rows stands in the
docstring of the operator that the stage calls.
"""

from __future__ import annotations

from scriptoria.llm import decontaminate, fertility, mixing, near_copies, ring
from scriptoria.llm.common import table
from scriptoria.session import materialize

SHARDS = 40


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule or a fertility band rejects go."""
    return fertility.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five words, similarity 0.8 or more) stays."""
    return near_copies.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Rates for a mixture without toxic text, at most once each: toxic documents go, others keep their total."""
    return mixing.apply(docs, table(spark, sf_dir, "labels"), {"toxic": 0.0}, max_rate=1.0, keep=("clean", "junk"))


def sharding(spark, docs, sf_dir):
    """Every document gets its shard and slot."""
    return ring.shard_rows(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("sharding", sharding),
]

#: Components of a link graph and trained classifiers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
