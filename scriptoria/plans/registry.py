"""Registered queries: name to (query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

# Tables whose rows are expensive to process (long texts).
TEXT_TABLES = {"documents", "pages", "conversations"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(tables) -> DataFrame`` under a name, with its SQL equivalent."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


class Tables:
    """The input tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        scan = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(scan) if name in TEXT_TABLES else scan


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_corpus,
        queries_files,
        queries_graph,
        queries_lexicon,
        queries_quality,
        queries_relations,
        queries_rendering,
        queries_search,
        queries_streams,
        queries_verse,
    )
