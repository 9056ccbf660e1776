"""Filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compat import as_col, contains_any, null_if_empty, strip
from .text import strip_tags

# File suffixes of embedded media that are not head-words.
MEDIA_SUFFIXES = [".png", ".ico", ".bmp", ".gif", ".jpg", ".css", ".js"]


def like_literal(q: Column | str) -> Column:
    """User input with LIKE wildcards escaped, so that it matches as plain text."""
    return F.regexp_replace(as_col(q), r"([\\%_])", r"\\$1")


def fold_ascii(col: Column | str) -> Column:
    """Case folding of A-Z only."""
    return F.translate(as_col(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def match_text(col: Column | str, q: Column | str, mode: str = "contains") -> Column:
    """Literal, ASCII-case-insensitive match: ``prefix``, ``contains`` or ``exact``."""
    c, n = fold_ascii(col), fold_ascii(q)
    return {"prefix": F.startswith(c, n), "contains": F.contains(c, n), "exact": c == n}[mode]


def all_of(*conds: Column | None) -> Column:
    """Conjunction of the conditions that are given; true when none is."""
    return reduce(lambda a, b: a & b, [c for c in conds if c is not None], F.lit(True))


def has_tag(col: Column | str, tag: str) -> Column:
    return F.contains(F.coalesce(as_col(col), F.lit("")), F.lit(tag))


def located(df: DataFrame, lat: str = "latitude") -> DataFrame:
    return df.filter(F.col(lat).isNotNull())


def any_keyword(col: Column | str, words) -> Column:
    return contains_any(col, words)


def id_between(col: Column | str, ranges, canon: str = "T") -> Column:
    """The leading number of an id lies in one of the inclusive ranges."""
    n = F.regexp_extract(as_col(col), rf"^{canon}(\d+)", 1).try_cast("int")
    hit = reduce(lambda a, b: a | b, [n.between(lo, hi) for lo, hi in ranges])
    return F.coalesce(hit, F.lit(False))


def drop_junk_terms(df: DataFrame, term: str = "term", definition: str = "definition") -> DataFrame:
    """Trimmed entries without empty terms, empty definitions or media files; tags are removed."""
    suffix = "|".join(s.replace(".", r"\.") for s in MEDIA_SUFFIXES)
    clean = strip(strip_tags(F.coalesce(F.col(definition), F.lit(""))))
    return (
        df.withColumn(term, strip(F.coalesce(F.col(term), F.lit(""))))
        .withColumn(definition, clean)
        .filter((F.col(term) != "") & ~F.col(term).rlike(f"(?:{suffix})$") & (F.col(definition) != ""))
    )


def drop_composite_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """Drop entries whose head-word is empty or holds a composition in braces."""
    return df.filter((strip(title) != "") & ~F.col(title).rlike("[{}]"))


def leaf_entries(df: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """Entries that are no other entry's parent."""
    parents = df.filter(F.col(parent_col) != 0).select(F.col(parent_col).alias(id_col)).distinct()
    return df.join(parents, id_col, "left_anti")


def extract_see_also(df: DataFrame, col: str = "definition") -> DataFrame:
    """Move cross-reference tags into an array; a body left empty lists them instead."""
    c = F.col(col)
    refs = F.regexp_extract_all(c, F.lit("<SEEALSO>(.*?)</SEEALSO>"), F.lit(1))
    body = F.when(F.contains(c, F.lit("<SEEALSO>")), strip(F.regexp_replace(c, "<SEEALSO>.*?</SEEALSO>", ""))).otherwise(c)
    fallback = F.concat(F.lit("参见："), F.array_join("_refs", "；"))
    return (
        df.withColumn("_refs", refs)
        .withColumn(col, body)
        .withColumn(col, F.when((F.col(col) == "") & (F.size("_refs") > 0), fallback).otherwise(F.col(col)))
        .withColumnRenamed("_refs", "see_also")
        .filter(F.col(col) != "")
    )


def alt_terms(words: Column | str) -> Column:
    """Head-words after the first; null when there is only one."""
    w = as_col(words)
    return F.when(F.size(w) > 1, F.slice(w, F.lit(2), F.size(w)))


def head_term(words: Column | str) -> Column:
    return null_if_empty(F.get(as_col(words), F.lit(0)))
