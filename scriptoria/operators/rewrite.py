"""Rewriting of texts by a phrase table of any size (N1): leftmost-longest matches, in place or found by a join."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..session import broadcast_if_small, fits_broadcast, materialize

WINDOW = 256
MATCHES = ArrayType(StructType([StructField("at", IntegerType()), StructField("n", IntegerType()), StructField("dst", StringType())]))


@F.pandas_udf(MATCHES)
def apart(matches: pd.Series) -> pd.Series:
    """Of matches in order, at most one a place, those that do not begin inside an earlier one that was taken."""

    def take(found):
        kept, end = [], 0
        for m in found:
            if m["at"] >= end:
                kept.append(m)
                end = m["at"] + m["n"]
        return kept

    return matches.map(take)


def in_place(phrases: dict[str, str]):
    """Column function that rewrites each text where it is: a place looks up its first two characters, then whole phrases."""
    sizes: dict[str, set[int]] = {}
    for src in phrases:
        sizes.setdefault(src[:2], set()).add(len(src))
    known = {a: sorted(n, reverse=True) for a, n in sizes.items()}

    def rewrite(text):
        if text is None:
            return None
        out, done, i = [], 0, 0
        while i < len(text):
            for n in (*known.get(text[i : i + 2], ()), 1):
                if (dst := phrases.get(text[i : i + n])) is not None:
                    out += text[done:i], dst
                    i = done = min(i + n, len(text))
                    break
            else:
                i += 1
        return "".join((*out, text[done:])) if out else text

    return pandas_udf(lambda texts: texts.map(rewrite), StringType())


def _anchor(text: Column, at: Column | int, n: Column | int) -> Column:
    return F.substring(text, at, n)


def rewrite_phrases(df: DataFrame, text: str, phrases: DataFrame, src: str = "src", dst: str = "dst", out: str | None = None, window: int = WINDOW) -> DataFrame:
    """``df`` with ``text`` (or a new column ``out``) rewritten: at each place the longest phrase, from left to right.

    A phrase with several targets takes the least of them; empty phrases are ignored; a null text stays null. A table that
    was measured to be small goes to the tasks, which rewrite each text in one pass without a shuffle. For a larger one texts
    are cut in place into windows that overlap by the longest phrase; a place meets the phrases with its first two characters (or its
    one), by a shuffle of the places that begin like some phrase. Only matches are gathered, per text.
    """
    table = phrases.filter(F.length(src) > 0).groupBy(F.col(src).alias("_src")).agg(F.min(dst).alias("_dst"))
    table = materialize(table.select("_src", "_dst", F.length("_src").alias("_n"), F.substring("_src", 1, 2).alias("_a")), "phrases")
    if fits_broadcast(table):
        small = {r[0]: r[1] or "" for r in table.select("_src", "_dst").collect()}
        return df.withColumn(out or text, in_place(small)(F.col(text)))
    longest = table.agg(F.max("_n")).first()[0] or 1
    rows = materialize(df.withColumn("_pid", F.monotonically_increasing_id()), "texts")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    base = F.sequence(F.lit(0), F.size("_c") - 1, F.lit(window))
    cut = rows.select("_pid", chars.alias("_c")).filter(F.size("_c") > 0).select("_pid", F.explode(F.transform(base, lambda b: F.struct(
        b.alias("base"), F.array_join(F.slice(F.col("_c"), b + 1, F.lit(window + longest - 1)), "").alias("w"), F.least(F.lit(window), F.size("_c") - b).alias("n"),
    ))).alias("x")).select("_pid", "x.*")
    places = cut.select("_pid", "base", "w", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    places = places.select("_pid", (F.col("base") + F.col("i") - 1).alias("at"), F.explode(F.array_distinct(F.array(_anchor(F.col("w"), F.col("i"), F.lit(2)), _anchor(F.col("w"), F.col("i"), F.lit(1))))).alias("_a"), F.substring("w", F.col("i"), F.lit(longest)).alias("_here"))
    hits = places.join(broadcast_if_small(table.select("_a").distinct()), "_a", "left_semi").join(table, "_a")
    hits = hits.filter(F.substring("_here", F.lit(1), F.col("_n")) == F.col("_src"))
    best = hits.groupBy("_pid", "at").agg(F.max(F.struct("_n", "_dst")).alias("m"))
    found = best.groupBy("_pid").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("m._n").cast("int").alias("n"), F.col("m._dst").alias("dst")))).alias("m"))
    found = materialize(found.select("_pid", apart("m").alias("_m")), "matches")

    whole = rows.join(found, "_pid", "left").withColumn("_c", chars)
    part = lambda a, b: F.array_join(F.slice(F.col("_c"), a + 1, b - a), "")
    before = lambda k: F.when(k > 0, F.get("_m", k - 1)["at"] + F.get("_m", k - 1)["n"]).otherwise(F.lit(0))
    pieces = F.flatten(F.transform("_m", lambda m, k: F.array(part(before(k), m["at"]), m["dst"])))
    end = F.element_at("_m", -1)
    made = F.array_join(F.concat(pieces, F.array(part(end["at"] + end["n"], F.size("_c")))), "")
    return whole.withColumn(out or text, F.when(F.col("_m").isNull(), F.col(text)).otherwise(made)).drop("_pid", "_m", "_c")
