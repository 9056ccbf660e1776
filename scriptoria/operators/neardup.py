"""Near-duplicate short texts by sequence-matcher ratio, without comparing all pairs.

Exact copies are collapsed first, so a text that occurs a million times is compared once. A pair can
exceed the threshold only if the two texts share enough characters (counted with multiplicity); that
gives an exact prefix filter: sort each text's characters from rare to frequent, and any qualifying
pair shares one of the first few. Length bands split frequent characters further. Survivors pass the
exact upper bound in the JVM before the matcher runs on Arrow batches.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.compat import as_col
from ..session import broadcast_if_small


@F.pandas_udf(DoubleType())
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``difflib.SequenceMatcher`` ratio of each pair."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def verse_key(col):
    """Text without blanks and bars, as it is compared."""
    return F.translate(as_col(col), " ｜|", "")


def distinct_texts(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per distinct text: smallest id, text and number of copies."""
    return df.groupBy(F.col(text).alias("text")).agg(
        F.min(id_col).alias("rep_id"), F.count(F.lit(1)).alias("copies")
    )


def _char_tokens(reps: DataFrame) -> DataFrame:
    """Characters numbered by occurrence (``a#1``, ``a#2``), each text's array ordered from rare to frequent."""
    chars = F.split("text", "")
    chars = F.filter(chars, lambda c: c != "")
    uniq = F.array_distinct(chars)
    numbered = F.flatten(
        F.transform(
            uniq,
            lambda c: F.transform(
                F.sequence(F.lit(1), F.size(F.filter(chars, lambda x: x == c))), lambda i: F.concat(c, F.lit("#"), i)
            ),
        )
    )
    rows = reps.withColumn("tokens", numbered).withColumn("n", F.length("text")).filter(F.col("n") > 0)
    freq = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        rows.select("rep_id", F.explode("tokens").alias("token"))
        .join(broadcast_if_small(freq), "token")
        .groupBy("rep_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("ranked"))
    )
    return rows.join(ordered, "rep_id")


def near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float = 0.7) -> DataFrame:
    """Pairs of distinct texts with ratio above the threshold, earlier id first.

    Returns ``(id_a, id_b, ratio, copies_a, copies_b)``; copies of one text stand behind its smallest
    id, and :func:`distinct_texts` tells them apart. No candidate is dropped: the filters are bounds.
    """
    reps = _char_tokens(distinct_texts(df, id_col, text))
    # A pair needs 2 * common > threshold * (la + lb), and common <= min(la, lb); hence the partner is at
    # least share = t / (2 - t) as long, and common >= share * max(la, lb) and > share * la for both.
    share = threshold / (2 - threshold)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / share)) + 1e-9)
    keep = F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1
    rows = reps.withColumn("band", band).withColumn("prefix", F.slice("ranked", F.lit(1), keep.cast("int")))
    left = rows.select(
        F.col("rep_id").alias("id_a"), F.col("n").alias("n_a"), "band", F.explode("prefix").alias("token")
    ).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    right = rows.select(F.col("rep_id").alias("id_b"), F.col("n").alias("n_b"), "band", F.explode("prefix").alias("token"))
    pairs = (
        left.join(right, ["band", "token"])
        .filter((F.col("id_a") < F.col("id_b")) & (2 * F.least("n_a", "n_b") > threshold * (F.col("n_a") + F.col("n_b"))))
        .select("id_a", "id_b")
        .distinct()
    )

    def side(s: str) -> DataFrame:
        return rows.select(
            F.col("rep_id").alias(f"id_{s}"), F.col("text").alias(f"text_{s}"), F.col("tokens").alias(f"tok_{s}"),
            F.col("copies").alias(f"copies_{s}"),
        )

    joined = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    bound = 2.0 * F.size(F.array_intersect("tok_a", "tok_b")) / (F.length("text_a") + F.length("text_b"))
    checked = joined.filter(bound > threshold).withColumn("ratio", match_ratio("text_a", "text_b"))
    return checked.filter(F.col("ratio") > threshold).select("id_a", "id_b", "ratio", "copies_a", "copies_b")
