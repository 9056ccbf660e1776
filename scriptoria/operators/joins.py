"""Contains, interval, any-form and fill joins written as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import as_col, text_windows
from ..functions.grams import find_needles
from ..session import fits_broadcast
from .firstwins import top_k


def substrings(col: Column | str, lo: Column | int, hi: Column | int) -> Column:
    """Distinct substrings with ``lo`` to ``hi`` characters (for short texts such as titles)."""
    c = as_col(col)
    lo = F.lit(lo) if isinstance(lo, int) else lo
    hi = F.least(F.lit(hi) if isinstance(hi, int) else hi, F.length(c))
    by_len = F.transform(
        F.sequence(lo, hi),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)),
    )
    return F.when(hi >= lo, F.array_distinct(F.flatten(by_len))).otherwise(F.array().cast("array<string>"))


def contained_pairs(
    needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str, keys=(), min_len: int = 1
) -> DataFrame:
    """Pairs where a needle occurs inside a (short) haystack, within equal ``keys``.

    Every substring of a haystack is looked up by equality, so the join yields true pairs only: no
    theta join, and no pair of a group is formed that is not part of the result.
    """
    n = needles.filter(F.length(needle) >= min_len).withColumn("_probe", F.col(needle))
    longest = n.agg(F.coalesce(F.max(F.length("_probe")), F.lit(0)))  # scalar subquery
    h = haystacks.withColumn("_longest", longest.scalar())
    h = h.withColumn("_probe", F.explode(substrings(haystack, min_len, F.col("_longest")))).drop("_longest")
    return h.join(n, [*keys, "_probe"]).drop("_probe")


def occurrences(texts: DataFrame, names: DataFrame, text_id, text: str, name: str, prefix: int = 3) -> DataFrame:
    """Occurrences of names (at least ``prefix`` characters) in long texts: one row per hit.

    The name side is measured. A small one goes to the tasks (through the driver), which look up the places of their texts
    in it, so only hits leave a task. For a larger one each text is cut in place into overlapping windows as long as the
    longest name, and a window meets the names that start with its first characters in a shuffled join that AQE can split.
    """
    ids = [text_id] if isinstance(text_id, str) else list(text_id)
    n = names.filter(F.length(name) >= prefix)
    if fits_broadcast(n):
        needles = [r[0] for r in n.select(F.col(name).cast("string")).distinct().collect()]
        return find_needles(texts, ids, text, needles, name, prefix).join(F.broadcast(n), name).select(*ids, "pos", *n.columns)
    n = n.withColumn("_key", F.left(F.col(name), F.lit(prefix)))
    longest = n.agg(F.coalesce(F.max(F.length(name)), F.lit(0)))  # scalar subquery
    windows = (
        texts.select(*ids, F.col(text).alias("_t"))
        .withColumn("_longest", longest.scalar())
        .select(
            *ids,
            F.posexplode(text_windows("_t", prefix, F.greatest("_longest", F.lit(prefix)))).alias("_pos", "_win"),
        )
    )
    return (
        windows.withColumn("_key", F.left("_win", F.lit(prefix)))
        .join(n, "_key")
        .filter(F.startswith("_win", F.col(name)))
        .drop("_key", "_win")
        .withColumnRenamed("_pos", "pos")
    )


def contains_join(texts: DataFrame, names: DataFrame, text_id, text: str, name: str, prefix: int = 3) -> DataFrame:
    """Names found in texts with non-overlapping counts, as ``str.count`` gives them.

    Only a name that can overlap itself needs more than a count of hits: its hits are folded in
    position order inside the (text, name) group.
    """
    ids = [text_id] if isinstance(text_id, str) else list(text_id)
    hits = occurrences(texts, names.select(name).distinct(), ids, text, name, prefix)
    c = F.col(name)
    overlaps = F.exists(
        F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.left(c, i) == F.right(c, i)
    )
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.when(overlaps, F.col("pos")))),
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.when(
            p >= acc["end"], F.struct((p + F.length(c)).alias("end"), (acc["n"] + 1).alias("n"))
        ).otherwise(acc),
        lambda acc: acc["n"],
    )
    return hits.groupBy(*ids, name).agg(F.when(overlaps, folded).otherwise(F.count(F.lit(1))).alias("n"))


def assign_interval(
    points: DataFrame, periods: DataFrame, value: str, start: str, end: str, order=(), cols=("period_id",)
) -> DataFrame:
    """Give each integer point the first interval (by start, then ``order``) that holds it; ends are inclusive.

    Intervals are resolved once per *distinct* value of the points. Both sides are cut into cells of a
    width derived from the intervals, so the range join is an equi-join on the cell; the points
    themselves are then joined by value. Points outside every interval keep null columns.
    """
    width = periods.agg(  # scalar subquery
        F.coalesce(F.greatest(F.lit(1), F.avg(F.col(end) - F.col(start) + 1).cast("bigint")), F.lit(1))
    )
    p = periods.withColumn("_cell", width.scalar()).withColumn(
        "_c", F.explode(F.sequence(F.floor(F.col(start) / F.col("_cell")), F.floor(F.col(end) / F.col("_cell"))))
    )
    v = points.select(F.col(value).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    v = v.withColumn("_cell", width.scalar()).withColumn("_c", F.floor(F.col("_v") / F.col("_cell"))).drop("_cell")
    hit = p.drop("_cell").join(v, "_c").filter(F.col("_v").between(F.col(start), F.col(end)))
    first = top_k(hit, ["_v"], [F.col(start), *order], 1).select("_v", *cols)
    return points.join(first, points[value] == first["_v"], "left").drop("_v")


def join_any_form(keys: DataFrame, entries: DataFrame, key: str, forms) -> DataFrame:
    """Entries any of whose form columns equals the key: an equi-join instead of an OR condition."""
    forms = list(forms)
    exploded = entries.withColumn("_form", F.explode(F.array_distinct(F.array(*forms))))
    return keys.join(exploded, keys[key] == exploded["_form"]).drop("_form")


def fill_missing(base: DataFrame, extra: DataFrame, key: str, cols) -> DataFrame:
    """Set columns from ``extra`` where the base value is missing or empty."""
    cols = list(cols)
    side = extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in cols])
    out = base.join(side, key, "left")
    for c in cols:
        empty = F.coalesce(F.col(c), F.lit("")) == ""
        out = out.withColumn(c, F.when(empty & (F.coalesce(F.col(f"_x_{c}"), F.lit("")) != ""), F.col(f"_x_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_x_{c}" for c in cols])


def full_outer_counts(left: DataFrame, right: DataFrame, key, measures) -> DataFrame:
    """Full outer comparison of counts; an absent side counts as zero."""
    keys = [key] if isinstance(key, str) else list(key)
    l = left.select(*keys, *[F.col(m).alias(f"{m}_source") for m in measures])
    r = right.select(*keys, *[F.col(m).alias(f"{m}_table") for m in measures])
    both = l.join(r, keys, "full_outer")
    return both.select(
        *keys,
        *[F.coalesce(F.col(f"{m}_{s}"), F.lit(0)).alias(f"{m}_{s}") for m in measures for s in ("source", "table")],
    )
