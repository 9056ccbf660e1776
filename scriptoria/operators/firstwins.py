"""First-wins, carry-forward, run and top-k operators.

Rank filters are written as ``row_number() <= k``: Spark plans a partial limit per task before the
shuffle, so a key that holds a third of the rows still sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import as_col, let
from ..functions.text import drop_ws


def _order(cols) -> list:
    return [c if isinstance(c, Column) else F.col(c) for c in cols]


def top_k(df: DataFrame, keys, order, k: int, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows of each key in the given total order."""
    rc = rank_col or "_rank"
    if not keys:
        out = df.orderBy(*_order(order)).limit(k)
        if rank_col:
            # At most k rows are left, so a single-task numbering is bounded.
            out = out.withColumn(rc, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order(order))))
        return out
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    out = df.withColumn(rc, F.row_number().over(w)).filter(F.col(rc) <= k)
    return out if rank_col else out.drop(rc)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    return top_k(df, keys, order, 1)


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    return top_k(df, keys, [c.desc() for c in _order(order)], 1)


def carry_forward(
    df: DataFrame, part, order: str, col: Column | str, out: str, chunk: int | None = None, default=None
) -> DataFrame:
    """Latest non-null value so far within ``part``.

    With ``chunk`` the numeric order column is cut into ranges that are scanned in parallel; only one
    summary row per range takes part in the second pass, so one huge key is not one task.
    """
    part = list(part)
    df = df.withColumn("_v", as_col(col))
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out_df = df.withColumn(out, F.last("_v", ignorenulls=True).over(w))
    else:
        df = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
        keys = [*part, "_chunk"]
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = F.when(F.col("_v").isNotNull(), F.col(order))
        tails = df.groupBy(*keys).agg(F.max_by("_v", seen).alias("_tail"))
        before = Window.partitionBy(*part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        heads = tails.withColumn("_head", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
        out_df = (
            df.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
            .join(heads, keys, "left")
            .withColumn(out, F.coalesce("_local", "_head"))
            .drop("_local", "_head", "_chunk")
        )
    if default is not None:
        out_df = out_df.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return out_df.drop("_v")


def next_sibling(df: DataFrame, parent, order, cols) -> DataFrame:
    """Add ``next_<col>`` from the following row under the same parent."""
    w = Window.partitionBy(*parent).orderBy(*_order(order))
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])


def runs(df: DataFrame, part, order: str, pred: Column, chunk: int | None = None) -> DataFrame:
    """Number maximal runs of consecutive rows that satisfy ``pred``; other rows are dropped.

    A run is named by the order value of its first row (``run_start``).
    """
    part = list(part)
    flagged = df.withColumn("_hit", F.coalesce(pred, F.lit(False)))
    w = Window.partitionBy(*part).orderBy(order)
    if chunk is None:
        flagged = flagged.withColumn("_prev", F.lag("_hit", 1, False).over(w))
    else:
        flagged = flagged.withColumn("_chunk", F.floor(F.col(order) / chunk))
        wc = Window.partitionBy(*part, "_chunk").orderBy(order)
        tails = flagged.groupBy(*part, "_chunk").agg(F.max_by("_hit", order).alias("_tail"))
        heads = tails.withColumn(
            "_head", F.lag("_tail", 1, False).over(Window.partitionBy(*part).orderBy("_chunk"))
        ).drop("_tail")
        flagged = (
            flagged.withColumn("_prev", F.lag("_hit").over(wc))
            .join(heads, [*part, "_chunk"])
            .withColumn("_prev", F.coalesce("_prev", "_head"))
            .drop("_head", "_chunk")
        )
    starts = F.when(F.col("_hit") & ~F.col("_prev"), F.col(order))
    out = carry_forward(flagged, part, order, starts, "run_start", chunk=chunk)
    return out.filter("_hit").drop("_hit", "_prev")


def number_rows(df: DataFrame, part, order, out: str = "seq") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*_order(order))))


def fingerprint(col: Column | str, n: int, chars: str = "，。、；：！？|") -> Column:
    """First ``n`` characters without white space and the given punctuation."""
    return F.left(F.translate(drop_ws(col), chars, ""), F.lit(n))


def dedupe_prefix(df: DataFrame, text: str, n: int, order, existing: DataFrame | None = None) -> DataFrame:
    """Keep the first text of each ``n``-character fingerprint; shorter texts never count as duplicates.

    ``existing`` holds fingerprints (column ``fp``) that are already taken.
    """
    work = df.withColumn("fp", fingerprint(text, n))
    # A short text gets a key of its own (its place in the order), so one pass serves both kinds.
    own = F.concat_ws("\x00", F.lit("short"), *[c.cast("string") for c in _order(order)])
    work = work.withColumn("_key", F.when(F.length("fp") >= n, F.col("fp")).otherwise(own))
    if existing is not None:
        work = work.join(existing.select("fp").distinct(), "fp", "left_anti")
    return keep_first(work, ["_key"], order).drop("_key")


def select_top_distinct(df: DataFrame, text: str, score: str, pos, fp: int = 12, k: int = 2000) -> DataFrame:
    """Best-scored text of each fingerprint, then the best ``k`` overall."""
    order = [F.col(score).desc(), *_order(pos)]
    work = df.withColumn("fp", fingerprint(text, fp))
    return keep_first(work, ["fp"], order).orderBy(*order).limit(k)


def first_person_by_name(persons: DataFrame, known: DataFrame | None = None, order="person_id") -> DataFrame:
    """One person per name in table order, leaving out persons that are already known."""
    pool = persons if known is None else persons.join(known.select("person_id").distinct(), "person_id", "left_anti")
    return keep_first(pool, ["name"], [order])


def first_seen_mode(values: Column | str) -> Column:
    """Most frequent array element; ties go to the element seen first."""
    def pick(v: Column) -> Column:
        def best(uniq: Column) -> Column:
            counts = F.transform(uniq, lambda x: F.size(F.filter(v, lambda y: y == x)))
            return let(counts, lambda c: F.get(uniq, F.array_position(c, F.array_max(c)).cast("int") - 1))

        return let(F.array_distinct(v), best)

    return let(as_col(values), pick)


def bounded_groups(df: DataFrame, keys, item: Column, member: str, out: str, limit: int = 1000) -> DataFrame:
    """Collect members into sorted arrays of about ``limit`` items.

    A key with more members gets several rows (``part`` 0, 1, ...): members are spread by hash, so no
    task ever holds one unbounded group. Ordinary keys have exactly one row.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    spread = F.pmod(F.xxhash64(F.col(member)), F.ceil(F.col("_n") / F.lit(limit)))
    return (
        df.join(sizes, list(keys))
        .withColumn("part", spread)
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(item)).alias(out))
    )
