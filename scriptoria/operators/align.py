"""Order-preserving comparison of two editions of many texts (D2), as joins and groupings over segments.

Texts are cut into segments. Segments that stand in the same gap on both sides and are there once each are anchor
candidates; the longest chain of them that rises on both sides splits the gap, equal segments at both ends of a gap are
taken as they come, and the next round works inside the smaller gaps, until a round finds nothing. All pairs of texts and all
gaps take part in one round together. What is left between anchors are the differences; they are cut down to the characters
that differ and listed with their surroundings on both sides.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.text import drop_ws, normalize_for_compare
from ..session import materialize
from .quality import MATCH_BANDS, SEGMENT_END

CONTEXT = 10
PAIRS = ArrayType(StructType([StructField("pl", LongType()), StructField("pr", LongType())]))


def rising(right: list[int]) -> list[int]:
    """Indexes of the longest strictly rising chain."""
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for i, x in enumerate(right):
        k = bisect_left(ends, x)
        ends[k:k + 1], last[k:k + 1] = [x], [i]
        before.append(last[k - 1] if k else -1)
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


@F.pandas_udf(PAIRS)
def rising_pairs(pairs: pd.Series) -> pd.Series:
    """Of pairs sorted by their left position, those on the longest chain that also rises on the right."""
    return pd.Series([[p[i] for i in rising([x["pr"] for x in p])] for p in pairs])


def _units(pairs: DataFrame) -> DataFrame:
    """(pid, side, pos, n, h) of the segments that are not empty; their texts stay with the pairs."""

    def side(name: str, number: int) -> DataFrame:
        cut = pairs.select("pid", F.posexplode(name).alias("pos", "_seg")).filter(F.col("_seg") != "")
        return cut.select("pid", F.lit(number).alias("side"), F.col("pos").cast("long"), F.length("_seg").alias("n"), F.xxhash64("_seg", F.length("_seg")).alias("h"))

    return side("_l", 0).unionByName(side("_r", 1))


def _same_run(left: Column, right: Column) -> Column:
    """How many elements two arrays share from the start."""
    differs = F.array_position(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(left), F.size(right)).cast("long"))


def _new_matches(work: DataFrame) -> DataFrame:
    """(pid, pl, pr) found in this round; ``work`` has (pid, side, pos, h, matched).

    The pairs are dealt once, which serves the window and all groupings here.
    """
    order = Window.partitionBy("pid", "side").orderBy("pos")
    free = work.repartition("pid").withColumn("gap", F.sum(F.col("matched").cast("long")).over(order)).filter(~F.col("matched"))
    left = F.col("side") == 0
    single = free.groupBy("pid", "gap", "h").agg(
        F.count_if(left).alias("nl"), F.count_if(~left).alias("nr"), F.min(F.when(left, F.col("pos"))).alias("pl"), F.min(F.when(~left, F.col("pos"))).alias("pr"),
    ).filter("nl = 1 and nr = 1")
    chains = single.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("pl", "pr"))).alias("pairs")).select("pid", rising_pairs("pairs").alias("found"))

    gaps = free.groupBy("pid", "gap").agg(
        *[F.array_sort(F.collect_list(F.when(left == (s == "l"), F.struct("pos", "h")))).alias(s) for s in "lr"]
    ).filter("size(l) > 0 and size(r) > 0")
    gaps = gaps.withColumn("p", _same_run(F.col("l.h"), F.col("r.h")))
    rest = [F.reverse(F.slice(F.col(s), F.col("p").cast("int") + 1, F.size(s))).alias(f"{s}e") for s in "lr"]
    gaps = gaps.select("pid", "p", "l", "r", *rest).withColumn("s", _same_run(F.col("le.h"), F.col("re.h")))

    def zipped(a: str, b: str, n: str) -> Column:
        return F.zip_with(F.slice(F.col(a), 1, F.col(n).cast("int")), F.slice(F.col(b), 1, F.col(n).cast("int")), lambda x, y: F.struct(x["pos"].alias("pl"), y["pos"].alias("pr")))

    ends = gaps.filter("p > 0 or s > 0").select("pid", F.concat(zipped("l", "r", "p"), zipped("le", "re", "s")).alias("found"))
    return chains.unionByName(ends).select("pid", F.explode("found").alias("m")).select("pid", "m.pl", "m.pr").distinct()


def align_texts(left: DataFrame, right: DataFrame, keys, left_text: str, right_text: str, pattern: str = SEGMENT_END, normalize: bool = True, context: int = CONTEXT) -> DataFrame:
    """Agreement and differences of the texts that share ``keys`` (unique on each side).

    Returns keys, ratio (twice the characters found equal over those of both sides; 1 if both are empty), left_len,
    right_len, band, diffs and moves. A difference has op (replace, delete, insert), left_at and right_at (characters before
    it in the normalised texts), left_chars, right_chars and their context, with the differing part in brackets. Applying
    all differences to the left text gives the right one. ``moves`` lists segments that stand on both sides, but out of
    order (left_at, right_at, text); they are also part of the differences.
    """
    keys = list(keys)
    norm = normalize_for_compare if normalize else drop_ws
    cut = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), pattern), norm)
    pairs = left.select(*keys, cut(left_text).alias("_l")).join(right.select(*keys, cut(right_text).alias("_r")), keys)
    pairs = materialize(pairs.withColumn("pid", F.monotonically_increasing_id()), "pairs")
    work = materialize(_units(pairs).withColumn("matched", F.lit(False)), "units")
    while True:
        found = materialize(_new_matches(work), "matches")
        if not found.limit(1).count():
            break
        hits = found.select("pid", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("pl").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("pr").alias("pos")))).alias("u"))
        hits = hits.select("pid", "u.*", F.lit(True).alias("hit"))
        work = materialize(work.join(hits, ["pid", "side", "pos"], "left").select("pid", "side", "pos", "n", "h", (F.col("matched") | F.coalesce("hit", F.lit(False))).alias("matched")), "aligned")

    order = Window.partitionBy("pid", "side").orderBy("pos")
    placed = work.repartition("pid").withColumn("gap", F.sum(F.col("matched").cast("long")).over(order)).withColumn("end", F.sum("n").over(order))
    placed = placed.withColumn("start", F.col("end") - F.col("n"))
    is_left, free = F.col("side") == 0, ~F.col("matched")
    blocks = placed.groupBy("pid", "gap").agg(
        *[F.coalesce(F.max(F.when(own & F.col("matched"), F.col("end"))), F.lit(0)).alias(f"{s}_from") for s, own in (("l", is_left), ("r", ~is_left))],
        *[F.max(F.when(own & free, F.col("end"))).alias(f"{s}_to") for s, own in (("l", is_left), ("r", ~is_left))],
    ).filter("l_to is not null or r_to is not null")
    blocks = blocks.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("l_from", "r_from", F.coalesce("l_to", "l_from").alias("l_to"), F.coalesce("r_to", "r_from").alias("r_to")))).alias("blocks"))

    equal = placed.filter(is_left & F.col("matched")).groupBy("pid").agg(F.sum("n").alias("equal"))

    nth = Window.partitionBy("pid", "side", "h").orderBy("pos")
    left_over = placed.filter(free).withColumn("nth", F.row_number().over(nth))
    moved = left_over.groupBy("pid", "h", "nth").agg(
        F.max(F.when(is_left, F.col("start"))).alias("left_at"), F.max(F.when(~is_left, F.col("start"))).alias("right_at"), F.max("n").alias("n")
    ).filter("left_at is not null and right_at is not null")
    moved = moved.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("left_at", "right_at", "n"))).alias("moves"))

    light = blocks.join(moved, "pid", "full_outer").join(equal, "pid", "full_outer")
    whole = pairs.select(*keys, "pid", *[F.array_join(f"_{s}", "").alias(f"{s}_text") for s in "lr"]).join(light, "pid", "left")
    moves = F.transform("moves", lambda m: F.struct(m["left_at"].alias("left_at"), m["right_at"].alias("right_at"), F.substring("l_text", m["left_at"].cast("int") + 1, m["n"]).alias("text")))
    whole = whole.withColumn("moves", moves).withColumn("equal", F.coalesce("equal", F.lit(0).cast("long")))
    out = _with_diffs(whole, context, keys)
    out = out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in ("diffs", "moves")})
    total = F.col("left_len") + F.col("right_len")
    none = {c: F.lit(0).cast("long") for c in ("left_len", "right_len", "equal")}
    out = out.select(*keys, *[F.coalesce(c, z).alias(c) for c, z in none.items()], *[F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)).alias(c) for c in ("diffs", "moves")])
    out = out.withColumn("ratio", F.when(total > 0, 2 * F.col("equal") / total).otherwise(F.lit(1.0)))
    band = F.lit("differs")
    for floor, name in reversed(MATCH_BANDS):
        band = F.when(F.col("ratio") >= floor, name).otherwise(band)
    return out.select(*keys, "ratio", "left_len", "right_len", band.alias("band"), "diffs", "moves")


def _with_diffs(whole: DataFrame, context: int, keys: list[str]) -> DataFrame:
    """Differences of each pair, cut down to differing characters, with context."""
    l_text, r_text = F.col("l_text"), F.col("r_text")

    def part(text: Column, start: Column, end: Column) -> Column:
        return F.substring(text, start + 1, end - start)

    whole = whole.withColumn("b", F.transform(F.coalesce("blocks", F.array().cast(whole.schema["blocks"].dataType)), lambda x: F.struct(
        x["l_from"].cast("int").alias("i"), x["r_from"].cast("int").alias("j"),
        F.split(part(l_text, x["l_from"].cast("int"), x["l_to"].cast("int")), "").alias("l"), F.split(part(r_text, x["r_from"].cast("int"), x["r_to"].cast("int")), "").alias("r"),
    )))
    chars = lambda a: F.filter(a, lambda c: c != "")
    whole = whole.withColumn("b", F.transform("b", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), chars(x["l"]).alias("l"), chars(x["r"]).alias("r"))))
    whole = whole.withColumn("b", F.transform("b", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["l"].alias("l"), x["r"].alias("r"), _same_run(x["l"], x["r"]).cast("int").alias("p"))))
    tail = lambda a, p: F.reverse(F.slice(a, p + 1, F.size(a)))
    whole = whole.withColumn("b", F.transform("b", lambda x: F.struct(
        x["i"].alias("i"), x["j"].alias("j"), x["l"].alias("l"), x["r"].alias("r"), x["p"].alias("p"), _same_run(tail(x["l"], x["p"]), tail(x["r"], x["p"])).cast("int").alias("s"),
    )))
    middle = lambda a, x: F.array_join(F.slice(a, x["p"] + 1, F.size(a) - x["p"] - x["s"]), "")
    whole = whole.withColumn("same", F.aggregate("b", F.lit(0), lambda t, x: t + x["p"] + x["s"]))
    whole = whole.withColumn("b", F.transform("b", lambda x: F.struct(
        (x["i"] + x["p"]).alias("left_at"), (x["j"] + x["p"]).alias("right_at"), middle(x["l"], x).alias("left_chars"), middle(x["r"], x).alias("right_chars"),
    )))

    def around(text: Column, at: Column, chars: Column) -> Column:
        start, end = F.greatest(at - context, F.lit(0)), at + F.length(chars)
        return F.concat(part(text, start, at), F.lit("【"), chars, F.lit("】"), part(text, end, end + context))

    op = lambda x: F.when(x["right_chars"] == "", "delete").when(x["left_chars"] == "", "insert").otherwise("replace")
    diffs = F.transform(F.filter("b", lambda x: (x["left_chars"] != "") | (x["right_chars"] != "")), lambda x: F.struct(
        op(x).alias("op"), x["left_at"].alias("left_at"), x["right_at"].alias("right_at"), x["left_chars"].alias("left_chars"), x["right_chars"].alias("right_chars"),
        around(l_text, x["left_at"], x["left_chars"]).alias("left_context"), around(r_text, x["right_at"], x["right_chars"]).alias("right_context"),
    ))
    return whole.select(*keys, diffs.alias("diffs"), "moves", F.length("l_text").cast("long").alias("left_len"), F.length("r_text").cast("long").alias("right_len"), (F.col("equal") + F.col("same")).cast("long").alias("equal"))
