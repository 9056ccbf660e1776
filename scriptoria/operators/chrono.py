"""Periods and the chronicle: people placed on dynasties and eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import all_of, match_text
from ..session import broadcast_if_small, materialize
from .joins import assign_interval

# Dynasties in order with first and last year (BCE negative, shared boundary years).
DYNASTIES = [
    ("先秦", -3000, -221),
    ("秦", -221, -206),
    ("漢", -206, 220),
    ("三國", 220, 265),
    ("西晉", 265, 317),
    ("東晉", 317, 420),
    ("南北朝", 420, 589),
    ("隋", 589, 618),
    ("唐", 618, 907),
    ("五代十國", 907, 960),
    ("北宋", 960, 1127),
    ("南宋", 1127, 1271),
    ("元", 1271, 1368),
    ("明", 1368, 1644),
    ("清", 1644, 1912),
    ("近現代", 1912, 2100),
]
# Dynasties that are divided by eras, by their name in the era table.
SUBDIVIDED = {"唐": "唐", "北宋": "北宋", "南宋": "南宋", "大明": "明", "大清": "清"}
# Dynasty of every name that occurs.
DYNASTY_OF = {
    "先秦": "先秦", "秦": "秦", "漢": "漢",
    "三國": "三國", "西晉": "西晉", "東晉": "東晉",
    "南北朝": "南北朝",
    "隋": "隋", "唐": "唐",
    "五代十國": "五代十國",
    "北宋": "北宋", "南宋": "南宋",
    "元": "元", "明": "明", "清": "清", "近現代": "近現代", "民國": "近現代",
    "劉宋": "南北朝", "南齊": "南北朝", "南梁": "南北朝", "南陳": "南北朝",
    "北魏": "南北朝", "東魏": "南北朝", "西魏": "南北朝",
    "北齊": "南北朝", "北周": "南北朝", "陳": "南北朝",
    "西漢": "漢", "東漢": "漢", "新": "漢", "新莽": "漢",
    "曹魏": "三國", "蜀漢": "三國", "孫吳": "三國",
    "宋": "北宋",
    "後梁": "五代十國", "後唐": "五代十國", "後晉": "五代十國",
    "後漢": "五代十國", "後周": "五代十國",
    "金": "南宋", "大理國": "南宋",
    "前秦": "東晉", "後趙": "東晉", "後秦": "東晉",
    "前涼": "東晉", "後涼": "東晉", "北涼": "東晉", "南涼": "東晉",
    "西秦": "東晉", "成漢": "東晉",
    "春秋": "先秦", "戰國": "先秦", "東周": "先秦", "西周": "先秦",
    "唐堯": "先秦", "商": "先秦",
    "大明": "明", "大清": "清",
    "明/    清": "明", "清/    民國": "清",
    "隋/    唐": "唐", "元/    明": "明",
    "南宋/    元": "南宋", "唐/    五代十國": "唐",
    "北宋/    南宋": "北宋", "五代十國/    北宋": "五代十國",
    "金/    蒙古": "南宋", "金/    元": "元",
    "東晉/    劉宋": "東晉", "劉宋/    南齊": "南北朝",
    "南齊/    南梁": "南北朝", "南梁/    陳": "南北朝",
    "北魏/    東魏": "南北朝", "北魏/    西魏": "南北朝",
}
PENDING = "待考"
LAST = 9999


def dynasty_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, s, e) for i, (n, s, e) in enumerate(DYNASTIES)]
    return spark.createDataFrame(rows, "dynasty_order int, dynasty string, dyn_start int, dyn_end int")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DYNASTY_OF.items()), "alias string, dynasty string")


def chinese_eras(eras: DataFrame, dynasties: DataFrame) -> DataFrame:
    """Dated eras of the subdivided dynasties, under their display names."""
    d = dynasties.filter((F.col("type") == "chinese") & F.col("name_zh").isin(list(SUBDIVIDED)))
    shown = F.create_map(*[F.lit(x) for kv in SUBDIVIDED.items() for x in kv])
    d = broadcast_if_small(d.select("dynasty_id", shown[F.col("name_zh")].alias("dynasty")))
    return eras.filter(F.col("start_year").isNotNull()).join(d, "dynasty_id").select(
        "dynasty", "era_id", F.col("name_zh").alias("label"), "start_year", "end_year"
    )


def fill_gaps(eras: DataFrame, part: str = "dynasty") -> DataFrame:
    """Add a row for every hole between consecutive eras (compared with the previous row's end)."""
    w = Window.partitionBy(part).orderBy("start_year", "era_id")
    prev = eras.withColumn("_prev", F.lag("end_year").over(w)).filter(F.col("start_year") - F.col("_prev") > 1)
    start, end = F.col("_prev") + 1, F.col("start_year") - 1
    gaps = prev.select(
        part, F.lit(None).cast(eras.schema["era_id"].dataType).alias("era_id"),
        F.concat_ws("–", start.cast("string"), end.cast("string")).alias("label"),
        start.alias("start_year"), end.alias("end_year"),
    )
    return eras.select(part, "era_id", "label", "start_year", "end_year").unionByName(gaps)


def build_periods(eras: DataFrame, dynasties: DataFrame) -> DataFrame:
    """Period table: whole dynasties, or their eras (clamped, with holes filled) where there are any."""
    spark = eras.sparkSession
    d = dynasty_table(spark)
    e = fill_gaps(chinese_eras(eras, dynasties))
    start, end = F.greatest("start_year", "dyn_start"), F.least("end_year", "dyn_end")
    sub = e.join(d, "dynasty").select(
        F.concat_ws("_", "dynasty", "label").alias("period_id"), "label", "dynasty", "dynasty_order",
        start.alias("start"), end.alias("end"), F.lit(True).alias("is_sub"),
    ).filter(F.col("start") <= F.col("end"))
    whole = d.join(e.select("dynasty").distinct(), "dynasty", "left_anti").select(
        F.col("dynasty").alias("period_id"), F.col("dynasty").alias("label"), "dynasty", "dynasty_order",
        F.col("dyn_start").alias("start"), F.col("dyn_end").alias("end"), F.lit(False).alias("is_sub"),
    )
    return sub.unionByName(whole)


def effective_year(birth: Column | str = "birth_year", death: Column | str = "death_year") -> Column:
    b = F.col(birth) if isinstance(birth, str) else birth
    d = F.col(death) if isinstance(death, str) else death
    return F.coalesce(b, d - 30)


def place_persons(
    persons: DataFrame, periods: DataFrame, sect: str | None = None, monk: str | None = None
) -> DataFrame:
    """Every person with the period that claims them.

    Dated persons go to the first period that holds their effective year, and have ``placed`` = false
    when none does. Undated persons go to the pending bucket of their dynasty, the rest to the last one.
    """
    spark = persons.sparkSession
    conds = all_of(
        match_text("sect", F.lit(sect)) if sect else None,
        F.col("is_monk") == (1 if monk == "monk" else 0) if monk in ("monk", "lay") else None,
    )
    p = persons.filter(conds).withColumn("eff_year", effective_year().cast("int"))
    cols = ("period_id", "label", "dynasty", "dynasty_order", "start", "end", "is_sub")
    cols = [c for c in cols if c in periods.columns]
    # The period table is small but takes several joins to derive; it is read more than once below.
    named = materialize(periods, "periods").withColumnsRenamed({c: f"p_{c}" for c in cols})
    dated = assign_interval(
        p.filter(F.col("eff_year").isNotNull()), named, "eff_year", "p_start", "p_end",
        [f"p_{c}" for c in ("dynasty_order", "period_id") if c in cols],
        [f"p_{c}" for c in cols],
    ).withColumn("placed", F.col("p_period_id").isNotNull())

    d = dynasty_table(spark).withColumnsRenamed({"dynasty": "_d"})
    names = alias_table(spark).withColumnsRenamed({"dynasty": "_d"}).join(d, "_d")
    undated = p.filter(F.col("eff_year").isNull()).join(F.broadcast(names), F.col("dynasty") == F.col("alias"), "left")
    known = F.col("_d").isNotNull()
    values = {
        "period_id": F.when(known, F.concat_ws("_", "_d", F.lit(PENDING))).otherwise(PENDING),
        "label": F.lit(PENDING),
        "dynasty": F.coalesce("_d", F.lit(PENDING)),
        "dynasty_order": F.coalesce("dynasty_order", F.lit(999)),
        "start": F.coalesce("dyn_end", F.lit(LAST)),
        "end": F.coalesce("dyn_end", F.lit(LAST)),
        "is_sub": known,
    }
    undated = undated.select(*p.columns, *[values[c].alias(f"p_{c}") for c in cols], F.lit(True).alias("placed"))
    return dated.unionByName(undated)


def chronicle(persons: DataFrame, periods: DataFrame, sect: str | None = None, monk: str | None = None) -> DataFrame:
    """Placed persons with their period; empty periods have no rows."""
    return place_persons(persons, periods, sect, monk).filter("placed").drop("placed")


def period_counts(placed: DataFrame) -> DataFrame:
    """Persons per period, with the count of dated persons that no period claimed under a null period."""
    return placed.groupBy("p_dynasty_order", "p_start", "p_period_id").agg(F.count(F.lit(1)).alias("person_count"))


def order_periods(df: DataFrame, order: str = "p_dynasty_order", start: str = "p_start") -> DataFrame:
    return df.orderBy(F.col(order).asc_nulls_last(), F.col(start).asc_nulls_last())

