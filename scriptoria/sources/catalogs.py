"""Catalogue and lookup files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import strip


def read_catalog_txt(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue lines separated by ``" , "`` with at least seven fields; the author is optional."""
    p = F.transform(F.split("value", " , "), strip)
    return (
        spark.read.text(path)
        .select(p.alias("p"))
        .filter(F.size("p") >= 7)
        .select(
            F.concat(F.col("p")[0], F.col("p")[4]).alias("sutra_id"),
            F.col("p")[0].alias("canon"),
            F.col("p")[1].alias("category"),
            F.coalesce(F.get("p", F.lit(7)), F.lit("")).alias("author"),
        )
    )


def read_bookdata(spark: SparkSession, path: str) -> DataFrame:
    """UTF-16 comma file: canon code in the first field, full name in the fourth."""
    lines = spark.read.format("binaryFile").load(path).select(
        F.explode(F.split(F.decode("content", "UTF-16"), r"\r?\n")).alias("line")
    )
    p = F.transform(F.split("line", ","), strip)
    out = lines.select(p.alias("p")).filter(F.size("p") >= 4)
    out = out.select(F.col("p")[0].alias("canon"), F.col("p")[3].alias("name_zh"))
    return out.filter((F.col("canon") != "") & (F.col("name_zh") != ""))


def read_canons(spark: SparkSession, path: str) -> DataFrame:
    """JSON object: canon code to names."""
    names = F.from_json("value", "map<string,map<string,string>>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(names).alias("canon", "_n"))
        .select("canon", F.col("_n")["title-zh"].alias("title_zh"), F.col("_n")["title-en"].alias("title_en"))
    )


def read_gaiji(spark: SparkSession, path: str) -> DataFrame:
    """JSON object: glyph id to its characters and composition."""
    fields = ["uni_char", "norm_uni_char", "norm_big5_char", "composition"]
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("cb_id", "_g"))
        .select("cb_id", *[F.col("_g")[f].alias(f) for f in fields])
    )
