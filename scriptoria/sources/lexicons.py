"""Dictionary files."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.compat import null_if_empty, strip, text_or_empty
from ..session import broadcast_if_small, materialize

# Field names that hold head-words and definitions, most likely first.
TERM_FIELDS = ["term", "詞條", "word", "headword", "key", "title", "entry"]
DEFINITION_FIELDS = ["definition", "釋義", "解釋", "meaning", "def", "explanation", "value", "content"]
CSV_TERM_FIELDS = ["term", "詞條", "word", "headword", "key"]
CSV_DEFINITION_FIELDS = ["definition", "釋義", "解釋", "meaning", "value", "def"]

SENSE_DDL = "struct<def:string,quote:array<string>,example:array<string>>"
HETERONYMS_DDL = f"array<struct<bopomofo:string,pinyin:string,definitions:array<{SENSE_DDL}>>>"
LEXICON_DDL = f"title string, radical string, stroke_count int, heteronyms {HETERONYMS_DDL}"


def _dict_name() -> Column:
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]+$", "")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Standard dictionaries ``{meta, entries[]}``: one row per entry with the dictionary's metadata."""
    schema = (
        "meta struct<id:string,name:string,source:string,entry_count:bigint>, "
        "entries array<struct<term:string,definition:string,alt_terms:array<string>,see_also:array<string>>>"
    )
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(
        F.coalesce("meta.id", _dict_name()).alias("dict_id"),
        F.col("meta.name").alias("name"),
        text_or_empty("meta.source").alias("source"),
        F.col("meta.entry_count").alias("meta_count"),
        F.posexplode("entries").alias("pos", "e"),
    ).select("dict_id", "name", "source", "meta_count", "pos", "e.*")


def read_nested_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon with readings and senses."""
    return spark.read.schema(LEXICON_DDL).json(path, multiLine=True)


def _variant_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, dict_id, v): each file as one VARIANT; null where the file is no JSON."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.concat(F.lit("user.json."), _dict_name()).alias("dict_id"), F.try_parse_json("value").alias("v")
    )


def broken_user_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold neither an object nor an array, which give no rows."""
    kind = F.schema_of_variant("v")
    return _variant_files(spark, path).filter(~F.coalesce(kind.rlike("^(OBJECT|ARRAY)<"), F.lit(False))).select("file", "dict_id")


def _first_field(item: Column, names: list[str]) -> Column:
    return strip(F.coalesce(*[F.try_variant_get(item, f'$["{n}"]', "string") for n in names], F.lit("")))


def read_user_json(spark: SparkSession, path: str) -> DataFrame:
    """User dictionaries as ``(dict_id, term, at, pos, definition)``; the layout is told by each file's own VARIANT.

    An object maps terms to one or several definitions (``at`` is the order of its keys by name). An array holds objects
    whose first known term and definition fields are used; nested senses give one definition per reading, and where they
    give none the plain fields count. Numbers and truth values are given as JSON text, nulls are left out.
    """
    from ..operators.lexicon import reading_texts

    files = _variant_files(spark, path)
    kind = F.schema_of_variant("v")
    # A part of a VARIANT carries all keys of its file, here the terms: parts leave the file as JSON texts of their own.
    texts = F.transform_values(F.col("v").cast("map<string,variant>"), lambda _, x: F.to_json(x))
    objects = files.filter(F.startswith(kind, F.lit("OBJECT<"))).select("dict_id", F.posexplode(texts).alias("at", "term", "_t"))
    objects = objects.select("dict_id", "at", "term", F.parse_json("_t").alias("_v"))
    values = F.when(F.startswith(F.schema_of_variant("_v"), F.lit("ARRAY<")), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    from_objects = objects.select("dict_id", strip("term").alias("term"), "at", F.posexplode(values).alias("pos", "_d")).select(
        "dict_id", "term", "at", "pos", F.when(~F.is_variant_null("_d"), F.coalesce(F.try_variant_get("_d", "$", "string"), F.to_json("_d"))).alias("definition")
    )

    items = files.filter(F.startswith(kind, F.lit("ARRAY<"))).select("dict_id", F.posexplode(F.col("v").cast("array<variant>")).alias("at", "_i"))
    first_def = _first_field(F.col("_i"), DEFINITION_FIELDS)
    nested = reading_texts(F.try_variant_get("_i", "$.heteronyms", HETERONYMS_DDL))
    picked = F.when(F.size(nested) > 0, nested).when(first_def != "", F.array(first_def))
    from_arrays = items.select("dict_id", _first_field(F.col("_i"), TERM_FIELDS).alias("term"), "at", F.posexplode(picked).alias("pos", "definition"))
    return from_objects.unionByName(from_arrays).filter(null_if_empty("term").isNotNull() & F.col("definition").isNotNull())


@F.pandas_udf(ArrayType(StringType()))
def first_record(texts: pd.Series) -> pd.Series:
    """Cells of the first row of a CSV text that is not blank."""
    return texts.map(lambda t: next(filter(None, csv.reader(io.StringIO(t, newline=""))), None))


def read_user_csv(spark: SparkSession, path: str, width: int = 256) -> DataFrame:
    """User dictionaries with a header each, as ``(dict_id, term, definition)``; the layout is guessed per file.

    The first row of a file names its columns; of each kind the last known name is used. A file without both gives no rows.
    ``width`` is the number of columns that are looked at.
    """
    file = F.col("_metadata.file_path").alias("file")
    heads = spark.read.text(path, wholetext=True).select(file, F.slice(first_record("value"), 1, width).alias("head"))

    def last(names: list[str]) -> Column:
        known = F.transform("head", lambda h, k: F.when(F.lower(strip(h)).isin(names), k + 1))
        return F.array_max(known)

    layout = materialize(heads.select("file", last(CSV_TERM_FIELDS).alias("t"), last(CSV_DEFINITION_FIELDS).alias("d")).filter("t is not null and d is not null"), "layout")
    used = layout.agg(F.max(F.greatest("t", "d"))).first()[0] or 1  # columns beyond are not parsed into cells
    raw = spark.read.schema(", ".join(f"c{k} string" for k in range(used))).option("multiLine", True).option("header", True).option("escape", "\"").csv(path)
    rows = raw.select(file, _dict_name().alias("name"), F.array(*[f"c{k}" for k in range(used)]).alias("cells"))
    body = rows.join(broadcast_if_small(layout), "file")
    cell = lambda k: strip(text_or_empty(F.element_at("cells", F.col(k))))
    return body.select(F.concat(F.lit("user.csv."), "name").alias("dict_id"), cell("t").alias("term"), cell("d").alias("definition")).filter(F.col("term") != "")


def read_user_dicts(spark: SparkSession, json_path: str, csv_path: str) -> DataFrame:
    """All user dictionaries as ``(dict_id, term, definition)``."""
    return read_user_json(spark, json_path).select("dict_id", "term", "definition").unionByName(read_user_csv(spark, csv_path))
