"""Tail of an append-only note log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import first_group
from ..functions.text import work_id
from ..sources.documents import parse_notes_log


def read_note_stream(spark: SparkSession, path: str, names: str = "*.md") -> DataFrame:
    """Stream of log files, one row per file, with a day ``YYYY-MM-DD`` in the path."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", names).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def note_log(files: DataFrame) -> DataFrame:
    """Note rows with work, day and volume."""
    n = parse_notes_log(files)
    return n.select(
        "*",
        work_id("sutra_title").alias("sutra_id"),
        first_group("sutra_title", r"卷(\d+)$").cast("int").alias("juan"),
        F.to_timestamp(first_group("log_path", r"(\d{4}-\d{2}-\d{2})")).alias("day"),
    )


def notes_per_day(rows: DataFrame, time_col: str = "day", key: str = "sutra_id", delay: str = "1 day", identity=None) -> DataFrame:
    """Rows per key in daily windows, final once the watermark has passed.

    With ``identity`` columns a note that comes again within the delay, as in a repeated file, counts once; later rows are
    dropped like any late row, so the state stays bounded.
    """
    rows = rows.withWatermark(time_col, delay)
    if identity:
        rows = rows.dropDuplicatesWithinWatermark(list(identity))
    return (
        rows.groupBy(F.window(time_col, "1 day"), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("day"), key, "n")
    )
