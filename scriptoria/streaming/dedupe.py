"""First-seen de-duplication while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, keys, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First row of each key.

    With a time column, keys are forgotten after the delay, so the state is bounded; without one every
    key is kept, which is for replays of bounded input.
    """
    keys = list(keys)
    if time_col is None:
        return stream.dropDuplicates(keys)
    stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
