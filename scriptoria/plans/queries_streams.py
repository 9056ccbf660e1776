"""Queries: streaming jobs replayed over the input tables with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming.dedupe import first_seen
from ..streaming.index import apply_batch, compact_batches, compacted_upto, maintain_index, read_index
from ..streaming.notes import note_log, notes_per_day, read_note_stream
from .registry import Tables, query


def stream(t: Tables, name: str) -> DataFrame:
    """A table as a file stream; the pattern finds it as one file and as a folder of files."""
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")


def drain(df: DataFrame, label: str) -> DataFrame:
    """Run an append stream over everything available and read its output table."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    job = df.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out)
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query(
    "stream_index",
    """
    WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) AS term
               FROM documents WHERE length(text) >= 3 AND lang <> 'de')
    SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM g GROUP BY doc_id
    """,
)
def stream_index(t: Tables) -> DataFrame:
    """Documents as a change stream: German ones are deletions."""
    changes = stream(t, "documents").select(
        "doc_id", "text", F.when(F.col("lang") == "de", "delete").otherwise("upsert").alias("op"), F.col("doc_id").alias("change_no")
    )
    path = scratch_path(t.spark, "index")
    maintain_index(changes, path, f"{path}-state").awaitTermination()
    index = read_index(t.spark, path)
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t: Tables) -> DataFrame:
    seen = first_seen(stream(t, "events"), ["user_id", "event_type"], "ts", "365 days")
    return drain(seen.select("user_id", "event_type"), "seen")


@query(
    "stream_note_log",
    """
    SELECT 'T' || lpad(conv_id::VARCHAR, 6, '0') AS sutra_id, (DATE '2024-01-01' + turn::INT)::VARCHAR AS day, turn::INT AS juan, count(*) AS n,
      max(length(string_split(text, chr(10))[1])) AS longest
    FROM conversations GROUP BY ALL
    """,
)
def stream_note_log(t: Tables) -> DataFrame:
    """Conversation turns as note-log entries of one work each, dated by turn."""
    c = stream(t, "conversations")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).cast("string")
    first = F.split("text", "\n")[0]
    entry = F.concat(
        F.lit("### \U0001f552 10:00 | T"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(" x · 卷"), "turn",
        F.lit("\n\n> "), first, F.lit("\n\n\U0001f4dd **感悟**："), "role", F.lit("\n\n---\n"),
    )
    rows = note_log(c.select(F.concat(F.lit("log/"), day, F.lit(".md")).alias("path"), entry.alias("value")))
    notes = drain(rows.select("sutra_id", "day", "juan", "quote"), "notes")
    return notes.groupBy("sutra_id", F.to_date("day").cast("string").alias("day"), "juan").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length("quote")).alias("longest")
    )


@query(
    "stream_index_changes",
    """
    WITH f AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN text WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN replace(text, 'a', 'bb') ELSE text END AS text FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))) AS term FROM f WHERE length(text) >= 3)
    SELECT doc_id, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM g GROUP BY doc_id
    """,
)
def stream_index_changes(t: Tables) -> DataFrame:
    """Inserts, updates, deletes and returns over three batches, two changes of a document in one of them; the first two
    batches are compacted before the third comes, then the second is replayed."""
    d, path = t.documents, scratch_path(t.spark, "index")
    change = lambda df, text, op, no: df.select("doc_id", text.cast("string").alias("text"), F.lit(op).alias("op"), F.lit(no).alias("change_no"))
    none, deleted = F.lit(None), "delete"
    steps = [
        change(d.filter("doc_id % 4 = 0"), F.lit("an older text"), "upsert", 1).unionByName(change(d, F.col("text"), "upsert", 2)),
        change(d.filter("doc_id % 5 = 0"), none, deleted, 3).unionByName(change(d.filter("doc_id % 5 > 0 and doc_id % 3 = 0"), F.replace(F.col("text"), F.lit("a"), F.lit("bb")), "upsert", 3)),
        change(d.filter("doc_id % 7 = 0"), none, deleted, 4).unionByName(change(d.filter("doc_id % 7 > 0 and doc_id % 10 = 0"), F.col("text"), "upsert", 4)),
    ]
    for k, rows in enumerate(steps):
        rows.write.mode("append").parquet(f"{path}/changes")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{path}/changes")
        maintain_index(stream, path, f"{path}/state").awaitTermination()
        if k == 1:
            compact_batches(t.spark, path, k)
    apply_batch(steps[1], 1, path)  # a replay
    if compacted_upto(t.spark, path) != 1:
        raise RuntimeError("the compaction is not in use")
    index = read_index(t.spark, path)
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_tokens"))


@query(
    "stream_notes_per_day",
    """
    SELECT 'T' || lpad(conv_id::VARCHAR, 6, '0') AS sutra_id, (DATE '2024-01-01' + turn::INT)::VARCHAR AS day, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id, turn
    """,
)
def stream_notes_per_day(t: Tables) -> DataFrame:
    """Notes per work and day from log files that come in three runs of one checkpoint.

    The second run also brings files of a day that is already closed (late, dropped) and files that were there before under
    other names (each note counts once); the third only closes what is open.
    """
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).cast("string")
    entry = F.concat(
        F.lit("### \U0001f552 10:00 | T"), F.lpad(F.col("conv_id").cast("string"), 6, "0"), F.lit(" x · 卷"), "turn", F.lit("\n\n\U0001f4dd **感悟**："), "role", F.lit("\n\n---\n"),
    )
    notes = t.conversations.select("turn", day.alias("day"), F.floor(F.col("conv_id") / 100).alias("part"), entry.alias("entry"))
    files = notes.groupBy("turn", "day", "part").agg(F.array_join(F.collect_list("entry"), "\n").alias("value"))
    path, out = scratch_path(t.spark, "log"), scratch_path(t.spark, "per-day")

    def arrive(some: DataFrame) -> None:
        """New files below the folder of their day, with up to a hundred of the logs each."""
        some.select("day", "value").write.mode("append").option("maxRecordsPerFile", 100).partitionBy("day").text(path)

    def run() -> None:
        rows = note_log(read_note_stream(t.spark, path, "*.txt")).select("sutra_id", "day", "juan")
        counts = notes_per_day(rows, identity=["sutra_id", "day", "juan"])
        counts.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()

    arrive(files.filter("turn <= 5"))
    run()
    arrive(files.filter("turn > 5"))
    arrive(files.filter("turn = 0"))
    arrive(files.filter("turn = 5"))
    run()
    end = files.limit(1).withColumn("day", F.lit("2025-01-01"))
    arrive(end)
    run()
    got = t.spark.read.schema("day timestamp, sutra_id string, n long").parquet(out)
    return got.select("sutra_id", F.to_date("day").cast("string").alias("day"), "n")
