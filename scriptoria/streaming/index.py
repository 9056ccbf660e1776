"""Text index kept in step with a stream of document changes.

The index is a log: each micro-batch adds the postings of its documents and one version row per
document under its batch number. A reader keeps the postings of each document's latest version, so
updates and deletes never rewrite old files, and a replayed batch overwrites only its own folder.
Batches can be compacted inside the same folder while the stream goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import build_trigram_index
from ..session import fits_broadcast


def latest_changes(changes: DataFrame, doc: str, order: str) -> DataFrame:
    """Last change of each document in a batch (partial aggregation before the shuffle); equal numbers go by the other columns."""
    cols = [c for c in changes.columns if c not in (doc, order)]
    last = changes.groupBy(doc).agg(F.max(F.struct(order, *cols)).alias("_c"))
    return last.select(doc, "_c.*")


def apply_batch(batch: DataFrame, batch_id: int, path: str, doc: str = "doc_id", text: str = "text", order: str = "change_no") -> None:
    """Write one batch of changes with columns (doc, text, op, change_no); ``op`` is upsert or delete."""
    batch = batch.select(doc, order, "op", text)
    latest_changes(batch.drop(text), doc, order).select(doc, (F.col("op") == "delete").alias("deleted")).write.mode("overwrite").parquet(
        f"{path}/versions/batch_id={batch_id}"
    )
    last = latest_changes(batch, doc, order)
    postings, _ = build_trigram_index(last.filter(F.col("op") != "delete"), doc, text, unique=True)
    postings.write.mode("overwrite").parquet(f"{path}/postings/batch_id={batch_id}")


def maintain_index(changes: DataFrame, path: str, checkpoint: str, doc: str = "doc_id", text: str = "text", order: str = "change_no"):
    """Start the upkeep of an index folder from a change stream and return the running query."""
    return (
        changes.writeStream.foreachBatch(lambda df, batch_id: apply_batch(df, batch_id, path, doc, text, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compacted_upto(spark: SparkSession, path: str) -> int | None:
    """Last batch that a finished compaction covers."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/compacted")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    done = []
    for status in fs.listStatus(folder):  # one folder a compaction
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "versions/_SUCCESS")  # written last
        if fs.exists(marker):
            done.append(int(status.getPath().getName().split("=")[1]))
    return max(done, default=None)


def _logged(spark: SparkSession, path: str, kind: str, upto: int | None) -> DataFrame:
    """Rows of the log, where a compaction stands for the batches it covers."""
    rows = spark.read.parquet(f"{path}/{kind}")
    rows = rows.withColumn("batch_id", F.col("batch_id").cast("long"))
    if upto is None:
        return rows
    return rows.filter(F.col("batch_id") > upto).unionByName(spark.read.parquet(f"{path}/compacted/upto={upto}/{kind}"))


def _live(spark: SparkSession, path: str, doc: str, last: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, versions) of the documents that are there after batch ``last`` (all batches if None)."""
    upto = compacted_upto(spark, path)
    versions, postings = (_logged(spark, path, kind, upto) for kind in ("versions", "postings"))
    if last is not None:
        versions = versions.filter(F.col("batch_id") <= last)
    current = versions.groupBy(doc).agg(F.max("batch_id").alias("batch_id"), F.max_by("deleted", "batch_id").alias("deleted"))
    live = current.filter(~F.col("deleted"))
    kept = live.select(doc, "batch_id")  # at most one row a document, so the postings, many more, need not be sorted
    kept = F.broadcast(kept) if fits_broadcast(kept) else kept.hint("shuffle_hash")
    return postings.join(kept, [doc, "batch_id"], "left_semi"), live


def read_index(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """Current postings: those of the latest, not deleted version of each document."""
    return _live(spark, path, doc)[0].drop("batch_id")


def compact_batches(spark: SparkSession, path: str, last: int, doc: str = "doc_id") -> None:
    """Fold the batches up to ``last`` into one sorted part of the same index, while later batches may be written.

    Readers use it once its last file is there; until then, and after a failure, they read the batches. A batch that is
    replayed later does not matter, as readers no longer look at it. Deleted documents leave no row.
    """
    done = compacted_upto(spark, path)
    if done is not None and done >= last:
        return
    postings, live = _live(spark, path, doc, last)
    target = f"{path}/compacted/upto={last}"
    postings.repartitionByRange("term", doc).sortWithinPartitions("term", doc).write.mode("overwrite").parquet(f"{target}/postings")
    live.write.mode("overwrite").parquet(f"{target}/versions")


def compact_index(spark: SparkSession, path: str, target: str, doc: str = "doc_id") -> None:
    """Write the current postings and versions as batch 0 of a new index folder."""
    postings = read_index(spark, path, doc)
    postings.repartitionByRange("term", doc).sortWithinPartitions("term").write.mode("overwrite").parquet(
        f"{target}/postings/batch_id=0"
    )
    docs = postings.select(doc).distinct().withColumn("deleted", F.lit(False))
    docs.write.mode("overwrite").parquet(f"{target}/versions/batch_id=0")
