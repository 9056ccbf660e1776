"""Corpus tables and exports."""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, swept
from ..sources.corpus import open_store


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_corpus(tables: dict[str, DataFrame], path: str, partition: str = "canon", key: str = "sutra_id") -> None:
    """Write tables partitioned by canon; a rerun replaces exactly the works it loads.

    The works are those of all given tables. Stored rows of other works in the same canons are read back, joined to the
    new rows and written with them, so only the canons at hand are rewritten; a canon left without rows is removed. Rows
    are spread by partition value and a hash of the rest, so one large canon is written by many tasks. Every table is
    computed once: a first load asks for no works, a later one reads them from a copy of the new rows.
    """
    spark = next(iter(tables.values())).sparkSession
    known = [n for n, df in tables.items() if key in df.columns and _exists(spark, f"{path}/{n}")]
    works = None
    if known and any({partition, key} <= set(df.columns) for df in tables.values()):
        tables = {n: materialize(df, "load") for n, df in tables.items()}
        ids = [df.select(partition, key) for df in tables.values() if {partition, key} <= set(df.columns)]
        works = materialize(reduce(DataFrame.unionByName, ids).distinct(), "works")
    for name, df in tables.items():
        target = f"{path}/{name}"
        if works is not None and name in known:
            stored = spark.read.option("mergeSchema", True).parquet(target).withColumn(partition, F.col(partition).cast("string"))
            others = stored.join(works.select(partition).distinct(), partition, "left_semi").join(works, [partition, key], "left_anti")
            df = materialize(df.unionByName(others, allowMissingColumns=True), "corpus")  # before its source is replaced
            for row in works.select(partition).distinct().join(df.select(partition).distinct(), partition, "left_anti").collect():  # canons
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{partition}={row[0]}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        rest = [c for c in df.columns if c != partition and df.schema[c].dataType.typeName() not in ("map", "variant")]
        spread = F.pmod(F.xxhash64(*rest), F.lit(64))
        with swept(spark):
            (
                df.repartition(partition, spread)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(partition)
                .parquet(target)
            )


def read_table(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_files(files: DataFrame, root: str) -> int:
    """Write each row of ``files`` (path below ``root``, content) as a file of its own; returns the number of files.

    Tasks write under a name of their own and move the file when it is complete, so a task that runs again, or twice,
    leaves the same files. A null content is an empty file; rows of one path overwrite each other.
    """

    def write(batches):
        store, base = open_store(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as out:
                    out.write(content or b"")
                store.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = files.select("path", F.col("content").cast("binary")).mapInArrow(write, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; the byte-order mark of spreadsheet exports is not written."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_map_json(nested: DataFrame, path: str, key: str = "sutra_id") -> None:
    """JSON lines ordered by key (the writer keeps one object per key part)."""
    nested.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").json(path)


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """Quality report: summary as JSON, details as parquet."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").parquet(f"{path}/details")
