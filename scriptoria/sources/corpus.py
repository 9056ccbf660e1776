"""Corpus files: ``root/<canon>/<volume folder>/<file>.xml``."""

from __future__ import annotations

from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import first_group
from ..functions.text import volume_from_path

FILE_PATTERN = r"([A-Z]+)(\d+)n([A-Za-z]*\d+[A-Za-z]?)(?:_\d+)?\.xml$"

READ = 32 << 20  # bytes of files that a task reads before it hands them on


def _folders(spark: SparkSession, pattern: str, depth: int = 0) -> list[str]:
    """The folders that a path with wildcards leads to; none of the last ``depth`` names is hidden."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    folders = [f.getPath().toString() for f in found or () if f.isDirectory()]
    return [f for f in folders if not any(n.startswith((".", "_")) for n in f.split("/")[len(f.split("/")) - depth :])]


def _list_files(pattern: str):
    """Path and length of the files in folders (with those below a ``deep`` one) whose names fit; as in any scan, hidden and
    empty ones are left out."""

    def run(batches):
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist()):
                store, base = open_store(folder)
                left = [base]
                while left:
                    inside = [f for f in store.get_file_info(fs.FileSelector(left.pop())) if not f.base_name.startswith((".", "_"))]
                    left += [f.path for f in inside if deep and f.type == fs.FileType.Directory]
                    files = [f for f in inside if f.type == fs.FileType.File and f.size and fnmatchcase(f.base_name, pattern)]
                    columns = [pa.array([folder + f.path[len(base) :] for f in files], pa.string()), pa.array([f.size for f in files], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "length"])

    return run


def _read_files(batches):
    for batch in batches:
        paths, lengths, held, first, size = batch.column("path").to_pylist(), batch.column("length"), [], 0, 0
        for i, path in enumerate(paths):
            store, name = open_store(path)
            with store.open_input_stream(name) as file:
                held.append(file.read())
            size += len(held[-1])
            if size >= READ or i + 1 == len(paths):
                rows = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], ["path", "length", "content"])
                held, first, size = [], i + 1, 0


def scan_corpus(
    spark: SparkSession, root: str, canon: str | None = None, volume: str | None = None, work: str | None = None
) -> DataFrame:
    """One row per XML file with ids taken from its name.

    Canon and volume become path globs, so other folders are never listed; ``work`` matches the
    number in the file name with or without zero padding. A canon or volume without a folder has no rows.

    One volume is a plain file scan. Otherwise the driver lists the folders of canons and volumes only: tasks list the files
    in them, and the files are dealt by path to as many tasks as a shuffle has, so many small files make neither a list in
    the driver nor many tasks.
    """
    root = root.rstrip("/")
    if canon:
        folders = [(f, False) for f in _folders(spark, f"{root}/{canon}/{canon}{volume or '*'}")]
    else:
        folders = [(f, depth == 2) for depth in range(3) for f in _folders(spark, root + "/*" * depth, depth)]
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.ltrim(first_group(name, FILE_PATTERN, 3), F.lit("0")) == work.lstrip("0") if work else F.lit(True)
    if canon and volume and folders:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"{canon}*.xml").load([f for f, _ in folders]).filter(wanted)
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = spark.createDataFrame(folders, "folder string, deep boolean").repartition(min(parts, max(1, len(folders))), "folder")
        listed = listed.mapInArrow(_list_files(f"{canon or ''}*.xml"), "path string, length bigint").filter(wanted)
        files = listed.repartition(parts, "path").mapInArrow(_read_files, "path string, length bigint, content binary")
    return files.select(
        F.col("path").alias("doc_path"),
        "content",
        F.col("length").alias("n_bytes"),
        first_group(name, FILE_PATTERN, 1).alias("canon"),
        first_group(name, FILE_PATTERN, 2).alias("volume"),
        first_group(name, FILE_PATTERN, 3).alias("work_no"),
        volume_from_path("path").alias("file_juan"),
    )


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the name of the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def scan_assets(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Binary assets with size and the first eight bytes in hex.

    A file scan leaves out empty files, so they are taken from the file index that the scan has
    listed anyway (names only).
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    )
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "_uri string")
    read = files.select("path", "length", F.hex(F.substring("content", 1, 8)).alias("magic"))
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return listed.join(read, name(F.col("_uri")) == name(F.col("path")), "left").select(
        F.coalesce("path", "_uri").alias("path"), F.coalesce("length", F.lit(0)).alias("length"), "magic"
    )
