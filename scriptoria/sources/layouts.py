"""Layouts of stored Parquet files, read from their footers in tasks."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from .corpus import open_store

ROW_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"  # the schema that Spark keeps in the footers it writes
LAYOUT = "path string, n_rows bigint, columns array<struct<column: string, type: string>>, error string"


def _columns(schema: pa.Schema) -> list[dict[str, str]]:
    """Names and Spark types of a file's columns."""
    stored = (schema.metadata or {}).get(ROW_SCHEMA)
    if stored:
        return [{"column": f.name, "type": f.dataType.simpleString()} for f in StructType.fromJson(json.loads(stored))]
    found = []
    for field in schema:
        try:
            kind = from_arrow_type(field.type).simpleString()
        except Exception:  # a type that Spark does not know keeps its own name
            kind = str(field.type)
        found.append({"column": field.name, "type": kind})
    return found


def _footers(batches):
    kinds = pa.struct([("column", pa.string()), ("type", pa.string())])
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            try:
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    footer = pq.read_metadata(file)
                rows.append((path, footer.num_rows, _columns(footer.schema.to_arrow_schema().with_metadata(footer.metadata)), None))
            except (pa.ArrowInvalid, OSError) as e:
                rows.append((path, 0, [], str(e)))
        kept = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(kinds), pa.string()))] if rows else []
        if kept:
            yield pa.RecordBatch.from_arrays(kept, ["path", "n_rows", "columns", "error"])


def read_layouts(spark: SparkSession, root: str) -> DataFrame:
    """One row per Parquet file below ``root``: path, n_rows, columns (name and type), error.

    The footers alone are read, by the tasks that the files are dealt to. A file that cannot be read has no columns and
    an error; empty files are left out, as in any scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    return files.select("path").mapInArrow(_footers, LAYOUT)
