"""Session helpers: shared scratch folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was measured to be below both bounds.
BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(
    app: str = "scriptoria", master: str | None = None, shuffle_partitions: int | None = None, local_memory: str = "8g"
) -> SparkSession:
    """Session with the settings the operators rely on (AQE with skew handling, UTC, Arrow)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")  # ordered text pieces per key
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):  # one JVM does all the work
            b = b.config("spark.driver.memory", local_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one that ``spark.checkpoint.dir`` names.

    Only a local session, where driver and executors are one process, gets a folder of its own when none is set; it is
    removed when the process ends. On a cluster a missing setting is an error before anything is written.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/scriptoria-{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (``__`` for a dot) that hold inside the block."""
    values = {name.replace("__", "."): v for name, v in values.items()}
    before = {name: spark.conf.get(name, None) for name in values}
    for name, v in values.items():
        spark.conf.set(name, v)
    try:
        yield
    finally:
        for name, v in before.items():
            spark.conf.unset(name) if v is None else spark.conf.set(name, v)


def swept(spark: SparkSession):
    """Writes inside the block delete their shuffle files when they end, which else stay until the driver's collector runs."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def materialize(df: DataFrame, label: str = "cut", by: str | None = None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    With ``by``, a column of few values and no nulls, each value has a folder, so a reader of one value reads only its rows.
    A task keeps a file open per value and does not sort. With ``buckets``, a number and a column by which the tasks of ``df``
    are dealt, readers that group by the column need no shuffle. Shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    out = df.write.mode("overwrite") if by is None else df.write.mode("overwrite").partitionBy(by)
    with swept(spark), settings(spark, **({} if by is None else {"spark__sql__maxConcurrentOutputFileWriters": "16"})):
        if buckets is None:
            out.parquet(path)
            back = spark.read.schema(df.schema).parquet(path)
            return back if by is None else back.select(df.columns)  # which has ``by`` at the end
        name = path.rsplit("/", 1)[1].replace("-", "_")  # only a named table tells its buckets
        out.bucketBy(*buckets).option("path", path).format("parquet").saveAsTable(name)
        return spark.table(name).select(df.columns)


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`materialize` wrote for ``df``, which nothing reads any more."""
    spark = df.sparkSession
    for path in {f"{head}/scriptoria-{tail.split('/', 1)[0]}" for head, _, tail in (f.partition("/scriptoria-") for f in df.inputFiles()) if tail}:
        spark.sql(f"DROP TABLE IF EXISTS `{path.rsplit('/', 1)[1].replace('-', '_')}`")
        old = spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Measure at most ``max_rows + 1`` rows and say whether the whole side is small."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint for a side that was measured to be small; otherwise leave the join to AQE (skew join on)."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain file scan over all cores when it has fewer splits than there are cores.

    A small file is often a single row group, which one task would read and then also parse or cut
    into windows alone. A scan with enough splits, as any large input has, is returned unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
