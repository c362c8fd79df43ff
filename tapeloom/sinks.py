"""Sinks: tables and stream batches as JSON lines, and folders for what a run writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_DIRS: list[str] = []
_RUNS: dict[str, str] = {}  # by base folder: the folder of this run


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, whatever its scheme."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder of this run that the driver and all executors share; it goes when the driver ends.

    It is below spark.checkpoint.dir. Where that is unset, a local session (tests, one
    machine) gets a temporary folder; a cluster session gets a folder in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.conf.get("spark.master", "local").split("[")[0] == "local":
        if not _LOCAL_DIRS:
            _LOCAL_DIRS.append(tempfile.mkdtemp(prefix="tapeloom-"))
            atexit.register(lambda: [shutil.rmtree(d, ignore_errors=True) for d in _LOCAL_DIRS])
        base = "file://" + _LOCAL_DIRS[0]
    base = (base or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    if base not in _RUNS:
        _RUNS[base] = f"{base}/tapeloom/run-{uuid.uuid4().hex}"
        path, fs = hadoop_path(spark, _RUNS[base])
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _RUNS[base]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of this run."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One JSON object a row, nulls left out. The writer commits whole files, so a lost executor leaves none by half."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_ordered(df: DataFrame, path: str, order: list[Column], files: int = 0) -> str:
    """df as parquet files of ranges of order, each sorted, with a manifest: a reader that takes files and rows as they come has the order without a sort.

    files: 0 for as many as the session's shuffles have. The manifest (file, n, start, first) tells how many rows each file
    has, how many come before it, and the key of its first row.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    keyed.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *names).sortWithinPartitions(*names).write.parquet(f"{path}/rows")
    found = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), F.struct(*names).alias("k"))
    w = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a file
    manifest = found.groupBy("file").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last"))
    manifest.select("file", "n", (F.sum("n").over(w) - F.col("n")).alias("start"), "first").write.parquet(f"{path}/manifest")
    return path


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_ordered with their rank from 1, by file and place in it; nothing is sorted."""
    rows = spark.read.parquet(f"{path}/rows")
    own = [c for c in rows.columns if not (c.startswith("_o") and c[2:].isdigit())]
    placed = rows.select(*own, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    starts = spark.read.parquet(f"{path}/manifest").select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    return placed.join(starts, "_file").withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_file", "_at", "_start")


def append_batches(path: str):
    """For foreachBatch: each micro-batch becomes a folder of its own, written again if the batch is replayed, so nothing is doubled."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
