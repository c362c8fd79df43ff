"""Shared plumbing of the training-data operators: written tables, checked broadcasts, column naming."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import hadoop_path, shared_dir


def put_file(spark: SparkSession, name: str, block: bytes) -> str:
    """Write bytes to a file in the shared folder; its path."""
    path, fs = hadoop_path(spark, f"{shared_dir(spark)}/{name}")
    out = fs.create(path)
    for at in range(0, len(block), 1 << 20):
        out.write(bytearray(block[at : at + (1 << 20)]))
    out.close()
    return path.toString()


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Files of a narrow table for each core of the session, at most.
FILES_PER_CORE = 4


def stage(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and reread it: cuts the lineage, survives lost executors.

    A narrow table has rows of a few ids and hashes, so it takes few files: as many as keep all cores
    busy, however many partitions a shuffle before it has.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    schema = df.schema
    (df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tapeloom/run-" in folder:
            path, fs = hadoop_path(spark, folder)
            fs.delete(path, True)


def crc_mod5(col: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 5. Fold 0 is held out."""
    return F.crc32(col.cast("string").cast("binary")) % 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores, for work that costs far more than a shuffle of a small input; its texts go to Python in small batches."""
    text_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def release() -> None:
    """Give back to the system what this worker has freed: Spark reuses workers, and what they keep would add up."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows of an Arrow batch between Spark and Python: Spark's own number is meant for rows of a few numbers, not for whole texts.
BATCH_ROWS, _SPARKS_OWN = 1024, "10000"


def text_batches(spark: SparkSession) -> None:
    """Let the session exchange batches of fewer rows, unless it was set otherwise. A batch is held by the executor and by its worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(key, BATCH_ROWS)


def by_slices(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, over slices of a few rows: a batch of long texts is never unpacked as a whole."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows))
        release()

    return sliced
