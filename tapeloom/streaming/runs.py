"""A bounded stream run to its end, as a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sinks
from .controllers import Replay
from .engine import canonical, tape_stream

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a micro-batch, about: those of one symbol are in one task, so a longer table is more batches, not larger ones.
BATCH_ROWS = 1_000_000


def _in_turn(spark: SparkSession, files: list[str]) -> None:
    """Give files the times of their order: a file source takes them by these, and the tasks that wrote them ended in any order."""
    first = int(time.time() * 1000) - 1000 * len(files)
    for i, file in enumerate(files):
        path, fs = sinks.hadoop_path(spark, file)
        fs.setTimes(path, first + 1000 * i, -1)


def run_to_end(events: DataFrame, files_per_batch: int = 8, batches: int = 1, checkpoint: str | None = None, **settings) -> DataFrame:
    """What tape_stream gives for a table of events, streamed from files in canonical order, so many files to a micro-batch.

    There are as many micro-batches as asked for, or more if that many would have more than BATCH_ROWS rows each.
    Jobs run before this returns. A last row, of no symbol, tells that two more days have gone, so timers close
    every symbol's last day. The stream has a session of its own, as its state store is a setting of the session.
    """
    spark = events.sparkSession
    place = sinks.scratch(spark, "stream")
    rows = events if "kind" in events.columns else events.withColumn("kind", F.lit("trade"))
    over = rows.agg((F.max("ts_event") + F.expr("INTERVAL 2 DAYS")).alias("ts_event")).withColumns({"symbol": F.lit(""), "kind": F.lit("clock")})
    order = dict(zip((f"_o{i}" for i in range(5)), canonical(rows), strict=True))
    files = files_per_batch * max(batches, -(-rows.count() // BATCH_ROWS))
    rows.unionByName(over, allowMissingColumns=True).withColumns(order).repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*order).write.parquet(f"{place}/in")
    _in_turn(spark, sorted(spark.read.parquet(f"{place}/in").inputFiles()))
    own = spark.newSession()
    own.conf.set(STORE, ROCKSDB)  # map and list state need it
    # Each micro-batch opens and commits a state store for each partition; beyond the cores they add time alone.
    own.conf.set("spark.sql.shuffle.partitions", min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{place}/in")
    out, fs = sinks.hadoop_path(spark, f"{place}/out")  # a stream may give nothing
    fs.mkdirs(out)
    replay = Replay(tape_stream(stream, **settings), checkpoint or f"{place}/checkpoint", sinks.append_batches(f"{place}/out"))
    replay.start()
    if replay.wait() != "completed":
        raise RuntimeError(f"the stream {replay.state}: {replay.error}")
    return spark.read.schema(replay.stream.schema).parquet(f"{place}/out")
