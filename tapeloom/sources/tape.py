"""Deterministic tapes from the test tables, by closed formulas over their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import hadoop_path


def _price_path(ts: str, extra: str) -> str:
    m = f"timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"
    return f"cast(68000 + abs({m} % 1260 - 630) div 2 + abs({m} % 4200 - 2100) div 6 + {extra} as bigint)"


def tape_events(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Trades from events: ts_event, sequence, price_ticks, size, side, more columns of theirs, and price."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("ts").cast("timestamp_ntz").alias("ts_event"), F.col("event_id").alias("sequence"),
        F.expr(_price_path("cast(ts as timestamp_ntz)", "cast(floor(value * 100) as bigint) % 25")).alias("price_ticks"),
        (1 + F.col("user_id") % 17).cast("long").alias("size"),
        F.when(F.col("event_type").isin("purchase", "view"), "B").when(F.col("event_type") == "error", "N").otherwise("A").alias("side"), *more,
    ).withColumn("price", F.col("price_ticks") * 0.25)


def tape_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of events as those of three symbols: S0, S1 and S2."""
    return tape_events(spark, sf_dir, F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("symbol"))


def damaged_copy(spark: SparkSession, file: str, target: str) -> str:
    """A copy of a parquet file of which the middle half of the data is overwritten; its footer is as it was."""
    path, fs = hadoop_path(spark, file)
    stream = fs.open(path)
    block = bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    data = len(block) - 8 - int.from_bytes(block[-8:-4], "little")
    block[data // 4 : 3 * data // 4] = b"\xff" * (3 * data // 4 - data // 4)
    copy, fs = hadoop_path(spark, target)
    out = fs.create(copy)
    out.write(block)
    out.close()
    return target


def tape_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-level book rows of which the top is used: action, bid_px_00, ask_px_00, symbol, instrument_id."""
    t, k = tape_events(spark, sf_dir), F.col("sequence") % 11
    symbol = F.when(k < 8, "AAF4").when(k < 10, "AAH4").otherwise("AAF4-AAH4")
    return t.withColumns({
        "action": F.when(F.col("sequence") % 3 == 0, "T").otherwise("A"), "symbol": symbol,
        "instrument_id": F.when(k < 8, 1).when(k < 10, 2).otherwise(3).cast("long"),
        "bid_px_00": F.col("price") - 0.25, "ask_px_00": F.col("price") + 0.25 * (1 + F.col("sequence") % 3),
        "size": F.when((k >= 8) & (k < 10), F.col("size") * 10).otherwise(F.col("size")),
        "bid_sz_00": 1 + F.col("sequence") % 9, "ask_sz_00": F.when(F.col("sequence") % 7 > 0, F.col("sequence") % 7),
    })


def tape_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of which many share the instant and the number, so that only the whole key orders them."""
    return tape_events(spark, sf_dir).withColumns({"ts_event": F.date_trunc("hour", "ts_event").cast("timestamp_ntz"), "sequence": F.col("sequence") % 2})


def tape_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades some of which are off the grid, without size or without a price."""
    t, s = tape_events(spark, sf_dir), F.col("sequence")
    price = F.when(s % 103 == 0, None).when(s % 97 == 0, F.col("price") + 0.10).otherwise(F.col("price"))
    return t.withColumns({"price": price, "size": F.when(s % 101 == 0, 0).otherwise(F.col("size"))}).drop("price_ticks")


def tape_dirty_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book rows of which some have a side off the grid, one side only, or no time."""
    b, s = tape_book(spark, sf_dir), F.col("sequence")
    return b.withColumns({
        "bid_px_00": F.when(s % 89 == 0, F.col("bid_px_00") + 0.07).otherwise(F.col("bid_px_00")), "ask_px_00": F.when(s % 83 == 0, None).otherwise(F.col("ask_px_00")),
        "ts_event": F.when(s % 101 == 0, None).otherwise(F.col("ts_event")),
    }).drop("price_ticks")


def tape_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON messages (schema, message) of trades and quotes, some of which no reader should take."""
    t, s = tape_events(spark, sf_dir), F.col("sequence")
    at = F.concat(F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(s % 97 == 0, "").otherwise("Z")).alias("ts_event")
    trade = F.struct(at, F.when(s % 2 == 0, F.col("price_ticks")).alias("price_ticks"), F.when(s % 89 == 0, F.col("price") + 0.1).otherwise(F.col("price")).alias("px"), F.when(s % 83 == 0, 0).otherwise(F.col("size")).alias("qty"), F.lower("side").alias("side"))
    quote = F.struct(at, F.when(s % 2 == 1, F.col("price_ticks") - 1).alias("bid_price_ticks"), (F.col("price") - 0.25).alias("bid"), F.when(s % 79 > 0, F.col("price") + 0.5).alias("ask_px"), F.col("size").alias("bid_sz"))
    kinds = F.array(F.struct(F.lit("Trades").alias("schema"), F.to_json(trade).alias("message")), F.struct(F.when(s % 73 == 0, "mbo").otherwise("mbp-1").alias("schema"), F.to_json(quote).alias("message")))
    return t.select(F.explode(kinds).alias("m")).select("m.*")


def tape_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A longer tape for benchmarks; rows that tie in all columns are equal, so their order has no effect."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ts = li.withColumn("ts_event", F.expr("cast(l_shipdate as timestamp_ntz) + make_dt_interval(0, 0, 0, (l_orderkey * 7919 + l_linenumber * 104729) % 86400)"))
    return ts.select("ts_event", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("sequence"), F.expr(_price_path("ts_event", "l_partkey % 25")).alias("price_ticks"), F.col("l_quantity").cast("long").alias("size"), F.lit("A").alias("side")).withColumn("price", F.col("price_ticks") * 0.25)
