"""The canonical order of a tape and what departs from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import side_signed


def canonical_key() -> list[Column]:
    return [F.col("ts_event"), F.coalesce("sequence", F.lit(0)), side_signed(F.col("price_ticks"), F.col("side")), F.col("size")]


def rank_in_order(df: DataFrame, order: list[Column], block: Column, name: str = "rank") -> DataFrame:
    """A global row number from 1 without a single-task window.

    block: a key that rises with the order (an hour, a day). Rows are numbered within blocks, and
    the blocks' counts, a table as small as there are blocks, give each its offset.
    """
    own = df.withColumn("_block", block)
    counts = own.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"))
    numbered = own.withColumn("_k", F.row_number().over(Window.partitionBy("_block").orderBy(*order)))
    return numbered.join(offsets, "_block").withColumn(name, F.col("_k") + F.col("_offset")).drop("_block", "_k", "_offset")


def hour_block() -> Column:
    return F.date_trunc("hour", F.col("ts_event"))


def canonical_rank(df: DataFrame) -> DataFrame:
    return rank_in_order(df, canonical_key(), hour_block())


def _before(df: DataFrame, value: Column, order: list[Column], block: Column, running_max: bool) -> DataFrame:
    """Adds _was: the previous row's value, or the largest of all earlier ones, across blocks."""
    own = df.withColumn("_block", block)
    w = Window.partitionBy("_block").orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.max(value).over(frame) if running_max else F.lag(value).over(w)
    last = F.max(value) if running_max else F.max_by(value, F.struct(*order))
    across = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("_block").agg(last.alias("_last")).select("_block", (F.max("_last").over(across) if running_max else F.lag("_last").over(Window.orderBy("_block"))).alias("_earlier"))
    return own.withColumn("_in", inside).join(blocks, "_block").withColumn("_was", F.greatest("_in", "_earlier") if running_max else F.coalesce("_in", "_earlier")).drop("_block", "_in", "_earlier")


def regressions(df: DataFrame, arrival: str, block_rows: int = 65_536, processed: bool = False) -> DataFrame:
    """Rows whose time is before that of the last accepted row, in order of arrival, which is accepted_ts.

    Late rows are dropped, so the last accepted time is the largest so far; or they are processed, and it moves back with them.
    """
    got = _before(df, F.col("ts_event"), [F.col(arrival)], F.floor(F.col(arrival) / block_rows), not processed)
    return got.where("ts_event < _was").withColumnRenamed("_was", "accepted_ts")


def regression_notes(late: DataFrame) -> DataFrame:
    """Data-quality notes of regressions."""
    message = F.concat(F.lit("earlier than "), F.date_format("accepted_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return late.select(F.lit("timestamp_regression").alias("code"), message.alias("message"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("source"), "ts_event")


def inversions(df: DataFrame, arrival: str, block_rows: int = 65_536) -> DataFrame:
    """How often the time falls from one row to the next."""
    got = _before(df, F.col("ts_event"), [F.col(arrival)], F.floor(F.col(arrival) / block_rows), False)
    return got.agg(F.coalesce(F.sum((F.col("ts_event") < F.col("_was")).cast("long")), F.lit(0).cast("long")).alias("inversions"), F.count("*").alias("n_rows"))


def sweeps(df: DataFrame, group: list[str], arrival: str) -> DataFrame:
    """For each instant with several prices, how they run in order of arrival."""
    w = Window.partitionBy(*group).orderBy(arrival)
    step = df.withColumn("_d", F.col("price_ticks") - F.lag("price_ticks").over(w))
    g = step.groupBy(*group).agg(F.countDistinct("price_ticks").alias("n_prices"), F.countDistinct("side").alias("n_sides"), F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.max(F.abs("_d")).alias("jump")).where("n_prices > 1")
    shape = F.when(F.col("lo") >= 0, "ascending").when(F.col("hi") <= 0, "descending").otherwise("non_monotone")
    return g.withColumns({"shape": shape, "mixed_side": F.col("n_sides") > 1, "contiguous": F.col("jump") <= 1})


def merged(events: DataFrame) -> DataFrame:
    """Typed events (kind trade or quote) in one order: at an instant a quote comes before a buy and after a sell."""
    key = F.when(F.col("kind") == "quote", F.lit(0).cast("long")).otherwise(side_signed(F.col("price_ticks"), F.col("side")))
    return rank_in_order(events, [F.col("ts_event"), F.coalesce("sequence", F.lit(0)), key, F.coalesce("size", F.lit(0))], hour_block())
