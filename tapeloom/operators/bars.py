"""Bars of a fixed number of trades.

Trades of a trading day (or of a symbol and a day) are numbered in canonical order; the number div N is the
bar. Numbering is by hours: within each, by a window, and from the first of the day by the counts of the
hours before, a table of a few rows a day. So no task sorts more than an hour, however busy a day is. Opening and
closing prices are taken by packing the number within the bar and the price into one long, so all aggregates are
primitive, and combined before the shuffle by bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TICK_SIZE, Scheme
from ..functions.calendar import with_session
from .ordering import canonical_key, hour_block, rank_in_order

_SHIFT, _HALF = 32, 1 << 31


def _packed(number: Column, price: Column) -> Column:
    return F.shiftleft(number, _SHIFT).bitwiseOR(price + F.lit(_HALF).cast("long"))


def _price(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << _SHIFT) - 1).cast("long")) - F.lit(_HALF).cast("long")


def _aggregate(numbered: DataFrame, keys: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """numbered: with _at, the number of a trade within its bar. extra: more aggregates."""
    pack = _packed(F.col("_at"), F.col("price_ticks"))
    return numbered.groupBy(*keys).agg(
        F.min("ts_event").alias("open_ts"), F.max("ts_event").alias("close_ts"), _price(F.min(pack)).alias("open_ticks"), F.max("price_ticks").alias("high_ticks"),
        F.min("price_ticks").alias("low_ticks"), _price(F.max(pack)).alias("close_ticks"), F.sum("size").alias("volume"), F.count("*").alias("trade_count"), *extra,
    )


def numbered_in_day(trades: DataFrame, scheme: Scheme, order: list[Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, trading_day, session, ts_event, price_ticks, size, _rn): the number of each trade of a day, from 0; order must begin with the time or its hour."""
    days = with_session(trades, scheme).where("trading_day is not null").withColumn("_hour", F.date_trunc("hour", "ts_event"))
    counts = days.groupBy(*by, "trading_day", "_hour").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by, "trading_day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*by, "trading_day", "_hour", F.coalesce(earlier, F.lit(0)).alias("_start"))
    w = Window.partitionBy(*by, "trading_day", "_hour").orderBy(*(order or canonical_key()))
    own = days.select(*by, "trading_day", "session", "_hour", "ts_event", "price_ticks", "size", (F.row_number().over(w).cast("long") - 1).alias("_k"))
    return own.join(starts, [*by, "trading_day", "_hour"]).withColumn("_rn", F.col("_k") + F.col("_start")).drop("_hour", "_k", "_start")


def tick_bars(trades: DataFrame, sizes: int | tuple[int, ...], scheme: Scheme, order: list[Column] | None = None, by: tuple[str, ...] = (), extra: tuple[Column, ...] | list[Column] = ()) -> DataFrame:
    """Bars of each size for each trading day, or each of by and day; the last of a day may be partial. Trades of a closed window are left out. extra: more aggregates over a bar's trades, which have their session."""
    wanted = sorted({sizes} if isinstance(sizes, int) else set(sizes))
    if not wanted or wanted[0] <= 0:
        raise ValueError("bar sizes must be positive")
    numbered = numbered_in_day(trades, scheme, order, by)
    each = F.explode(F.array(*[F.lit(n) for n in wanted])) if len(wanted) > 1 else F.lit(wanted[0])
    numbered = numbered.withColumn("timeframe_ticks", each).withColumn("bar_index", F.expr("_rn div timeframe_ticks")).withColumn("_at", F.expr("_rn % timeframe_ticks"))
    return finish(_aggregate(numbered, [*by, "timeframe_ticks", "trading_day", "bar_index"], tuple(extra)))


def finish(bars: DataFrame) -> DataFrame:
    full = F.col("trade_count") == F.col("timeframe_ticks")
    return bars.withColumns({
        "bar_id": F.concat(F.col("timeframe_ticks").cast("string"), F.lit("t:"), F.col("trading_day").cast("string"), F.lit(":"), F.col("bar_index").cast("string")),
        "is_complete": full, "is_partial": ~full, "close_reason": F.when(full, "complete").otherwise("end_of_day"),
    })


def continuous_bars(trades: DataFrame, size: int) -> DataFrame:
    """Complete bars across days."""
    ranked = rank_in_order(trades, canonical_key(), hour_block()).withColumn("bar_index", F.expr(f"(rank - 1) div {int(size)}")).withColumn("_at", F.expr(f"(rank - 1) % {int(size)}"))
    return _aggregate(ranked, ["bar_index"]).where(F.col("trade_count") == size)


def current_bars(bars: DataFrame) -> DataFrame:
    """Of the last trading day, the bars that are still forming."""
    last = bars.agg(F.max("trading_day").alias("trading_day"))
    return bars.where("not is_complete").join(last, "trading_day").withColumn("close_reason", F.lit(None).cast("string"))


def in_points(bars: DataFrame, tick_size: float = TICK_SIZE) -> DataFrame:
    return bars.select("bar_id", *[(F.col(f"{c}_ticks") * tick_size).alias(c) for c in ("open", "high", "low", "close")])


def recent_bars(bars: DataFrame, k: int) -> DataFrame:
    """The last k complete bars of each size."""
    w = Window.partitionBy("timeframe_ticks").orderBy(F.desc("trading_day"), F.desc("bar_index"))
    return bars.where("is_complete").withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)
