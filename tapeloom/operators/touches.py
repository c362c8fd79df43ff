"""First touches of zones: an equi-join on the day with a range condition, then the least bar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIRECTION, TICK_SIZE, Scheme
from ..functions.calendar import session_of, to_local


def same(names: tuple[str, ...], prefix: str = "_of_") -> Column:
    """Each column equals the one of the other side, which is renamed with the prefix."""
    return reduce(lambda a, b: a & b, [F.col(n) == F.col(prefix + n) for n in names])


def renamed(names: tuple[str, ...], prefix: str = "_of_") -> list[Column]:
    return [F.col(n).alias(prefix + n) for n in names]


def intersections(bars: DataFrame, zones: DataFrame, tick_size: float = TICK_SIZE, gated: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Every bar that holds a zone's price, ends included. A bar that closes before the zone is known does not count, and uses nothing up."""
    day = (*by, "trading_day")
    z = zones.select(*renamed(day), "zone_id", "representative_price", "names", "side", "available_from")
    hit = same(day) & F.col("representative_price").between(F.col("low_ticks") * tick_size, F.col("high_ticks") * tick_size)
    if gated:
        hit = hit & (F.col("available_from").isNull() | (F.col("close_ts") >= F.col("available_from")))
    return bars.join(z, hit).drop(*("_of_" + n for n in day))


def first_touches(bars: DataFrame, zones: DataFrame, tick_size: float = TICK_SIZE, gated: bool = True, direction: dict[str, str] = DIRECTION, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each zone that is touched, in order of bar and zone."""
    found = intersections(bars, zones, tick_size, gated, by).groupBy(*by, "trading_day", "zone_id").agg(F.min(F.struct("bar_index", "close_ts", "representative_price", "names", "side")).alias("t"))
    way = F.create_map(*[F.lit(x) for pair in direction.items() for x in pair])
    out = found.select(*by, "trading_day", "zone_id", F.col("t.bar_index").alias("bar_index"), F.col("t.close_ts").alias("bar_ts"), F.col("t.representative_price").alias("representative_price"), F.col("t.side").alias("side"), way[F.col("t.side")].alias("direction"), F.element_at("t.names", 1).alias("level_type"))
    return out.withColumn("touch_order", F.row_number().over(Window.partitionBy(*by, "trading_day").orderBy("bar_index", "zone_id")))


def in_session(touches: DataFrame, scheme: Scheme, session: str = "ny") -> DataFrame:
    return touches.where(session_of(to_local(F.col("bar_ts"), scheme), scheme) == session)


def untouched(zones: DataFrame, touches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    key = [*by, "trading_day", "zone_id"]
    return zones.join(touches.select(*key), key, "left_anti")
