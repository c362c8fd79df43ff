"""Zones as they were known when each bar closed, and their first touches.

A running engine builds its zones anew at every closed bar, from the prior day's range and the sessions' ranges so far, so
a zone's price and members move during the day and the same area may fire again under another key. As
relations: the sessions' extremes of each bar come from the same aggregate as the bar, running extremes are a
window over the bars of a day, the few levels of a bar are folded into zones within an array, and the first
bar of each zone's key is an aggregate. Nothing here is Python, and no trade is sorted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DIRECTION, LEVEL_ORDER, LEVEL_SIDE, TICK_SIZE, Scheme
from ..functions.calendar import instant_on
from . import levels as lv
from .bars import tick_bars

SESSIONS = ("asia", "london")
_LEVEL = "struct<price: double, ordinal: int, name: string, high: boolean, known: timestamp_ntz>"
_ZONE = "struct<total: double, n: int, top: double, names: array<string>, highs: int, known: timestamp_ntz>"


def bars_with_ranges(trades: DataFrame, size: int, scheme: Scheme, by: tuple[str, ...] = ()) -> DataFrame:
    """Bars with, by session, the extremes of the day's trades up to the bar's last one (asia_high, asia_low, ...; null before the session's first trade)."""
    inside = lambda s: F.when(F.col("session") == s, F.col("price_ticks"))
    own = [c for s in SESSIONS for c in (F.max(inside(s)).alias(f"{s}_high"), F.min(inside(s)).alias(f"{s}_low"))]
    bars = tick_bars(trades, size, scheme, by=by, extra=own)
    so_far = Window.partitionBy(*by, "trading_day").orderBy("bar_index").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumns({f"{s}_{e}": f(f"{s}_{e}").over(so_far) for s in SESSIONS for e, f in (("high", F.max), ("low", F.min))})


def _level(ticks: Column, name: str, known: Column, tick_size: float) -> Column:
    made = F.struct((ticks * tick_size).alias("price"), F.lit(LEVEL_ORDER.index(name)).alias("ordinal"), F.lit(name).alias("name"), F.lit(LEVEL_SIDE[name] == "HIGH").alias("high"), known.alias("known"))
    return F.when(ticks.isNotNull(), made).cast(_LEVEL)


def levels_at_close(bars: DataFrame, scheme: Scheme, tick_size: float = TICK_SIZE, max_back: int | None = 7, static: tuple[tuple[str, float, str], ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """bars_with_ranges with the levels known at each close as an array in order of price. static: (name, price, side), taken first."""
    prior = lv.prior_day(lv.full_day(bars, by), max_back, by)
    # A day's prior range is the same for all its bars, so it is joined by day: a row a day.
    return with_levels(bars.join(prior, [*by, "trading_day"], "left"), scheme, tick_size, static)


def with_levels(df: DataFrame, scheme: Scheme, tick_size: float = TICK_SIZE, static: tuple[tuple[str, float, str], ...] = ()) -> DataFrame:
    """df (trading_day, pdh_ticks, pdl_ticks, asia_high, asia_low, ...) with the levels of each row as an array in order of price."""
    ends = {s.name: s.end for s in scheme.sessions}
    day = F.col("trading_day")
    known = {"pdh": instant_on(day, scheme.boundary, scheme, -1)} | {s: instant_on(day, ends[s], scheme) for s in SESSIONS}
    made = [_level(F.col("pdh_ticks"), "pdh", known["pdh"], tick_size), _level(F.col("pdl_ticks"), "pdl", known["pdh"], tick_size)]
    made += [_level(F.col(f"{s}_{e}"), f"{s}_{e}", known[s], tick_size) for s in SESSIONS for e in ("high", "low")]
    fixed = [F.struct(F.lit(float(price)).alias("price"), F.lit(i - len(static)).alias("ordinal"), F.lit(name).alias("name"), F.lit(side == "HIGH").alias("high"), F.lit(None).cast("timestamp_ntz").alias("known")).cast(_LEVEL) for i, (name, price, side) in enumerate(static)]
    return df.withColumn("levels", F.array_sort(F.filter(F.array(*fixed, *made), lambda x: x.isNotNull())))


def _merge(zones: Column, x: Column, proximity: float) -> Column:
    """zones with one more level, which joins the last of them if it is at most proximity above its highest level."""
    one = lambda total, n, names, highs, known: F.struct(total.alias("total"), n.alias("n"), x["price"].alias("top"), names.alias("names"), highs.alias("highs"), known.alias("known")).cast(_ZONE)
    high = x["high"].cast("int")
    alone = one(x["price"], F.lit(1), F.array(x["name"]), high, x["known"])
    last = F.element_at(zones, -1)
    joined = one(last["total"] + x["price"], last["n"] + 1, F.concat(last["names"], F.array(x["name"])), last["highs"] + high, F.greatest(last["known"], x["known"]))
    near = (F.size(zones) > 0) & (x["price"] - F.try_element_at(zones, F.lit(-1))["top"] <= proximity)
    return F.when(near, F.concat(F.slice(zones, 1, F.greatest(F.size(zones) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(zones, F.array(alone)))


def folded(levels: str, proximity: float) -> Column:
    """The zones of an array of levels."""
    return F.aggregate(levels, F.array().cast(f"array<{_ZONE}>"), lambda acc, x: _merge(acc, x, proximity))


def zones_at_close(bars: DataFrame, proximity: float = 3.0) -> DataFrame:
    """A row for each bar and zone: representative_price, names, side and available_from by the levels known when the bar closed."""
    each = bars.withColumn("_z", F.explode(folded("levels", proximity))).drop("levels")
    return each.withColumns({
        "representative_price": F.col("_z.total") / F.col("_z.n"), "names": F.col("_z.names"), "side": F.when(F.col("_z.highs") * 2 > F.col("_z.n"), "HIGH").otherwise("LOW"), "available_from": F.col("_z.known"),
    }).drop("_z")


def runtime_touches(trades: DataFrame, size: int, scheme: Scheme, tick_size: float = TICK_SIZE, proximity: float = 3.0, max_back: int | None = 7, static: tuple[tuple[str, float, str], ...] = (), direction: dict[str, str] = DIRECTION, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, trading_day, bar_index, bar_ts, representative_price, side, direction, level_type, names): what an engine with its own levels fires.

    A zone is known by its day, names, price and side; it fires once, at the first bar that holds its price while it is known.
    """
    bars = bars_with_ranges(trades, size, scheme, by)
    zones = zones_at_close(levels_at_close(bars, scheme, tick_size, max_back, static, by), proximity)
    holds = F.col("representative_price").between(F.col("low_ticks") * tick_size, F.col("high_ticks") * tick_size) & (F.col("available_from").isNull() | (F.col("close_ts") >= F.col("available_from")))
    key = [*by, "trading_day", "names", "side", F.round("representative_price", 6).alias("_price")]
    first = zones.where(holds).groupBy(*key).agg(F.min(F.struct("bar_index", "close_ts", "representative_price")).alias("t"))
    way = F.create_map(*[F.lit(x) for pair in direction.items() for x in pair])
    return first.select(*by, "trading_day", F.col("t.bar_index").alias("bar_index"), F.col("t.close_ts").alias("bar_ts"), F.col("t.representative_price").alias("representative_price"), "side", way[F.col("side")].alias("direction"), F.element_at("names", 1).alias("level_type"), "names")
