"""Price levels of a trading day: prior-day and session extremes, each with the instant from which it is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LEVEL_ORDER, LEVEL_SIDE, Scheme
from ..functions.calendar import instant_on, session_of, to_local, with_session


def full_day(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bars.groupBy(*by, "trading_day").agg(F.max("high_ticks").alias("high_ticks"), F.min("low_ticks").alias("low_ticks"))


def prior_day(days: DataFrame, max_back: int | None = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, trading_day, pdh_ticks, pdl_ticks): of the latest earlier day with bars, at most max_back calendar days ago. One row per day: the window is over a table of days."""
    w = Window.partitionBy(*by).orderBy("trading_day")
    was = days.select(*by, "trading_day", F.lag("trading_day").over(w).alias("p"), F.lag("high_ticks").over(w).alias("pdh_ticks"), F.lag("low_ticks").over(w).alias("pdl_ticks")).where("p is not null")
    return (was.where(F.datediff("trading_day", "p") <= max_back) if max_back is not None else was).drop("p")


def session_extremes(bars: DataFrame, scheme: Scheme, by: tuple[str, ...] = ()) -> DataFrame:
    """By the session in which a bar closes."""
    return bars.withColumn("session", session_of(to_local(F.col("close_ts"), scheme), scheme)).groupBy(*by, "trading_day", "session").agg(F.max("high_ticks").alias("high_ticks"), F.min("low_ticks").alias("low_ticks"))


def session_extremes_of_trades(trades: DataFrame, scheme: Scheme, by: tuple[str, ...] = ()) -> DataFrame:
    """By the session of each trade."""
    return with_session(trades, scheme).where("trading_day is not null").groupBy(*by, "trading_day", "session").agg(F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks"))


def level_set(bars: DataFrame, scheme: Scheme, tick_size: float = 0.25, static: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, trading_day, name, price, side, available_from, ordinal). static: more levels of the same columns, taken first."""
    by_session = session_extremes(bars, scheme, by)  # every bar has a session, if only none, so the day's range follows from these few rows
    prior = prior_day(full_day(by_session, by), by=by).select(*by, "trading_day", F.explode(F.array(F.struct(F.lit("pdh").alias("name"), F.col("pdh_ticks").alias("ticks")), F.struct(F.lit("pdl").alias("name"), F.col("pdl_ticks").alias("ticks")))).alias("x")).select(*by, "trading_day", "x.name", "x.ticks", instant_on(F.col("trading_day"), scheme.boundary, scheme, -1).alias("available_from"))
    ends = {s.name: s.end for s in scheme.sessions}
    known: Column | None = None
    for name in ("asia", "london"):
        at = instant_on(F.col("trading_day"), ends[name], scheme)
        known = F.when(F.col("session") == name, at) if known is None else known.when(F.col("session") == name, at)
    own = by_session.where(F.col("session").isin("asia", "london")).withColumn("available_from", known)
    session = own.select(*by, "trading_day", "available_from", F.explode(F.array(*[F.struct(F.concat("session", F.lit(f"_{e}")).alias("name"), F.col(f"{e}_ticks").alias("ticks")) for e in ("high", "low")])).alias("x")).select(*by, "trading_day", "x.name", "x.ticks", "available_from")
    order, side = F.create_map(*[x for i, n in enumerate(LEVEL_ORDER) for x in (F.lit(n), F.lit(i))]), F.create_map(*[x for n, s in LEVEL_SIDE.items() for x in (F.lit(n), F.lit(s))])
    out = prior.unionByName(session).select(*by, "trading_day", "name", (F.col("ticks") * tick_size).alias("price"), side[F.col("name")].alias("side"), "available_from", order[F.col("name")].alias("ordinal"))
    return out if static is None else out.unionByName(static)
