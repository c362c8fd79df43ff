"""Features around a touch, from one range join on time buckets.

Each touch is copied to the few buckets that its window meets; each event is in one bucket. The
join is an equi-join on the bucket with the exact bounds as a condition, so windows may cross the
day's boundary, no side need be broadcast, and a pair arises once. All features and the price at the
decision are conditional aggregates over the same joined rows; trades that only add to a sum are combined
before the shuffle, and only the few after the touch travel as rows, in an array by touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES_WITHOUT_FORMULA, TICK_SIZE, FeatureWindows
from .ordering import canonical_key
from .touches import renamed, same

BUCKET_MIN = 60
KEY = ("trading_day", "zone_id")


def _minutes(ts: str) -> str:
    return f"timestampdiff(MINUTE, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"


def _span(ts: str, before_min: int, after_min: int) -> Column:
    """The buckets that [ts - before, ts + after] meets."""
    bucket = lambda shift: f"cast(floor(({_minutes(ts)} + ({shift})) / {BUCKET_MIN}) as bigint)"
    return F.explode(F.expr(f"sequence({bucket(-before_min - 1)}, {bucket(after_min + 1)})"))


def _minute(n: int) -> Column:
    return F.expr(f"INTERVAL {n} MINUTE")


def window_join(touches: DataFrame, events: DataFrame, before_min: int, after_min: int, closed: bool = False, how: str = "inner", keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """touches x events with bar_ts - before <= ts_event < bar_ts + after (or <=, if closed).

    A left join gives each touch at least one row, with nulls for the event, in each of its buckets without a match.
    """
    t = touches.select(*by, *KEY, "bar_ts", "direction", "representative_price", *keep).withColumn("_b", _span("bar_ts", before_min, after_min))
    own = events.select(*renamed(by), *(c for c in events.columns if c not in by)).withColumn("_own", F.expr(f"cast(floor({_minutes('ts_event')} / {BUCKET_MIN}) as bigint)"))
    last = F.col("bar_ts") + _minute(after_min)
    inside = (F.col("_b") == F.col("_own")) & (F.col("ts_event") >= F.col("bar_ts") - _minute(before_min)) & ((F.col("ts_event") <= last) if closed else (F.col("ts_event") < last))
    return t.join(own, inside & same(by) if by else inside, how).drop("_b", "_own", *("_of_" + n for n in by))


def _adverse(points: Column, level: Column) -> Column:
    return F.when(F.col("direction") == "LONG", points < level).otherwise(points > level)


def _dwell(trades: Column, on, max_gap_s: int) -> Column:
    """Seconds that trades (an array in canonical order) spend where on(price) holds: a gap counts by the price at its start; too long ones are left out."""
    pairs = F.zip_with(trades, F.slice(trades, F.lit(2), F.greatest(F.size(trades) - 1, F.lit(0))), lambda x, y: F.struct(x["price_ticks"].alias("p"), F.when(y.isNotNull(), F.timestamp_diff("MICROSECOND", x["ts_event"], y["ts_event"])).alias("gap")))
    counts = lambda x: on(x["p"]) & (x["gap"] >= 0) & (x["gap"] <= max_gap_s * 1_000_000)
    return F.round(F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + F.when(counts(x), x["gap"]).otherwise(F.lit(0))) / 1e6, 4)


def _of_trades(cfg: FeatureWindows, tick_size: float, decision_min: int, tolerance_min: int) -> list[Column]:
    """Aggregates over joined trades: of the approach, of the interaction, and the last trade before the decision."""
    ts, bar, size = F.col("ts_event"), F.col("bar_ts"), F.col("size")
    after = (ts >= bar) & (ts < bar + _minute(cfg.interaction_min))
    before = (ts >= bar - _minute(cfg.approach_min)) & (ts < bar)
    decision = bar + _minute(decision_min)
    fill = (ts <= decision) & (ts >= decision - _minute(tolerance_min))
    points, level = F.col("price_ticks") * tick_size, F.col("representative_price")
    band = F.abs(points - level) <= cfg.proximity_pts
    vol = lambda on: F.sum(F.when(on, size))
    order = [c.alias(f"_k{i}") if i else c for i, c in enumerate(canonical_key())]
    return [
        F.array_sort(F.collect_list(F.when(after, F.struct(*order, "price_ticks")))).alias("_after"),
        vol(after & band).alias("_at"), vol(after & ~band & _adverse(points, level)).alias("_past"),
        vol(before).alias("_vol"), vol(before & (size >= cfg.large_size)).alias("_large"), F.count(F.when(before, 1)).alias("_n"),
        (F.max(F.when(fill, F.struct(*order, "price_ticks")))["price_ticks"] * tick_size).alias("entry_price"),
    ]


def _named(tick_size: float, cfg: FeatureWindows) -> dict[str, Column]:
    """The features of trades from the aggregates; null where nothing happened in their window."""
    level = F.col("representative_price")
    total = F.coalesce("_at", F.lit(0)) + F.coalesce("_past", F.lit(0))
    some = F.size("_after") > 0
    dwell = lambda on: F.when(some, _dwell(F.col("_after"), on, cfg.max_gap_s))
    return {
        "int_time_beyond_level": dwell(lambda p: _adverse(p * tick_size, level)),
        "int_time_within_2pts": dwell(lambda p: F.abs(p * tick_size - level) <= cfg.within_pts),
        "int_absorption_ratio": F.when(some, F.when(total > 0, F.round(F.coalesce("_at", F.lit(0)) / total, 6)).otherwise(0.0)),
        "app_large_trade_vol_pct": F.when((F.col("_n") > 0) & (F.col("_vol") > 0), F.coalesce("_large", F.lit(0)) / F.col("_vol")),
        "app_avg_trade_size": F.when(F.col("_n") > 0, F.col("_vol") / F.col("_n")),
    }


ZERO = ("int_time_beyond_level", "int_time_within_2pts", "int_absorption_ratio")
NULL = ("app_large_trade_vol_pct", "app_avg_trade_size", "app_max_spread")


def of_trades(touches: DataFrame, trades: DataFrame, cfg: FeatureWindows = FeatureWindows(), tick_size: float = TICK_SIZE, decision_min: int = 5, tolerance_min: int = 30, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(key, direction, representative_price, keep, n_after, n_before, features of trades, entry_price) for each touch, by one join with the trades."""
    base = (*by, *KEY, "direction", "representative_price", *keep)
    back, ahead = max(cfg.approach_min, tolerance_min - decision_min), max(cfg.interaction_min, decision_min)
    t = trades.select(*by, "ts_event", "sequence", "side", "size", "price_ticks")
    joined = window_join(touches, t, back, ahead, closed=True, how="left", keep=tuple(c for c in keep if c != "bar_ts"), by=by)
    found = joined.groupBy(*base).agg(*_of_trades(cfg, tick_size, decision_min, tolerance_min))
    named = _named(tick_size, cfg)
    return found.select(*base, F.size("_after").alias("n_after"), F.col("_n").alias("n_before"), *[c.alias(n) for n, c in named.items()], "entry_price")


def _some(touches: DataFrame, trades: DataFrame, cfg: FeatureWindows, tick_size: float, window: str, *names: str) -> DataFrame:
    return of_trades(touches, trades, cfg, tick_size).where(f"{window} > 0").select(*KEY, *names)


def dwell(touches: DataFrame, trades: DataFrame, cfg: FeatureWindows, tick_size: float = TICK_SIZE) -> DataFrame:
    """Seconds beyond the level and within the band, of touches with trades after them."""
    return _some(touches, trades, cfg, tick_size, "n_after", "int_time_beyond_level", "int_time_within_2pts")


def absorption(touches: DataFrame, trades: DataFrame, cfg: FeatureWindows, tick_size: float = TICK_SIZE) -> DataFrame:
    return _some(touches, trades, cfg, tick_size, "n_after", "int_absorption_ratio")


def approach(touches: DataFrame, trades: DataFrame, cfg: FeatureWindows) -> DataFrame:
    return _some(touches, trades, cfg, TICK_SIZE, "n_before", "app_large_trade_vol_pct", "app_avg_trade_size")


def spread(touches: DataFrame, quotes: DataFrame, cfg: FeatureWindows, tick_size: float = TICK_SIZE) -> DataFrame:
    q = quotes.select("ts_event", (F.col("ask_ticks") - F.col("bid_ticks")).alias("_spread"))
    return window_join(touches, q, cfg.approach_min, 0).groupBy(*KEY).agg((F.max("_spread") * tick_size).alias("app_max_spread"))


def touch_features(touches: DataFrame, trades: DataFrame, quotes: DataFrame, cfg: FeatureWindows = FeatureWindows(), tick_size: float = TICK_SIZE, names: tuple[str, ...] = (), nan: bool = False, least_trades: int = 0, decision_min: int = 5, tolerance_min: int = 30, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """All six for each touch: 0 where nothing happened after it, null (or NaN) where nothing came before.

    least_trades: touches with fewer trades after them are left out. keep: more columns of touches, and entry_price.
    """
    if missing := set(names) & set(FEATURES_WITHOUT_FORMULA):
        raise NotImplementedError(f"no formula is defined for {sorted(missing)}")
    held = ("bar_ts", *(c for c in keep if c not in ("bar_ts", "direction", "representative_price")))
    got = of_trades(touches, trades, cfg, tick_size, decision_min, tolerance_min, held, by)
    # Quotes join what the trades gave, a row a touch, so the touches are computed once.
    q = quotes.select(*by, "ts_event", (F.col("ask_ticks") - F.col("bid_ticks")).alias("_spread"))
    own = [c for c in got.columns if c not in (*by, *KEY, "bar_ts", "direction", "representative_price")]
    out = window_join(got, q, cfg.approach_min, 0, how="left", keep=tuple(own), by=by).groupBy(*got.columns).agg((F.max("_spread") * tick_size).alias("app_max_spread"))
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ZERO} | ({c: F.coalesce(c, F.lit(float("nan"))) for c in NULL} if nan else {}))
    if least_trades:
        out = out.where(F.col("n_after") >= least_trades)
    return out.select(*by, *KEY, *keep, *(["entry_price"] if keep else []), *ZERO, *NULL)
