"""Outcome of entries: a running-extremum ladder over the bars that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LABELS, TICK_SIZE, UNRESOLVED, LabelPolicy, Scheme
from ..functions.calendar import instant_on, micros_of, micros_of_day, to_local
from .features import KEY, _minutes
from .ordering import canonical_key
from .touches import renamed, same


def ladder(mfe: Column, mae: Column, p: LabelPolicy) -> Column:
    """Adverse first; null if nothing is decided and the policy does not force it."""
    loss = F.when(mfe >= p.trap_min, "trap_reversal").otherwise("aggressive_blowthrough")
    out = F.when(mae >= p.sl, loss).when(mfe >= p.tp, "tradeable_reversal")
    return out.otherwise(loss) if p.forced else out


def encode(label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[label]


#: Bars of a block. An entry meets blocks, and looks into bars only where a block begins or ends in its time, or decides.
BLOCK_BARS = 64


def bar_blocks(bars: DataFrame, by: tuple[str, ...] = (), size: int = BLOCK_BARS) -> DataFrame:
    """(_of_by, _of_trading_day, _block, _first, _last, _high, _low, _bars): each run of bars of a day with its extremes, and the bars in order."""
    day = (*by, "trading_day")
    b = bars.select(*renamed(day), F.expr(f"bar_index div {int(size)}").alias("_block"), F.col("bar_index").alias("i"), "close_ts", "high_ticks", "low_ticks")
    each = F.struct("i", "close_ts", "high_ticks", "low_ticks")
    return b.groupBy(*("_of_" + n for n in day), "_block").agg(F.min("close_ts").alias("_first"), F.max("close_ts").alias("_last"), F.max("high_ticks").alias("_high"), F.min("low_ticks").alias("_low"), F.array_sort(F.collect_list(each)).alias("_bars"))


def entries_by_block(entries: DataFrame, bars: DataFrame, after: str, before: str, by: tuple[str, ...] = (), how: str = "inner", size: int = BLOCK_BARS) -> DataFrame:
    """Entries with each block that has a bar strictly between after and before, and of that block the bars that do (_in)."""
    day = (*by, "trading_day")
    ahead = same(day) & (F.col("_last") > F.col(after)) & (F.col("_first") < F.col(before)) & F.col("entry_price").isNotNull()
    met = entries.join(bar_blocks(bars, by, size), ahead, how).drop(*("_of_" + n for n in day))
    whole = (F.col("_first") > F.col(after)) & (F.col("_last") < F.col(before))
    return met.withColumn("_whole", whole).withColumn("_in", F.when(F.col("_whole"), F.col("_bars")).otherwise(F.filter("_bars", lambda x: (x["close_ts"] > F.col(after)) & (x["close_ts"] < F.col(before))))).drop("_bars", "_first", "_last")


def resolve(entries: DataFrame, bars: DataFrame, p: LabelPolicy, after: str, before: str, tick_size: float = TICK_SIZE, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(key, label, label_encoded, max_mfe, max_mae, bars_to_resolution, n_forward) of entries (key, direction, entry_price, after, before).

    Bars of the day that close strictly between after and before; extremes start at 0. With keep, entries without
    a price or such a bar stay too, with nulls, and so do these columns. The extremes of blocks of bars tell in which
    block the ladder is decided, and only that one's bars are gone through.
    """
    key = (*by, *KEY)
    met = entries_by_block(entries, bars, after, before, by, "left" if keep else "inner")
    long, entry = F.col("direction") == "LONG", F.col("entry_price")
    gain = lambda high, low: F.when(long, high * tick_size - entry).otherwise(entry - low * tick_size)
    loss = lambda high, low: F.when(long, entry - low * tick_size).otherwise(high * tick_size - entry)
    of_block = lambda f: F.when(F.col("_whole"), f(F.col("_high"), F.col("_low"))).otherwise(F.array_max(F.transform("_in", lambda x: f(x["high_ticks"], x["low_ticks"]))))
    w = Window.partitionBy(*key).orderBy("_block")
    run, was = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    steps = met.withColumns({"_gain": of_block(gain), "_loss": of_block(loss), "_n": F.when(F.col("_block").isNotNull(), F.size("_in")).otherwise(0)}).withColumns({
        "_mfe": F.greatest(zero, F.max("_gain").over(run)), "_mae": F.greatest(zero, F.max("_loss").over(run)), "_mfe0": F.greatest(zero, F.max("_gain").over(was)), "_mae0": F.greatest(zero, F.max("_loss").over(was)), "_k0": F.coalesce(F.sum("_n").over(was), F.lit(0)),
    })
    decides = F.col("_block").isNotNull() & (F.col("_n") > 0) & ladder(F.col("_mfe"), F.col("_mae"), p).isNotNull()
    pick = F.min(F.when(decides, F.struct("_block", "_k0", "_mfe0", "_mae0", "_in")))
    g = steps.groupBy(*key, "direction", "entry_price", *(k for k in keep if k not in ("direction", "entry_price"))).agg(pick.alias("_d"), F.max("_mfe").alias("_mfe"), F.max("_mae").alias("_mae"), F.sum("_n").alias("n_forward"))

    def step(acc: Column, x: Column) -> Column:
        mfe, mae = F.greatest(acc["mfe"], gain(x["high_ticks"], x["low_ticks"])), F.greatest(acc["mae"], loss(x["high_ticks"], x["low_ticks"]))
        return F.when(acc["label"].isNotNull(), acc).otherwise(F.struct((acc["k"] + 1).alias("k"), mfe.alias("mfe"), mae.alias("mae"), ladder(mfe, mae, p).alias("label")))

    start = F.struct((F.col("_d._k0") - 1).cast("long").alias("k"), F.col("_d._mfe0").alias("mfe"), F.col("_d._mae0").alias("mae"), F.lit(None).cast("string").alias("label"))
    done = (g if keep else g.where("n_forward > 0")).withColumn("d", F.when(F.col("_d").isNotNull(), F.aggregate("_d._in", start, step)))
    some = lambda c: F.when(F.col("n_forward") > 0, c)
    label = some(F.coalesce("d.label", F.lit(UNRESOLVED)))
    return done.select(*key, *keep, label.alias("label"), encode(label).alias("label_encoded"), some(F.round(F.coalesce("d.mfe", "_mfe"), 4)).alias("max_mfe"), some(F.round(F.coalesce("d.mae", "_mae"), 4)).alias("max_mae"), some(F.coalesce("d.k", F.lit(-1)).cast("int")).alias("bars_to_resolution"), "n_forward")


def asof_price(points: DataFrame, trades: DataFrame, at: str, tolerance_min: int, tick_size: float = TICK_SIZE, bucket_min: int = 60, how: str = "inner", keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, entry_price): the last trade in canonical order with at - tolerance <= ts_event <= at; keys without one are missing, or have a null in a left join.

    A backward as-of join by time buckets; the latest trade is kept by an aggregate, so nothing is sorted as a whole.
    """
    p = points.select(*by, *KEY, at, *keep)
    p = p.withColumn("_b", F.explode(F.expr(f"sequence(cast(floor(({_minutes(at)} - {tolerance_min} - 1) / {bucket_min}) as bigint), cast(floor({_minutes(at)} / {bucket_min}) as bigint))")))
    t = trades.select(*renamed(by), "ts_event", "sequence", "side", "size", "price_ticks", F.expr(f"cast(floor({_minutes('ts_event')} / {bucket_min}) as bigint)").alias("_own"))
    inside = (F.col("_b") == F.col("_own")) & (F.col("ts_event") <= F.col(at)) & (F.col("ts_event") >= F.col(at) - F.expr(f"INTERVAL {tolerance_min} MINUTE"))
    last = F.max(F.when(F.col("ts_event").isNotNull(), F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(canonical_key())], "price_ticks")))
    return p.join(t, inside & same(by) if by else inside, how).groupBy(*by, *KEY, *keep).agg((last["price_ticks"] * tick_size).alias("entry_price"))


def decided(priced: DataFrame, bars: DataFrame, p: LabelPolicy, scheme: Scheme, tick_size: float = TICK_SIZE, keep: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """An outcome or the reason of a drop (flatten, cutoff, no_fill, no_forward, in this order) for each touch (key, bar_ts, direction, entry_price), from the price at the decision."""
    decision = F.col("bar_ts") + F.expr(f"INTERVAL {p.decision_min} MINUTE")
    t = priced.withColumns({"decision_ts": decision, "_cutoff": instant_on(F.col("trading_day"), p.cutoff, scheme)})
    early = F.when(micros_of_day(to_local(F.col("decision_ts"), scheme)) >= micros_of(p.flatten), "flatten").when(F.col("decision_ts") >= F.col("_cutoff"), "cutoff")
    t = t.withColumn("_early", early).withColumn("entry_price", F.when(F.col("_early").isNull(), F.col("entry_price")))
    out = resolve(t, bars, p, "decision_ts", "_cutoff", tick_size, ("decision_ts", "entry_price", "_early", *keep), by)
    reason = F.coalesce("_early", F.when(F.col("entry_price").isNull(), "no_fill").when(F.col("label").isNull(), "no_forward"))
    return out.withColumn("drop_reason", reason).drop("_early", "n_forward")


def decision_outcomes(touches: DataFrame, bars: DataFrame, trades: DataFrame, p: LabelPolicy, scheme: Scheme, tick_size: float = TICK_SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """The outcomes of touches. Each touch meets the trades once, and the bars once."""
    points = touches.select(*by, *KEY, "direction", "bar_ts", (F.col("bar_ts") + F.expr(f"INTERVAL {p.decision_min} MINUTE")).alias("_at"))
    return decided(asof_price(points, trades, "_at", p.fill_tolerance_min, tick_size, how="left", keep=("direction", "bar_ts"), by=by), bars, p, scheme, tick_size, by=by)
