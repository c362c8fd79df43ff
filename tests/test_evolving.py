"""Zones known at each close against the stream with its own levels, outcomes by blocks, and several instruments."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.config import EASTERN, LabelPolicy
from tapeloom.operators import bars, dataset, evolving, outcomes
from tapeloom.sources.tape import tape_events, tape_symbols
from tapeloom.streaming import runs

SF = "/root/testdata/sf0.001"
COLUMNS = ("trading_day", "bar_index", "representative_price", "direction", "level_type")
STATIC = (("mid", 68300.0 * 0.25, "LOW"), ("top", 68900.0 * 0.25, "HIGH"))


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize("static", [(), STATIC])
def test_relations_equal_the_stream(spark, static):
    got = runs.run_to_end(tape_symbols(spark, SF).drop("price"), batches=3, sizes=(7,), static_levels=static, carry_prior_day=True)
    stream = as_set(got.where("kind = 'touch'"), "symbol", *COLUMNS)
    batch = as_set(evolving.runtime_touches(tape_symbols(spark, SF), 7, EASTERN, static=static, by=("symbol",)), "symbol", *COLUMNS)
    assert stream == batch and len(batch) > 30


def test_plan_has_no_python(spark):
    plan = evolving.runtime_touches(tape_events(spark, SF), 7, EASTERN)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


BAR = "trading_day date, bar_index long, close_ts timestamp_ntz, high_ticks long, low_ticks long"
ENTRY = "trading_day date, zone_id long, direction string, entry_price double, a timestamp_ntz, b timestamp_ntz"
DAY = date(2025, 6, 2)
START = datetime(2025, 6, 2, 14)


def plain(entry, path, p):
    """The ladder over a list of (close_ts, high, low) in points, one bar after another."""
    _, zone, way, price, after, before = entry
    mfe = mae = 0.0
    n, found = 0, None
    for ts, high, low in path:
        if not after < ts < before:
            continue
        up, down = high - price, price - low
        mfe, mae = max(mfe, up if way == "LONG" else down), max(mae, down if way == "LONG" else up)
        loss = "trap_reversal" if mfe >= p.trap_min else "aggressive_blowthrough"
        label = loss if mae >= p.sl else "tradeable_reversal" if mfe >= p.tp else loss if p.forced else None
        if label and not found:
            found = (label, mfe, mae, n)
        n += 1
    return (zone, *(found or ("no_resolution", mfe, mae, -1)), n)


@pytest.mark.parametrize("forced", [False, True])
def test_outcomes_by_blocks(spark, forced):
    """Entries at the edges of blocks and within them, decided early, late or never, against a plain loop."""
    p = LabelPolicy(forced=forced)
    path = [(START + timedelta(seconds=i), 100 + (i * 7 % 90) / 9 + i / 40, 97 + (i * 5 % 70) / 9 - i / 30) for i in range(700)]
    path = [(t, round(h * 4) / 4, round(lo * 4) / 4) for t, h, lo in path]
    entries = [(DAY, i, "LONG" if i % 2 else "SHORT", 100.0 + i % 5, START + timedelta(seconds=a), START + timedelta(seconds=b)) for i, (a, b) in enumerate([(-1, 900), (0, 64), (63, 65), (64, 128), (62, 66), (100, 101), (10, 700), (127, 640), (690, 900), (300, 330), (5, 6), (63, 700), (64, 700)])]
    b = spark.createDataFrame([(DAY, i, t, int(h * 4), int(lo * 4)) for i, (t, h, lo) in enumerate(path)], BAR)
    e = spark.createDataFrame(entries, ENTRY)
    got = {(r.zone_id, r.label, r.max_mfe, r.max_mae, r.bars_to_resolution, r.n_forward) for r in outcomes.resolve(e, b, p, "a", "b").collect()}
    want = {plain(x, path, p) for x in entries}
    assert got == {w for w in want if w[-1]} and len({w[1] for w in got}) > 1
    kept = outcomes.resolve(e, b, p, "a", "b", keep=("entry_price",))
    assert kept.count() == len(entries) and kept.where("n_forward = 0 and label is not null").count() == 0


def test_an_entry_meets_blocks(spark):
    n = 10_000
    b = spark.range(n).select(F.lit(DAY).alias("trading_day"), F.col("id").alias("bar_index"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("close_ts"), F.lit(400).cast("long").alias("high_ticks"), F.lit(400).cast("long").alias("low_ticks"))
    e = spark.createDataFrame([(DAY, z, "LONG", 100.0, START + timedelta(seconds=50 * z), START + timedelta(seconds=20_000)) for z in range(5)], ENTRY)
    joined = outcomes.entries_by_block(e, b, "a", "b").groupBy("zone_id").count().collect()
    assert all(r["count"] <= n // outcomes.BLOCK_BARS + 1 for r in joined) and len(joined) == 5


def test_symbols_do_not_meet(spark):
    """The chain over a tape of three symbols gives each what it gets alone."""
    tape = tape_symbols(spark, SF)
    quotes = tape.select("symbol", "ts_event", "sequence", (F.col("price_ticks") - 1).alias("bid_ticks"), (F.col("price_ticks") + 2).alias("ask_ticks"))
    together = dataset.training_rows(tape, quotes, 5, by=("symbol",)).where("symbol = 'S1'").drop("symbol")
    alone = dataset.training_rows(tape.where("symbol = 'S1'").drop("symbol"), quotes.where("symbol = 'S1'").drop("symbol"), 5)
    assert set(map(tuple, together.collect())) == set(map(tuple, alone.collect()))
    assert bars.tick_bars(tape, 5, EASTERN, by=("symbol",)).groupBy("symbol").count().count() == 3
