"""The stream against the batch operators, its state, and the controllers' life cycles."""

import time
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.config import CENTRAL, EASTERN, TICK_SIZE
from tapeloom.functions.calendar import with_session
from tapeloom.operators import bars, touches, zones
from tapeloom.sources import market
from tapeloom.sources.tape import tape_book, tape_events, tape_lineitem
from tapeloom.streaming import runs
from tapeloom.streaming.controllers import Live, Replay, clean_metadata
from tapeloom.streaming.engine import Clock, Settings, in_order, micros, packed, read_snapshot, tape_stream, unpacked

SF = "/root/testdata/sf0.001"
STATIC = (("mid", 68300.0 * 0.25, "LOW"), ("top", 68900.0 * 0.25, "HIGH"))
BAR = ["trading_day", "bar_index", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count", "close_reason"]
TOUCH = ["trading_day", "bar_index", "ts", "representative_price", "direction", "level_type"]
EVENT = "symbol string, kind string, ts_event timestamp_ntz, sequence long, price_ticks long, size long, side string, bid_ticks long, ask_ticks long, code string, message string"


def replayed(spark, batches, tmp_path, **settings):
    """(rows, replay) that the stream gives for micro-batches of events."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.05)  # files are taken in order of their times
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = tmp_path / "out"
    out.mkdir()
    replay = Replay(tape_stream(stream, **settings), f"{tmp_path}/cp", lambda df, i: df.write.mode("append").parquet(str(out)))
    replay.start()
    assert replay.wait() == "completed", replay.error
    return spark.read.schema(replay.stream.schema).parquet(str(out)), replay


def cut(spark, events, n_batches, end="end"):
    """events in n_batches by time; then an end row for each symbol, or a clock row of no symbol."""
    edges = [r[0] for r in events.selectExpr(f"explode(percentile_approx(ts_event, array({', '.join(str(k / n_batches) for k in range(1, n_batches))})))").collect()] if n_batches > 1 else []
    full = events if "kind" in events.columns else events.withColumn("kind", F.lit("trade"))
    part = F.lit(0)
    for e in edges:
        part = part + (F.col("ts_event") > F.lit(e)).cast("int")
    full = full.withColumn("_p", part).cache()
    last = full.agg(F.max("ts_event")).first()[0]
    if end == "end":
        more = full.select("symbol").distinct().withColumns({"kind": F.lit("end"), "ts_event": F.lit(last).cast("timestamp_ntz")})
    else:
        more = spark.createDataFrame([("", "clock", last + timedelta(days=2))], "symbol string, kind string, ts_event timestamp_ntz")
    return [full.where(f"_p = {i}").drop("_p") for i in range(n_batches)] + [full.drop("_p").limit(0).unionByName(more, allowMissingColumns=True)]


def rows_of(spark, *rows):
    """Events from dicts."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    return spark.createDataFrame([tuple({"symbol": "AA", "kind": "trade", "sequence": i, "size": 1, "side": "A", **r}.get(n) for n in names) for i, r in enumerate(rows)], EVENT)


def trade(ts, price, **more):
    return {"ts_event": ts, "price_ticks": price, **more}


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


@pytest.mark.parametrize(("source", "end"), [("events", "end"), ("events", "clock"), ("ties", "clock")])
def test_stream_equals_batch(spark, tmp_path, source, end):
    """Every bar, those of the last day too, which an end row or a timer closes, and every touch under static levels."""
    if source == "events":
        tape = tape_events(spark, SF)
    else:  # several trades at an instant, equal numbers, buys and sells: only the whole key orders them
        whole = tape_lineitem(spark, SF)
        first = whole.agg(F.min("ts_event")).first()[0] + timedelta(days=300)
        tape = whole.where((F.col("ts_event") >= F.lit(first)) & (F.col("ts_event") < F.lit(first + timedelta(days=40)))).withColumns({"ts_event": F.date_trunc("hour", "ts_event").cast("timestamp_ntz"), "sequence": F.col("sequence") % 2, "side": F.when(F.col("size") % 3 == 0, "B").otherwise("A")})
    symbol = F.concat(F.lit("S"), (F.hour("ts_event") % 3).cast("string")) if source == "ties" else F.lit("AA")
    tape = tape.withColumn("symbol", symbol).select("symbol", "ts_event", "sequence", "price_ticks", "size", "side")
    low, high = tape.selectExpr("percentile_approx(price_ticks, 0.3)", "percentile_approx(price_ticks, 0.8)").first()
    static = STATIC if source == "events" else (("mid", low * TICK_SIZE, "LOW"), ("top", high * TICK_SIZE, "HIGH"))
    batches = cut(spark, tape, 3, end)
    got, replay = replayed(spark, batches, tmp_path, sizes=(7, 3), static_levels=static, own_levels=False)
    assert replay.events == sum(b.count() for b in batches)
    for n in (3, 7):
        assert as_set(got.where(f"kind = 'bar' and timeframe_ticks = {n}"), "symbol", *BAR) == as_set(bars.tick_bars(tape, n, EASTERN, by=("symbol",)), "symbol", *BAR)
    batch = bars.tick_bars(tape, 3, EASTERN, by=("symbol",))
    fixed = spark.createDataFrame([(n, p, s, None, i) for i, (n, p, s) in enumerate(static)], "name string, price double, side string, available_from timestamp_ntz, ordinal int")
    days = batch.select("symbol", "trading_day").distinct().join(F.broadcast(fixed), F.lit(True))
    want = as_set(touches.first_touches(batch, zones.merge_levels(days, by=("symbol",)), by=("symbol",)).withColumnRenamed("bar_ts", "ts"), "symbol", *TOUCH)
    assert as_set(got.where("kind = 'touch'"), "symbol", *TOUCH) == want and len(want) > 4


def test_batches_do_not_matter(spark, tmp_path):
    """The same rows, with the stream's own levels and carried days, in one micro-batch or in seven."""
    tape = tape_events(spark, SF).withColumn("symbol", F.lit("AA")).select("symbol", "ts_event", "sequence", "price_ticks", "size", "side")
    found = []
    for n in (1, 7):
        got, _ = replayed(spark, cut(spark, tape, n), tmp_path / str(n), sizes=(5, 2), carry_prior_day=True)
        found.append((as_set(got.where("kind = 'bar'"), "timeframe_ticks", *BAR), as_set(got.where("kind = 'touch'"), *TOUCH)))
    assert found[0] == found[1] and len(found[0][1]) > 20


@pytest.mark.parametrize("scheme", [EASTERN, CENTRAL])
def test_clock_equals_the_calendar(spark, scheme):
    ts = [datetime(2025, 3, 8) + timedelta(minutes=17 * i) for i in range(400)] + [datetime(2025, 11, 1) + timedelta(minutes=11 * i) for i in range(400)]
    want = [(r.trading_day, r.session) for r in with_session(spark.createDataFrame([(t,) for t in ts], "ts_event timestamp_ntz"), scheme).orderBy("ts_event").collect()]
    clock = Clock(scheme)
    day, session = clock.place(np.array([micros(t) for t in ts]))
    assert [(None if s == -2 else date(1970, 1, 1) + timedelta(days=int(d)), clock.name(s)) for d, s in zip(day, session, strict=True)] == want


def test_quotes_warnings_and_snapshot(spark, tmp_path):
    """Typed events of a book: quotes only replace the last one, warnings come out, and the state tables give a snapshot."""
    events, _ = market.book_events(tape_book(spark, SF).drop("price_ticks"))
    events = events.withColumn("symbol", F.lit("AA")).unionByName(spark.createDataFrame([("AA", "warning", datetime(2024, 1, 3), "x_code", "seen")], "symbol string, kind string, ts_event timestamp_ntz, code string, message string"), allowMissingColumns=True)
    got, replay = replayed(spark, cut(spark, events, 3)[:3], tmp_path, sizes=(7, 3), prior_days=(("AA", date(2023, 12, 31), 69000, 68000), ("BB", date(2023, 12, 31), 2, 1)), carry_prior_day=True)
    trades = events.where("kind = 'trade'")
    every = bars.tick_bars(trades, 7, EASTERN)
    last_day = every.agg(F.max("trading_day")).first()[0]
    open_ = every.where((F.col("trading_day") == F.lit(last_day)) & ~F.col("is_complete")).collect()
    assert as_set(got.where("kind = 'bar' and timeframe_ticks = 7"), *BAR) == as_set(every.where(F.col("is_complete") | (F.col("trading_day") < F.lit(last_day))), *BAR)
    assert as_set(got.where("kind = 'warning'"), "code", "message") == {("x_code", "seen")} and replay.warnings == 1
    (kept,) = read_snapshot(spark, f"{tmp_path}/cp").collect()
    last = events.where("kind = 'quote'").orderBy(F.desc("ts_event"), F.desc("sequence")).first()
    assert (kept.symbol, kept.trading_day, kept.status, kept.quote.bid_ticks, kept.quote.ask_ticks) == ("AA", last_day, "degraded", last.bid_ticks, last.ask_ticks)
    assert kept.events == events.where("kind != 'warning'").count() and [(n.code, n.message) for n in kept.notes] == [("x_code", "seen")]
    assert [(c.timeframe_ticks, c.trade_count, c.close_ticks, c.bar_index) for c in kept.current if c.timeframe_ticks == 7] == [(7, b.trade_count, b.close_ticks, b.bar_index) for b in open_]
    closed = every.where("is_complete").orderBy(F.desc("close_ts")).first()
    assert max(r.close_ts for r in kept.recent if r.timeframe_ticks == 7 and r.close_reason == "complete") == closed.close_ts and len(kept.recent) <= 500
    prior = every.where(F.col("trading_day") < F.lit(last_day)).groupBy("trading_day").agg(F.max("high_ticks").alias("h"), F.min("low_ticks").alias("lo")).orderBy(F.desc("trading_day")).first()
    levels = {v.name: v.price for v in kept.levels}
    assert levels["pdh"] == prior.h * 0.25 and levels["pdl"] == prior.lo * 0.25
    touched = as_set(got.where(F.col("kind") == "touch").where(F.col("trading_day") == F.lit(last_day)), "representative_price", "level_type")
    assert kept.zones and all(z.touched == ((z.price, z.names[0]) in touched) for z in kept.zones)


def test_longer_tables_are_more_batches(spark, monkeypatch):
    """Rows of a micro-batch are bounded, also where one instant has more rows than that; the bars are those of the whole table."""
    tape = tape_events(spark, SF).withColumns({"symbol": F.lit("AA"), "ts_event": F.date_trunc("month", "ts_event").cast("timestamp_ntz"), "sequence": F.col("sequence") % 50}).drop("price")
    want = as_set(bars.tick_bars(tape, 7, EASTERN), *BAR)
    found = []
    for most in (10_000_000, tape.count() // 5):
        monkeypatch.setattr(runs, "BATCH_ROWS", most)
        got = runs.run_to_end(tape, sizes=(7,), own_levels=False)
        assert as_set(got.where("kind = 'bar'"), *BAR) == want and got.where("kind = 'warning'").count() == 0
        found.append(len({f.split("batch=")[1].split("/")[0] for f in got.inputFiles()}))
    assert found[0] <= 2 and found[1] >= 5


def test_rows_reach_the_processor_as_blocks():
    """A row for each symbol of what a task reads, whatever the number of its events, with nulls as they were."""
    n = 3000
    rows = pa.table({
        "symbol": pa.array([[None, "A", "B"][i % 3] for i in range(n)], pa.string()), "kind": ["trade"] * n,
        "ts_event": pa.array([None if i % 3 == 0 else i for i in range(n)], pa.timestamp("us")), "sequence": pa.array([None if i == 7 else 2**60 - i for i in range(n)], pa.int64()),
    })
    (out,) = packed(iter(rows.to_batches(max_chunksize=100)))
    assert sorted(out.column("symbol").to_pylist(), key=str) == ["A", "B", None]
    for symbol, last, block in zip(*(c.to_pylist() for c in out.columns), strict=True):
        events = unpacked([block])
        k = [None, "A", "B"].index(symbol)
        assert len(events) == n // 3 and (last is None) == (symbol is None) and events["price_ticks"].isna().all()
        assert events["sequence"].isna().sum() == (symbol == "A") and (symbol == "A" or events["sequence"].tolist() == [2**60 - i for i in range(k, n, 3)])
        assert len(in_order(events)) == len(events)


def test_late_trades_between_batches(spark, tmp_path):
    early = rows_of(spark, *[trade(datetime(2025, 6, 2, 14, m), 400 + m) for m in (0, 5)])
    late_rows = rows_of(spark, *[trade(datetime(2025, 6, 2, 14, m), 400 + m) for m in (3, 6)])
    for late, want in (("process", [400, 405, 403, 406]), ("drop", [400, 405, 406])):
        got, replay = replayed(spark, [early, late_rows], tmp_path / late, sizes=(1, 2), late=late, own_levels=False)
        assert as_set(got.where("kind = 'warning'"), "code", "message") == {("timestamp_regression", "earlier than 2025-06-02T14:05:00")} and replay.warnings == 1
        assert [r.close_ticks for r in got.where("kind = 'bar' and timeframe_ticks = 1").orderBy("bar_index").collect()] == want
        assert read_snapshot(spark, f"{tmp_path}/{late}/cp").first().regressions == 1


def test_days_that_come_again_and_resets(spark, tmp_path):
    """A day that comes again goes on with its numbers and its zones stay touched; a reset forgets the day, but not earlier ranges."""
    at = lambda d, h, m=0: datetime(2025, 6, d, h, m)
    batches = [
        [trade(at(2, 13), 400), trade(at(2, 13, 1), 400)],  # touches the prior day's low, once
        [trade(at(3, 13), 500)],
        [trade(at(2, 15), 400)],  # the day before again
        [{"kind": "quote", "ts_event": at(2, 15, 1), "bid_ticks": 1, "ask_ticks": 2}, {"kind": "reset", "ts_event": at(2, 15, 2)}],
        [trade(at(2, 16), 400)],  # touches again, with number 0
    ]
    got, _ = replayed(spark, [rows_of(spark, *b) for b in batches], tmp_path, sizes=(1,), prior_days=(("AA", date(2025, 6, 1), 800, 400),))
    found = got.where("kind = 'bar'").select("trading_day", "bar_index", "ts").orderBy("ts").collect()
    assert [(r.trading_day.day, r.bar_index) for r in found] == [(2, 0), (2, 1), (2, 2), (2, 0), (3, 0)]
    assert [(r.ts, r.level_type, r.direction) for r in got.where("kind = 'touch'").orderBy("ts").collect()] == [(at(2, 13), "pdl", "LONG"), (at(2, 16), "pdl", "LONG")]
    kept = read_snapshot(spark, f"{tmp_path}/cp").first()
    assert kept.quote is None and kept.events == 1 and [z.touched for z in kept.zones if z.names == ["pdl"]] == [True]


def test_rows_that_lack_something(spark, tmp_path):
    """Trades and quotes without a time, a price or a size are noted; an empty stream gives nothing."""
    day = datetime(2025, 6, 2, 14)
    bad = [trade(None, 400), trade(day, None), trade(day, 400, size=None), {"kind": "quote", "ts_event": day, "bid_ticks": 1}, {"kind": "quote", "ts_event": None, "bid_ticks": 1, "ask_ticks": 2}]
    got, _ = replayed(spark, [rows_of(spark, *bad, trade(day, 401), trade(day, 402))], tmp_path, sizes=(2,))
    assert sorted((r.code, r.message, r.ts) for r in got.where("kind = 'warning' and ts is not null").collect()) == [("invalid_record", "quote record rejected", day), ("invalid_record", "trade record rejected", day), ("invalid_record", "trade record rejected", day)]
    assert sorted(r.message for r in got.where("kind = 'warning' and ts is null and code = 'invalid_timestamp'").collect()) == ["quote record rejected", "trade record rejected"]
    assert [(r.open_ticks, r.close_ticks) for r in got.where("kind = 'bar'").collect()] == [(401, 402)] and read_snapshot(spark, f"{tmp_path}/cp").first().events == 2
    empty = runs.run_to_end(tape_events(spark, SF).drop("price").withColumn("symbol", F.lit("AA")).limit(0))
    assert empty.count() == 0 and "close_ticks" in empty.columns


def test_notes_and_bars_are_bounded(spark, tmp_path):
    first = datetime(2025, 6, 2, 13)
    batches = [rows_of(spark, *[trade(first + timedelta(seconds=60 * b + i), 400 + i) for i in range(30)], *[{"kind": "warning", "ts_event": first, "code": f"c{b}", "message": "m"}] * 30) for b in range(3)]
    replayed(spark, batches, tmp_path, sizes=(1,), recent_bars=40, recent_notes=50)
    kept = read_snapshot(spark, f"{tmp_path}/cp").first()
    assert len(kept.recent) == 40 and {r.bar_index for r in kept.recent} == set(range(50, 90))
    assert len(kept.notes) == 50 and {n.code for n in kept.notes} == {"c1", "c2"} and kept.status == "degraded"


def test_a_timer_waits_for_the_day_to_end(spark, tmp_path):
    """Another symbol's later events close a quiet symbol's day, after the delay, and not before."""
    day = datetime(2025, 6, 2, 14)
    quiet, busy = rows_of(spark, trade(day, 400)), lambda h: rows_of(spark, trade(datetime(2025, 6, 2, 22) + timedelta(hours=h), 500, symbol="BB"))
    early, _ = replayed(spark, [quiet, busy(0.5)], tmp_path / "early", sizes=(3,), delay_min=60)
    assert early.where("symbol = 'AA'").count() == 0
    late, _ = replayed(spark, [quiet, busy(1.5)], tmp_path / "late", sizes=(3,), delay_min=60)
    assert [(r.trade_count, r.close_reason) for r in late.where("symbol = 'AA'").collect()] == [(1, "end_of_day")]


def test_settings():
    with pytest.raises(ValueError):
        Settings(sizes=())
    with pytest.raises(ValueError):
        Settings(sizes=(0, 3))
    with pytest.raises(ValueError):
        Settings(late="maybe")
    assert Settings(sizes=(9, 3, 9)).sizes == (3, 9)


def test_prior_days_are_checked(spark):
    with pytest.raises(ValueError):
        tape_stream(rows_of(spark, trade(datetime(2025, 6, 2), 1)), prior_days=(("AA", date(2025, 6, 1), 1, 2),))


def files(spark, tmp_path, n, odd=None):
    for i in range(n):
        pd.DataFrame({"kind": [odd if odd and i == n - 1 else "trade"], "ts": [datetime(2025, 6, 2, 14, i)]}).to_parquet(f"{tmp_path}/{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(0.02)
    return spark.readStream.schema("kind string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_replay(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream, seen = files(spark, tmp_path / "in", 6), []
    replay = Replay(stream, f"{tmp_path}/cp", lambda df, i: seen.append(df.count()), max_events=2)
    assert replay.state == "idle"
    replay.start()
    with pytest.raises(RuntimeError):
        replay.start()
    assert replay.wait() in ("stopped", "completed") and replay.events >= 2
    replay.reset(f"{tmp_path}/cp2")
    assert replay.state == "idle"
    replay.max_events = None
    seen.clear()
    replay.start()
    replay.pause()
    assert replay.state == "paused"
    replay.resume()
    assert replay.wait() == "completed" and sum(seen) == 6 and replay.started <= replay.ended
    paced = Replay(stream, f"{tmp_path}/cp3", lambda df, i: None, speed=240.0)  # a minute between events is a quarter of a second
    began = time.monotonic()
    paced.start()
    assert paced.wait() == "completed" and time.monotonic() - began > 5 * 0.25


def test_failures_are_told_without_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = files(spark, tmp_path / "in", 2)

    def broken(df, i):
        raise OSError("no /srv/feed/x.sock, token=abc")

    replay = Replay(stream, f"{tmp_path}/cp", broken)
    replay.start()
    assert replay.wait() == "failed" and "srv" not in replay.error and "abc" not in replay.error


def test_live(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    live = Live(files(spark, tmp_path / "in", 2, odd="warning"), f"{tmp_path}/cp", lambda df, i: seen.append(df.count()), interval="100 milliseconds")
    live.start()
    assert live.state == "running"
    with pytest.raises(RuntimeError):
        live.start()
    until = time.monotonic() + 60
    while sum(seen) < 2 and time.monotonic() < until:
        live.wait(0.2)
    live.stop()
    assert (live.state, sum(seen), live.events, live.warnings) == ("stopped", 2, 2, 1) and live.ended
    live.start()
    live.query.stop()
    assert live.wait(30) == "disconnected"
    bad = Live(spark.range(1), f"{tmp_path}/cp2", lambda df, i: None)
    with pytest.raises(Exception):
        bad.start()
    assert bad.state == "failed" and bad.error


def test_metadata():
    assert clean_metadata({"api_key": 1, "path": "/a/b/c", "n": 2}) == {"<redacted_key>": 1, "path": "<path>", "n": 2}
