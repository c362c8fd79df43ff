"""Exact edges of sessions, zones, touches, features, outcomes, normalising and contracts, on hand-made rows."""

import copy
from datetime import date, datetime, time

import pytest
from pyspark.sql import functions as F

from tapeloom import contract
from tapeloom.config import CENTRAL, EASTERN, FeatureWindows, LabelPolicy, Scheme, Session
from tapeloom.functions import ticks
from tapeloom.functions.calendar import day_bounds, instant_on, with_session
from tapeloom.operators import bars, diff, features, levels, outcomes, touches, zones
from tapeloom.sources import market

DAY = date(2025, 6, 2)


def at(h, m=0, s=0, us=0, day=DAY):
    return datetime(day.year, day.month, day.day, h, m, s, us)


def test_eastern_sessions(spark):
    want = [(at(21, 59), 2, "none"), (at(22), 3, "none"), (at(23), 3, "asia"), (at(4, 30), 2, "asia"), (at(6), 2, "asia"), (at(6, 44), 2, "asia"), (at(6, 45), 2, "none"), (at(7), 2, "london"), (at(12, 59), 2, "none"), (at(13), 2, "ny"), (at(20, 59, 59, 999999), 2, "ny"), (at(21), 2, "none")]
    df = spark.createDataFrame([(t,) for t, *_ in want], "ts_event timestamp_ntz")
    got = {r.ts_event: (r.trading_day.day, r.session) for r in with_session(df, EASTERN).collect()}
    assert got == {t: (d, s) for t, d, s in want}


def test_central_closed_window(spark):
    df = spark.createDataFrame([(at(20, 59),), (at(21),), (at(22),), (at(23),)], "ts_event timestamp_ntz")
    got = [(r.trading_day, r.session) for r in with_session(df, CENTRAL).orderBy("ts_event").collect()]
    assert got == [(DAY, "ny"), (None, "closed"), (None, "closed"), (date(2025, 6, 3), "asia")]


def test_clock_changes(spark):
    df = spark.createDataFrame([(date(2026, 3, 8),), (date(2026, 11, 1),)], "d date")
    got = [tuple(r) for r in df.select(instant_on(F.col("d"), time(2, 45), EASTERN), instant_on(F.col("d"), time(1, 30), EASTERN)).collect()]
    assert got[0][0] == datetime(2026, 3, 8, 7, 45) and got[1][1] == datetime(2026, 11, 1, 5, 30)


LEVEL = "trading_day date, name string, price double, side string, available_from timestamp_ntz, ordinal int"


def zoned(spark, *lv):
    return zones.merge_levels(spark.createDataFrame([(DAY, n, p, s, a, i) for i, (n, p, s, a) in enumerate(lv)], LEVEL)).orderBy("zone_id").collect()


def test_zones(spark):
    a, b = at(1), at(2)
    assert [z.representative_price for z in zoned(spark, ("x", 100.0, "LOW", a), ("y", 103.0, "LOW", b))] == [101.5]
    assert len(zoned(spark, ("x", 100.0, "LOW", a), ("y", 103.01, "LOW", b))) == 2
    (z,) = zoned(spark, ("x", 105.0, "HIGH", None), ("y", 102.5, "HIGH", b), ("z", 100.0, "LOW", a))
    assert (list(z.names), z.side, z.available_from) == (["z", "y", "x"], "HIGH", b)
    (z,) = zoned(spark, ("p", 100.0, "HIGH", None), ("q", 100.0, "LOW", None))
    assert (list(z.names), z.side, z.available_from) == (["p", "q"], "LOW", None)


BAR = "trading_day date, bar_index long, close_ts timestamp_ntz, high_ticks long, low_ticks long"
ZONE = "trading_day date, zone_id long, representative_price double, names array<string>, side string, available_from timestamp_ntz"


def test_touches(spark):
    b = spark.createDataFrame([(DAY, 0, at(14), 440, 400), (DAY, 1, at(15), 440, 400), (DAY, 2, at(16), 900, 800)], BAR)
    z = spark.createDataFrame([(DAY, 0, 100.0, ["pdl"], "LOW", None), (DAY, 1, 110.0, ["pdh", "k"], "HIGH", at(14, 30)), (DAY, 2, 110.25, ["n"], "LOW", None), (DAY, 3, 200.0, ["far"], "HIGH", at(15))], ZONE)
    got = [(r.zone_id, r.bar_index, r.direction, r.level_type, r.touch_order) for r in touches.first_touches(b, z).orderBy("touch_order").collect()]
    assert got == [(0, 0, "LONG", "pdl", 1), (1, 1, "SHORT", "pdh", 2), (3, 2, "SHORT", "far", 3)]
    assert [r.zone_id for r in touches.untouched(z, touches.first_touches(b, z)).collect()] == [2]


TOUCH = "trading_day date, zone_id long, bar_ts timestamp_ntz, direction string, representative_price double"
TRADE = "ts_event timestamp_ntz, sequence long, price_ticks long, size long, side string"


def test_dwell_and_absorption(spark):
    t = spark.createDataFrame([(DAY, 0, at(14), "LONG", 100.0), (DAY, 1, at(14), "SHORT", 100.0), (DAY, 2, at(3), "LONG", 100.0)], TOUCH)
    trades = spark.createDataFrame([(at(14, 0, s), i, p, 10, "A") for i, (s, p) in enumerate([(0, 99), (10, 101), (40, 98), (59, 100)])] + [(at(14, 12), 9, 90, 10, "B")], TRADE)
    w = FeatureWindows(interaction_min=20)
    got = {r.zone_id: r for r in features.dwell(t, trades, w, 1.0).collect()}
    assert got[0].int_time_beyond_level == 29 and got[1].int_time_beyond_level == 30 and got[0].int_time_within_2pts == 59
    gap = spark.createDataFrame([(at(14), 0, 99, 1, "A"), (at(14, 10), 1, 99, 1, "A"), (at(14, 19, 59), 2, 99, 1, "A")], TRADE)
    assert features.dwell(t, gap, w, 1.0).where("zone_id = 0").first().int_time_beyond_level == 600 + 599
    ab = spark.createDataFrame([(at(14), 0, 400, 40, "A"), (at(14, 1), 1, 396, 40, "A"), (at(14, 2), 2, 398, 0, "A")], TRADE)
    assert {r.zone_id: r.int_absorption_ratio for r in features.absorption(t, ab, FeatureWindows()).collect()} == {0: 0.5, 1: 1.0}
    quotes = spark.createDataFrame([(at(13, 59), 100, 104)], "ts_event timestamp_ntz, bid_ticks long, ask_ticks long")
    full = {r.zone_id: r for r in features.touch_features(t, ab, quotes).collect()}
    assert full[2].int_absorption_ratio == 0.0 and full[2].app_max_spread is None and full[0].app_max_spread == 1.0
    with pytest.raises(NotImplementedError):
        features.touch_features(t, ab, quotes, names=("app_trade_count",))


def entry(spark, direction="LONG", price=100.0):
    return spark.createDataFrame([(DAY, 0, direction, price, at(14), at(21))], "trading_day date, zone_id long, direction string, entry_price double, a timestamp_ntz, b timestamp_ntz")


def path(spark, *hl):
    return spark.createDataFrame([(DAY, i, at(14, 1 + i), int(h * 4), int(lo * 4)) for i, (h, lo) in enumerate(hl)] + [(DAY, 98, at(14), 999, 0), (DAY, 99, at(21), 999, 0)], BAR)


@pytest.mark.parametrize(("hl", "direction", "want"), [
    ([(101, 99), (116, 100)], "LONG", ("tradeable_reversal", 0, 16.0, 1.0, 1)), ([(116, 69)], "LONG", ("trap_reversal", 1, 16.0, 31.0, 0)), ([(104, 70)], "LONG", ("aggressive_blowthrough", 2, 4.0, 30.0, 0)),
    ([(105, 99), (101, 70)], "LONG", ("trap_reversal", 1, 5.0, 30.0, 1)), ([(101, 85)], "SHORT", ("tradeable_reversal", 0, 15.0, 1.0, 0)), ([(99, 98)], "LONG", ("no_resolution", None, 0.0, 2.0, -1)),
])
def test_ladder(spark, hl, direction, want):
    r = outcomes.resolve(entry(spark, direction), path(spark, *hl), LabelPolicy(), "a", "b").first()
    assert (r.label, r.label_encoded, r.max_mfe, r.max_mae, r.bars_to_resolution) == want


def test_drops(spark):
    t = spark.createDataFrame([(DAY, 0, at(20, 36), "LONG", 100.0), (DAY, 1, at(14), "LONG", 100.0), (DAY, 2, at(15), "LONG", 100.0), (DAY, 3, at(23, 30, day=date(2025, 6, 1)), "LONG", 100.0), (DAY, 4, at(20, 35), "LONG", 1.0)], TOUCH)
    trades = spark.createDataFrame([(at(14, 5), 1, 400, 1, "A"), (at(14, 5), 1, 404, 1, "B"), (at(14, 5, 1), 2, 500, 1, "B"), (at(14, 35), 3, 480, 1, "A")], TRADE)
    got = {r.zone_id: (r.drop_reason, r.entry_price) for r in outcomes.decision_outcomes(t, path(spark, (101, 99), (101, 100)), trades, LabelPolicy(), EASTERN).collect()}
    assert got == {0: ("flatten", None), 1: ("no_forward", 101.0), 2: ("no_forward", 120.0), 3: ("flatten", None), 4: ("flatten", None)}
    late = outcomes.decision_outcomes(t.where("zone_id = 0"), path(spark), trades, LabelPolicy(flatten=time(23), cutoff=time(16, 41)), EASTERN).first()
    assert late.drop_reason == "cutoff"
    none = outcomes.decision_outcomes(t.where("zone_id = 1"), path(spark), trades.where("sequence > 1"), LabelPolicy(), EASTERN).first()
    assert none.drop_reason == "no_fill"


def test_bars_and_levels(spark):
    tape = spark.createDataFrame([(at(13, i), i, 100 + i, 1, "A") for i in range(5)] + [(at(22, 1), 9, 50, 1, "A")], TRADE)
    got = bars.tick_bars(tape, (2, 2, 1), EASTERN).orderBy("timeframe_ticks", "trading_day", "bar_index").collect()
    assert [(b.timeframe_ticks, b.bar_id[-12:], b.trade_count, b.close_reason) for b in got][-4:] == [(2, "2025-06-02:0", 2, "complete"), (2, "2025-06-02:1", 2, "complete"), (2, "2025-06-02:2", 1, "end_of_day"), (2, "2025-06-03:0", 1, "end_of_day")]
    assert bars.tick_bars(tape.limit(0), 3, EASTERN).count() == 0
    with pytest.raises(ValueError):
        bars.tick_bars(tape, 0, EASTERN)
    b = bars.tick_bars(tape, 2, EASTERN)
    assert [tuple(r)[1:] for r in levels.prior_day(levels.full_day(b)).collect()] == [(104, 100)]
    assert diff.diff_by_key(b, b, ["bar_id"], ["open_ticks"]).where("status <> 'same'").count() == 0


def test_normalising(spark, tmp_path):
    raw = spark.createDataFrame([(at(14), 17000.0, 1, "b", 1), (at(14), 17000.1, 1, "A", 2), (at(14), None, 1, None, 3), (None, 1.0, 1, "A", 4), (at(14), float("inf"), 1, "A", 5), (at(14), 17000.25, 0, "A", 0)], "ts_event timestamp_ntz, price double, size long, side string, sequence long")
    good, notes = market.normalize_trades(raw)
    assert [(r.price_ticks, r.side) for r in good.collect()] == [(68000, "B")]
    assert sorted(r.code for r in notes.collect()) == ["invalid_price", "invalid_price", "invalid_price", "invalid_record", "invalid_timestamp"]
    assert market.normalize_trades(raw.withColumn("size", F.col("size").cast("double")))[0].count() == 0
    raw.write.parquet(f"{tmp_path}/t")
    events, notes = market.read_events(spark, [f"{tmp_path}/t"], "trades", start=at(13), end=at(14))
    assert events.count() == 0
    assert market.read_events(spark, [f"{tmp_path}/t"], "nope")[1].first().code == "unsupported_schema"
    assert market.read_events(spark, [f"{tmp_path}/t"], "mbp-10")[1].first().code == "missing_required_column"
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not a table PAR1")
    raw.drop("price").write.parquet(f"{tmp_path}/lacks")
    events, notes = market.read_events(spark, [f"{tmp_path}/t", f"{tmp_path}/bad.parquet", f"{tmp_path}/none", f"{tmp_path}/lacks"], "trades")
    assert [(r.kind, r.price_ticks) for r in events.collect()] == [("trade", 68000)]
    found = sorted((r.code, r.severity) for r in notes.collect())
    assert found.count(("invalid_record", "error")) == 2 and ("missing_required_column", "error") in found and found.count(("invalid_price", "warning")) == 3
    assert all(str(tmp_path) not in f"{r.source} {r.message}" for r in notes.collect())
    top = spark.createDataFrame([(at(14), 100.0, 100.5, 3), (at(14), 100.1, 100.5, 3)], "ts_event timestamp_ntz, bid double, other double, bid_sz int")
    top.write.parquet(f"{tmp_path}/top")
    assert market.read_events(spark, [f"{tmp_path}/top"], "bbo")[1].first().message == "missing ask_price"
    quotes, notes = market.normalize_quotes(top.withColumnRenamed("other", "ask"))
    assert [(r.bid_ticks, r.ask_ticks, r.bid_size, r.ask_size) for r in quotes.collect()] == [(400, 402, 3, 0)] and notes.first().code == "invalid_price"
    messages = [("trades", '{"ts_event": "2025-06-02T14:00:00Z", "price": 170000, "size": 1}'), ("MBP-1", '{"ts": 1748872800000000000, "bid_px": 1.0, "ask_price_ticks": 5}'), ("trades", "no json"), ("mbp-10", "{}"), (None, "{}"), ("bbo", '{"ts": "2025-06-02T14:00:00", "bid": 1, "ask": 2}')]
    good, notes = market.provider_events(spark.createDataFrame(messages, "schema string, message string"))
    assert {(r.kind, r.price_ticks, r.bid_ticks, r.ask_ticks, r.bid_size) for r in good.collect()} == {("trade", 680000, None, None, None), ("quote", None, 4, 5, 0)} and notes.count() == 4
    ranked = market.latest_quotes(spark.createDataFrame([("a", at(1), 1, 5), ("a", at(1), 2, 6), ("b", at(0), 9, 7)], "s string, ts_event timestamp_ntz, sequence int, bid_ticks int"), ("s",))
    assert {(r.s, r.bid_ticks) for r in ranked.collect()} == {("a", 6), ("b", 7)}
    ns = spark.createDataFrame([(-1,), (1_700_000_000_123_456_789,)], "n long").select(ticks.from_nanos(F.col("n")).alias("t")).collect()
    assert [r.t for r in ns] == [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2023, 11, 14, 22, 13, 20, 123456)]
    book = spark.createDataFrame([(1, 10, "ZZM5"), (9, 500, "ZZM5-ZZU5"), (2, 1, "ZZU5")], "instrument_id long, size long, symbol string")
    assert market.front_month_by_volume(book).first().instrument_id == 1
    assert spark.range(1).select(ticks.redact(F.lit("open /a/b/c.txt, api_key: 12 token"))).first()[0] == "open <path>, <redacted> <redacted>"


@pytest.fixture
def valid():
    return {
        "contract_version": "v1", "engine_version": "e3", "strategy_id": "s", "training_mode": "t", "supported_by_runtime": True, "instrument": "ZZ", "tick_size": 0.25, "point_value": 20.0,
        "model": {"type": "x", "loss_function": "y", "file": "z"}, "feature_set": {"names": ["a", "b"], "order_is_contractual": True, "interaction_features": ["a"], "approach_features": ["b"], "nan_policy": "n"},
        "class_map": {"0": "p", "1": "q"}, "session_scheme": {"timezone": "America/New_York", "trading_day_boundary": "18:00", "sessions": {"ny": {"start": "09:00", "end": "17:00"}}},
        "level_scheme": {"pdh_pdl_source": "d", "session_levels": [], "available_from_guard": True}, "touch_rule": {"type": "t", "bar_type": "147t", "zone_proximity_pts": 3.0, "zone_representative_price": "mean", "scope": "day", "direction_from_side": {}},
        "feature_windows": {"interaction_window_minutes": 5, "approach_window_minutes": 90, "within_band_pts": 2.0, "level_proximity_pts": 0.5, "large_trade_threshold": 10, "mid_price_source": "trade_price"},
        "label_policy": {"resolution": "m", "entry_reference": "r", "decision_offset_minutes": 5, "tp_points": 15.0, "sl_points": 30.0, "trap_mfe_min": 5.0, "forward_bar_type": "147t", "forward_cutoff": "c", "no_resolution_dropped": True},
        "inference": {"eligible_class": "p", "eligible_session": "ny", "confidence_gate": 0.7}, "data_requirements": {"min_book_level": "L1", "live_schemas": [], "replay_schemas": [], "depth_usage": "top"}, "provenance": {"dataset_config_hash": "h", "catboost": {}},
    }


def test_contract(valid, tmp_path):
    c = contract.parse(valid, "e3", "v1")
    assert c.classes == ("p", "q") and c.feature_count == 2 and c.engine().label.tp == 15.0 and c.engine().scheme.sessions[0].end == time(17)
    (tmp_path / "x.json").write_text("{")
    for path in ("missing.json", "x.json"):
        with pytest.raises(contract.ContractError):
            contract.load(str(tmp_path / path))


@pytest.mark.parametrize("change", [
    lambda r: r.update(extra=1), lambda r: r.pop("model"), lambda r: r.update(engine_version="e2"), lambda r: r.update(contract_version="v9"), lambda r: r["class_map"].update({"3": "z"}), lambda r: r["class_map"].update({"1": "p"}),
    lambda r: r["feature_set"].update(names=["a"]), lambda r: r["inference"].update(confidence_gate=1.5), lambda r: r["label_policy"].update(tp_points=0), lambda r: r["feature_windows"].update(approach_window_minutes=1441), lambda r: r.update(tick_size=True), lambda r: r["model"].update(more="k"),
])
def test_contract_refuses(valid, change):
    raw = copy.deepcopy(valid)
    change(raw)
    with pytest.raises(contract.ContractError):
        contract.parse(raw, "e3", "v1")


#: Sessions and days of an older scheme, and days that begin at 23:00 in Chicago.
OLDER = Scheme("America/New_York", time(18), (Session("asia", time(18), time(1)), Session("london", time(1), time(8)), Session("ny", time(9, 30), time(16, 15))))
LATE = Scheme("America/Chicago", time(23), EASTERN.sessions)


def test_other_schemes(spark):
    want = [(at(22), 3, "asia"), (at(4, 59), 2, "asia"), (at(5), 2, "london"), (at(11, 59), 2, "london"), (at(12), 2, "none"), (at(13, 29), 2, "none"), (at(13, 30), 2, "ny"), (at(20, 14), 2, "ny"), (at(20, 15), 2, "none"), (at(21, 59), 2, "none")]
    df = spark.createDataFrame([(t,) for t, *_ in want], "ts_event timestamp_ntz")
    got = {r.ts_event: (r.trading_day.day, r.session) for r in with_session(df, OLDER).collect()}
    assert got == {t: (d, s) for t, d, s in want}
    late = {r.ts_event: r.trading_day.day for r in with_session(spark.createDataFrame([(at(3, 59),), (at(4),)], "ts_event timestamp_ntz"), LATE).collect()}
    assert late == {at(3, 59): 1, at(4): 2}
    bounds = spark.createDataFrame([(DAY,)], "d date").select(*day_bounds(F.col("d"), LATE)).first()
    assert tuple(bounds) == (at(4), datetime(2025, 6, 3, 4)) and tuple(spark.createDataFrame([(DAY,)], "d date").select(*day_bounds(F.col("d"), EASTERN)).first()) == (datetime(2025, 6, 1, 22), at(22))
