"""Comparators with tolerance, exact percentiles from counts, ordered files and bounded queues, on hand-made rows."""

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom import sinks
from tapeloom.operators import diff
from tapeloom.sources import market

NAN = float("nan")


def test_equal_within(spark):
    cases = [(None, None, True), (None, 1.0, False), (NAN, NAN, True), (NAN, 1.0, False), (NAN, None, False), (1.0, 1.0 + 5e-7, True), (1.0, 1.00001, False)]
    df = spark.createDataFrame(cases, "a double, b double, want boolean")
    assert all(r.got == r.want for r in df.select("*", diff.equal_within(F.col("a"), F.col("b"), 1e-6).alias("got")).collect())
    exact = spark.createDataFrame([("x", "x", True), (None, "x", False), (None, None, True)], "a string, b string, want boolean")
    assert all(r.got == r.want for r in exact.select("*", diff.equal_within(F.col("a"), F.col("b")).alias("got")).collect())


def sides(spark):
    kind = "k int, v double, w string"
    return spark.createDataFrame([(1, 1.0, "a"), (2, NAN, "b"), (3, None, "c"), (4, 2.0, "d"), (7, 1.0, "z")], kind), spark.createDataFrame([(1, 1.0 + 1e-9, "a"), (2, NAN, "x"), (3, 0.5, "c"), (5, 2.0, "d"), (7, 3.0, "y")], kind)


def test_tally_and_first_differences(spark):
    a, b = sides(spark)
    stages = [diff.Stage("all", a, b, ("k",), {"v": 1e-6, "w": None}), diff.Stage("text", a, b, ("k",), {"w": None}, must_match=False), diff.Stage("same", a, a, ("k",), {"v": 1e-6, "w": None}), diff.Stage("none", a.limit(0), b.limit(0), ("k",), {"v": None})]
    got = {r.stage: tuple(r)[1:] for r in diff.tally(stages).collect()}
    assert got == {"all": ("must_match", 6, 1, 5, 2, "2", False), "text": ("expected_differ", 6, 2, 4, 2, "2", True), "same": ("must_match", 5, 5, 0, 0, None, True), "none": ("must_match", 0, 0, 0, 0, None, True)}
    first = {r.field: (r.n, r.k, r.left, r.right) for r in diff.first_differences(a, b, ["k"], {"v": 1e-6, "w": None}).collect()}
    assert first == {"v": (2, 3, None, "0.5"), "w": (2, 2, "b", "x")}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 900 + [1.0, 9.0], list(np.random.default_rng(1).lognormal(0, 3, 5000)), [0.0] * 4000 + list(range(1000))])
def test_percentiles_from_counts(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (NAN,)], "x double").repartition(7)
    r = diff.divergence(df, "x").first()
    assert (r.n, r["max"]) == (len(values), max(values))
    assert [r["mean"], r["median"], r.p95] == pytest.approx([np.mean(values), np.median(values), np.percentile(values, 95)], rel=1e-9, abs=1e-6)
    counts = diff.value_counts(df, "x", blocks=16)
    assert counts.agg(F.sum("n")).first()[0] == len(values) and counts.count() == len(set(values))


def test_percentiles_of_nothing(spark):
    r = diff.divergence(spark.createDataFrame([(None,)], "x double"), "x").first()
    assert (r.n, r["mean"], r["median"], r.p95, r["max"]) == (0, None, None, None, None)


def test_ordered_files(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), F.col("id").alias("b"))
    got = sinks.read_ordered(spark, sinks.write_ordered(df, f"{tmp_path}/t", [F.col("a") % 50, -F.col("a")], 6))
    assert "Sort" not in got._jdf.queryExecution().sparkPlan().toString()
    want = sorted((r.a for r in df.collect()), key=lambda a: (a % 50, -a))
    assert [r.a for r in got.orderBy("rank").collect()] == want and [r["rank"] for r in got.orderBy("rank").collect()] == list(range(1, 5001))
    assert spark.read.parquet(f"{tmp_path}/t/manifest").agg(F.sum("n")).first()[0] == 5000


def test_bounded_queue(spark):
    df = spark.createDataFrame([(d, i, f"m{i}") for d, n in ((1, 3), (2, 7), (None, 6)) for i in range(n)], "drain int, at int, message string")
    kept, notes = market.bounded(df.where("drain is not null"), "drain", "at", 4)
    assert sorted((r.drain, r["at"]) for r in kept.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert [(r.code, r.message, r["drain"], r["count"]) for r in notes.collect()] == [("backpressure_drop", "3 messages dropped", 2, 3)]


def test_day_differences(spark):
    """Two days of which one is on one side only; a moved level, a flipped label, a feature that differs, and a touch without a partner."""
    days = (date(2025, 6, 2), date(2025, 6, 3))
    bars = lambda *n: spark.createDataFrame([(d, i) for d, k in zip(days, n, strict=True) for i in range(k)], "trading_day date, bar_index int")
    levels = lambda price: spark.createDataFrame([(days[0], "pdh", price, "HIGH")], "trading_day date, name string, price double, side string")
    zones = spark.createDataFrame([(days[0], 100.0, "HIGH", ["pdh"])], "trading_day date, representative_price double, side string, names array<string>")
    kind = "trading_day date, level_type string, direction string, bar_ts timestamp_ntz, representative_price double, label string, drop_reason string, session string, f double, g double"
    at = lambda h: datetime(2025, 6, 2, h)
    row = lambda h, label, reason, f, g: (days[0], "pdh", "SHORT", at(h), 100.0, label, reason, "ny", f, g)
    a = diff.Run(bars(3, 1), levels(100.0), zones, spark.createDataFrame([row(14, "trap_reversal", None, 1.0, NAN), row(15, None, "no_fill", 1.0, 1.0), row(16, "trap_reversal", None, 1.0, None)], kind))
    b = diff.Run(bars(4, 0), levels(101.0), zones, spark.createDataFrame([row(14, "tradeable_reversal", None, 3.0, NAN), row(15, None, "no_fill", 9.0, 1.0)], kind))
    got = {r.trading_day: r for r in diff.day_differences(a, b, ("f", "g")).collect()}
    one, two = got[days[0]], got[days[1]]
    assert (one.bars_left, one.bars_right, one.levels_matched, one.levels_left_only, one.levels_right_only) == (3, 4, 0, "pdh|100.000000|HIGH", "pdh|101.000000|HIGH")
    assert (one.zones_identical, one.levels_identical, one.touches_identical, one.touches_matched, one.touches_left) == (True, False, False, 2, 3)
    assert one.touches_left_only == "pdh|SHORT|2025-06-02 16:00:00.000000|100.000000"
    assert (one.label_flips, one.labels_identical, one.survivors_differ, one.f_differ, one.f_worst, one.g_differ, one.features_identical) == (1, False, 1, 1, 2.0, 0, False)
    assert (one.labelled_left, one.labelled_right, one.dropped_left, one.dropped_right, one.eligible_touches, one.n_trap_reversal) == (2, 1, 1, 1, 3, 2)
    assert (one.reason, two.reason, two.bars_left, two.bars_right, two.touches_left) == (None, "empty bar set", 1, 0, 0)
