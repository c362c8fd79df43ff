"""Comparison of two results by key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LABELS, UNRESOLVED
from ..sinks import scratch
from .ordering import rank_in_order


def diff_by_key(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys on one side only, and keys whose fields differ, with the fields' names. Null equals null, NaN equals NaN."""
    a = left.select(*keys, F.struct(*fields).alias("_a"))
    b = right.select(*keys, F.struct(*fields).alias("_b"))
    both = a.join(b, keys, "full_outer")
    differ = F.filter(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when(F.size(differ) > 0, "differs").otherwise("same")
    return both.select(*keys, status.alias("status"), F.when(status == "differs", F.array_join(differ, ",")).alias("fields"))


def equal_within(a: Column, b: Column, eps: float | None = None) -> Column:
    """Whether two values are the same: null equals null, NaN equals NaN, and with eps numbers may be so far apart."""
    if eps is None:
        return a.eqNullSafe(b)
    x, y = a.cast("double"), b.cast("double")
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y)).otherwise(F.abs(x - y) <= eps)


def paired(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, float | None]) -> DataFrame:
    """(keys, left, right, differ): both sides of each key as structs, null where a side lacks it, and the names of the fields that differ, of which each has its own tolerance or none."""
    both = left.select(*keys, F.struct(*fields).alias("left")).join(right.select(*keys, F.struct(*fields).alias("right")), keys, "full_outer")
    names = [F.when(~equal_within(F.col(f"left.{f}"), F.col(f"right.{f}"), eps), F.lit(f)) for f, eps in fields.items()]
    differ = F.filter(F.array(*names), lambda x: x.isNotNull())
    return both.withColumn("differ", F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), differ))


def first_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: dict[str, float | None]) -> DataFrame:
    """(field, n, keys, left, right): of each field that differs how often it does, and the least key at which, with both values as text. One pass over the pairs."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"left.{f}").cast("string").alias("left"), F.col(f"right.{f}").cast("string").alias("right")) for f in fields]))
    pairs = paired(left, right, keys, fields).where("size(differ) > 0").select(*keys, "differ", each.alias("x")).where(F.array_contains("differ", F.col("x.field")))
    least = F.min(F.struct(*keys, F.col("x.left").alias("left"), F.col("x.right").alias("right")))
    return pairs.groupBy(F.col("x.field").alias("field")).agg(F.count("*").alias("n"), least.alias("m")).select("field", "n", "m.*")


@dataclass(frozen=True)
class Stage:
    """What is compared of two runs at one stage. Of a stage that is expected to differ only the numbers are told."""

    name: str
    left: DataFrame
    right: DataFrame
    keys: tuple[str, ...]
    fields: dict[str, float | None]
    must_match: bool = True


def tally(stages: list[Stage]) -> DataFrame:
    """(stage, scope, total, matched, mismatched, one_sided, first_key, passed), a row for each stage; first_key is the least key that does not match."""

    def row(s: Stage) -> DataFrame:
        pairs = paired(s.left, s.right, list(s.keys), s.fields)
        same, alone = F.coalesce(F.size("differ") == 0, F.lit(False)) & F.col("differ").isNotNull(), F.col("differ").isNull()
        count = lambda on: F.count(F.when(on, 1))
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in s.keys])
        least = F.min(F.when(~same, F.struct(*s.keys, key.alias("_text"))))["_text"]
        done = pairs.agg(F.count("*").alias("total"), count(same).alias("matched"), count(~same).alias("mismatched"), count(alone).alias("one_sided"), least.alias("first_key"))
        scope = "must_match" if s.must_match else "expected_differ"
        return done.select(F.lit(s.name).alias("stage"), F.lit(scope).alias("scope"), "total", "matched", "mismatched", "one_sided", "first_key", ((F.col("mismatched") == 0) | F.lit(not s.must_match)).alias("passed"))

    return reduce(DataFrame.unionByName, [row(s) for s in stages])


#: Touches of two runs are the same touch by these, the price rounded.
IDENTITY = ("level_type", "direction", "bar_ts", "price")


def _identified(run: DataFrame) -> DataFrame:
    return run.withColumn("price", F.round("representative_price", 6))


def _sets(left: DataFrame, right: DataFrame, day: list[str], item: Column, name: str) -> DataFrame:
    """(day, n_left, n_right, n_matched, left_only, right_only) of what each side holds of a day, as sorted arrays of texts."""
    side = lambda df, a, b: df.select(*day, item.alias("item"), F.lit(a).alias("_l"), F.lit(b).alias("_r"))
    each = side(left, 1, 0).union(side(right, 0, 1)).groupBy(*day, "item").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    only = lambda on: F.array_join(F.array_sort(F.collect_list(F.when(on, F.col("item")))), "; ")
    return each.groupBy(*day).agg(
        F.sum("_l").alias(f"{name}_left"), F.sum("_r").alias(f"{name}_right"), F.sum(F.col("_l") * F.col("_r")).alias(f"{name}_matched"),
        only((F.col("_l") == 1) & (F.col("_r") == 0)).alias(f"{name}_left_only"), only((F.col("_l") == 0) & (F.col("_r") == 1)).alias(f"{name}_right_only"),
    )


@dataclass(frozen=True)
class Run:
    """One run's results: bars, levels, zones; and its touches with features, outcome (label, drop_reason) and session."""

    bars: DataFrame
    levels: DataFrame
    zones: DataFrame
    touches: DataFrame


def _text(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


def _points(price: str) -> Column:
    """A price as text with six decimals, whatever its type prints as."""
    return F.format_string("%.6f", F.col(price))


def day_differences(a: Run, b: Run, features: tuple[str, ...], eps: float = 1e-6, eligible: str = "ny", by: tuple[str, ...] = ()) -> DataFrame:
    """One row a day that compares two runs.

    Levels by name, price and side; zones by price, side and names; touches by their identity (level type, direction, close
    of the bar, price to six decimals), each with its counts and what only one side has. Over touches with an outcome
    on both sides: label flips, and by feature how many differ by more than eps and the largest difference (null and
    NaN count as 0 there, and are equal to themselves). Then the touches in the eligible session of either side, those
    labelled and dropped on each, and how often each label occurs on the left. A day that one side lacks is skipped.
    """
    day = [*by, "trading_day"]
    counted = lambda run, name: run.bars.groupBy(*day).agg(F.count("*").alias(name))
    days = counted(a, "bars_left").join(counted(b, "bars_right"), day, "full_outer")
    levels = _sets(a.levels, b.levels, day, _text("name", _points("price"), "side"), "levels")
    zones = _sets(a.zones, b.zones, day, _text(_points("representative_price"), "side", F.array_join("names", ",")), "zones")
    left, right = _identified(a.touches), _identified(b.touches)
    item = _text("level_type", "direction", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), _points("price"))
    touches = _sets(left, right, day, item, "touches")
    has = lambda side, c: F.col(f"{side}.{c}").isNotNull()
    what = F.struct("label", "drop_reason", "session", *features)
    key = [*day, *IDENTITY]
    both = left.select(*key, what.alias("l")).join(right.select(*key, what.alias("r")), key, "full_outer")
    labelled = has("l", "label") & has("r", "label")
    n = lambda on: F.count(F.when(on, 1))
    number = lambda side, f: F.coalesce(F.nanvl(F.col(f"{side}.{f}").cast("double"), F.lit(0.0)), F.lit(0.0))
    apart = {f: labelled & ~equal_within(F.col(f"l.{f}"), F.col(f"r.{f}"), eps) for f in features}
    outcome = both.groupBy(*day).agg(
        n((F.col("l.session") == eligible) | (F.col("r.session") == eligible)).alias("eligible_touches"),
        n(has("l", "label")).alias("labelled_left"), n(has("r", "label")).alias("labelled_right"), n(has("l", "drop_reason")).alias("dropped_left"), n(has("r", "drop_reason")).alias("dropped_right"),
        n(has("l", "label") != has("r", "label")).alias("survivors_differ"), n(labelled & (F.col("l.label") != F.col("r.label"))).alias("label_flips"),
        *[n(on).alias(f"{f}_differ") for f, on in apart.items()], *[F.coalesce(F.max(F.when(on, F.abs(number("l", f) - number("r", f)))), F.lit(0.0)).alias(f"{f}_worst") for f, on in apart.items()],
        *[n(F.col("l.label") == label).alias(f"n_{label}") for label in (*LABELS, UNRESOLVED)],
    )
    out = days
    for part in (levels, zones, touches, outcome):
        out = out.join(part, day, "left")
    gone = F.when(F.col("bars_left").isNull() | F.col("bars_right").isNull(), "empty bar set")
    same = lambda name: (F.col(f"{name}_left") == F.col(f"{name}_matched")) & (F.col(f"{name}_right") == F.col(f"{name}_matched"))
    facts = {c: F.coalesce(F.col(c), F.lit("")) if c.endswith("_only") else F.coalesce(F.col(c), F.lit(0)) for c in out.columns if c not in day}
    told = out.withColumns(facts | {"reason": gone}).withColumns({f"{x}_identical": same(x) for x in ("levels", "zones", "touches")})
    worst = reduce(lambda x, y: x + y, [F.col(f"{f}_differ") for f in features])
    return told.withColumns({"survivors_identical": F.col("survivors_differ") == 0, "labels_identical": F.col("label_flips") == 0, "features_identical": worst == 0})


def value_counts(df: DataFrame, value: str, blocks: int = 256) -> DataFrame:
    """(v, n, start, total): each different value with its count, how many rows are below it, and all rows. Nulls and NaN are left out.

    The counts of different values are written once. They are dealt into blocks by approximate quantiles, a bounded list;
    within a block counts add up in a window, and the blocks' counts give each its offset. No task has more than a
    block's different values, however often one occurs.
    """
    counted = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count("*").alias("n"))
    place = scratch(df.sparkSession, "counts")
    counted.write.parquet(place)
    rows = df.sparkSession.read.schema(counted.schema).parquet(place)
    edges = sorted(set(rows.approxQuantile("v", [k / blocks for k in range(1, blocks)], 1 / (4 * blocks))))
    block = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    counts = rows.withColumn("block", block)
    every = Window.orderBy("block")
    of_block = counts.groupBy("block").agg(F.sum("n").alias("_n"))
    offsets = of_block.select("block", (F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_offset"), F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    below = F.sum("n").over(Window.partitionBy("block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("_below", below).join(offsets, "block").select("v", "n", (F.col("_below") + F.col("_offset")).alias("start"), "total")


def percentile_of(p: float) -> Column:
    """For an aggregate over value_counts: the percentile, between its two neighbours in proportion."""
    at = F.lit(float(p)) * (F.col("total") - 1)
    value = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("start") + F.col("n")), F.col("v")))
    low, high = value(F.floor(at)), value(F.ceil(at))
    return low + (high - low) * F.max(at - F.floor(at))


def divergence(pairs: DataFrame, value: str) -> DataFrame:
    """Mean, median, 95th percentile and maximum of a column, exact, from the counts of its values."""
    kind = pairs.schema[value].dataType
    return value_counts(pairs, value).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean"), percentile_of(0.5).alias("median"), percentile_of(0.95).alias("p95"), F.max("v").cast(kind).alias("max"))


def even_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """At most k rows at even distances in order; the first of order, a date or another key that rises, is the block by which rows are numbered."""
    ranked = rank_in_order(df, [F.col(c) for c in order], F.col(order[0]), "_r").withColumn("_r", F.col("_r") - 1)
    counted = ranked.join(df.agg(F.count("*").alias("_n")), F.lit(True))
    return counted.where((F.col("_n") <= k) | (F.expr(f"(_r * {k}) div _n") != F.expr(f"((_r - 1) * {k}) div _n")) | (F.col("_r") == 0)).drop("_r", "_n")


def missing_days(have: DataFrame, first: str, last: str) -> DataFrame:
    """Calendar dates from first to last without a row in have (trading_day)."""
    days = have.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS trading_day")
    return days.join(have.select("trading_day").distinct(), "trading_day", "left_anti")
