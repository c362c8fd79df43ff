"""The whole chain from a tape to labelled rows, and small reports over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.calendar import session_of, to_local
from . import bars as b
from . import features, levels, outcomes, touches, zones


@dataclass(frozen=True)
class Chain:
    bars: DataFrame
    levels: DataFrame
    zones: DataFrame
    touches: DataFrame


def chain(trades: DataFrame, bar_trades: int, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> Chain:
    """by: columns of the trades, such as a symbol, of which each has bars, levels, zones and touches of its own."""
    return chain_of_bars(b.tick_bars(trades, bar_trades, cfg.scheme, by=by), cfg, by)


def chain_of_bars(bars: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> Chain:
    """The same from bars, such as a table of them that was written once."""
    lv = levels.level_set(bars, cfg.scheme, cfg.tick_size, by=by)
    zn = zones.merge_levels(lv, cfg.proximity_pts, by)
    return Chain(bars, lv, zn, touches.first_touches(bars, zn, cfg.tick_size, by=by))


def training_rows(trades: DataFrame, quotes: DataFrame, bar_trades: int, cfg: EngineConfig = EngineConfig(), drop_unresolved: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Touches with features and outcomes; dropped touches are left out, and unresolved ones if asked.

    One chain of joins: touches meet the trades, the quotes and the bars once each, and nothing is computed twice.
    """
    c = chain(trades, bar_trades, cfg, by)
    about = ("bar_ts", "representative_price", "direction", "level_type")
    feats = features.touch_features(c.touches, trades, quotes, cfg.windows, cfg.tick_size, decision_min=cfg.label.decision_min, tolerance_min=cfg.label.fill_tolerance_min, keep=about, by=by)
    keep = (*about, *features.ZERO, *features.NULL)
    out = outcomes.decided(feats, c.bars, cfg.label, cfg.scheme, cfg.tick_size, keep, by).where("drop_reason is null").drop("drop_reason", "decision_ts")
    if drop_unresolved:
        out = out.where("label_encoded is not null")
    return out.select(*by, "trading_day", "zone_id", *about, "entry_price", "label", "label_encoded", "max_mfe", "max_mae", "bars_to_resolution", *features.ZERO, *features.NULL)


def judged_touches(c: Chain, trades: DataFrame, quotes: DataFrame, cfg: EngineConfig = EngineConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Every touch with its session, features, and outcome or reason of a drop."""
    key = [*by, "trading_day", "zone_id"]
    feats = features.touch_features(c.touches, trades, quotes, cfg.windows, cfg.tick_size, by=by)
    out = outcomes.decision_outcomes(c.touches, c.bars, trades, cfg.label, cfg.scheme, cfg.tick_size, by)
    session = session_of(to_local(F.col("bar_ts"), cfg.scheme), cfg.scheme)
    return c.touches.withColumn("session", session).join(feats, key).join(out, key)


def class_balance(rows: DataFrame) -> DataFrame:
    g = rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def gate(predictions: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Predictions (class, session, confidence) that may be acted on."""
    return predictions.where((F.col("label") == cfg.eligible_class) & (F.col("session") == cfg.eligible_session) & (F.col("confidence") >= cfg.confidence))
