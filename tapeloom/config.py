"""Parameters of every operator, as frozen values kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import time

TICK_SIZE = 0.25

# Names and encodings of results.
LABELS = {"tradeable_reversal": 0, "trap_reversal": 1, "aggressive_blowthrough": 2}
UNRESOLVED = "no_resolution"
DIRECTION = {"LOW": "LONG", "HIGH": "SHORT"}
LEVEL_ORDER = ("pdh", "pdl", "asia_high", "asia_low", "london_high", "london_low")
LEVEL_SIDE = {"pdh": "HIGH", "pdl": "LOW", "asia_high": "HIGH", "asia_low": "LOW", "london_high": "HIGH", "london_low": "LOW"}
#: Names that a menu offers without a formula; asking for one is an error.
FEATURES_WITHOUT_FORMULA = ("app_trade_count", "app_volume_acceleration", "app_avg_tob_imbalance", "app_volatility_recent", "app_volatility_ratio")
FEATURES = ("int_time_beyond_level", "int_time_within_2pts", "int_absorption_ratio", "app_large_trade_vol_pct", "app_avg_trade_size", "app_max_spread")


@dataclass(frozen=True)
class Session:
    name: str
    start: time
    end: time

    @property
    def crosses_midnight(self) -> bool:
        return self.end <= self.start


@dataclass(frozen=True)
class Scheme:
    timezone: str
    boundary: time  # local time at which the next trading day begins
    sessions: tuple[Session, ...]
    closed: Session | None = None


EASTERN = Scheme("America/New_York", time(18), (Session("asia", time(19), time(2, 45)), Session("london", time(3), time(8)), Session("ny", time(9), time(17))))
CENTRAL = Scheme("America/Chicago", time(18), (Session("asia", time(18), time(2)), Session("london", time(2), time(8)), Session("ny", time(8), time(16))), Session("closed", time(16), time(18)))


@dataclass(frozen=True)
class FeatureWindows:
    interaction_min: int = 5
    approach_min: int = 90
    within_pts: float = 2.0
    proximity_pts: float = 0.5
    large_size: int = 10
    max_gap_s: int = 600


@dataclass(frozen=True)
class LabelPolicy:
    tp: float = 15.0
    sl: float = 30.0
    trap_min: float = 5.0
    decision_min: int = 5
    flatten: time = time(16, 40)
    cutoff: time = time(17)
    fill_tolerance_min: int = 30
    forced: bool = False


@dataclass(frozen=True)
class EngineConfig:
    tick_size: float = TICK_SIZE
    scheme: Scheme = EASTERN
    proximity_pts: float = 3.0
    bar_trades: tuple[int, ...] = (147, 987, 2000)
    windows: FeatureWindows = field(default_factory=FeatureWindows)
    label: LabelPolicy = field(default_factory=LabelPolicy)
    eligible_class: str = "tradeable_reversal"
    eligible_session: str = "ny"
    confidence: float = 0.70
