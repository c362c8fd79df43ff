"""Strict reading of a strategy contract, and the engine settings that follow from it.

Each section is a table of fields with a type and bounds; unknown and missing keys are errors.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import time
from pathlib import Path
from typing import Any

from .config import EngineConfig, FeatureWindows, LabelPolicy, Scheme, Session

VERSION = "v1"


class ContractError(ValueError):
    """Anything wrong with a contract."""


def _text(most: int):
    return ("text", 1, most)


_NUM, _INT, _BOOL, _NAMES, _DICT = "number", "int", "bool", "names", "dict"
_POSITIVE, _NOT_NEGATIVE = (_NUM, 0, None, "open"), (_NUM, 0, None, "closed")
_MINUTES = (_INT, 1, 1440)

# Sections, fields, kinds and bounds of the format.
SECTIONS: dict[str, dict[str, tuple]] = {
    "model": {"type": _text(32), "loss_function": _text(32), "file": _text(128)},
    "feature_set": {"names": (_NAMES, 1, 256), "order_is_contractual": (_BOOL,), "interaction_features": (_NAMES, 0, 256), "approach_features": (_NAMES, 0, 256), "nan_policy": _text(32)},
    "session_scheme": {"timezone": _text(64), "trading_day_boundary": _text(8), "sessions": (_DICT,)},
    "level_scheme": {"pdh_pdl_source": _text(64), "session_levels": (_NAMES, 0, 64), "available_from_guard": (_BOOL,)},
    "touch_rule": {"type": _text(32), "bar_type": _text(16), "zone_proximity_pts": _NOT_NEGATIVE, "zone_representative_price": _text(64), "scope": _text(64), "direction_from_side": (_DICT,)},
    "feature_windows": {"interaction_window_minutes": _MINUTES, "approach_window_minutes": _MINUTES, "within_band_pts": _NOT_NEGATIVE, "level_proximity_pts": _NOT_NEGATIVE, "large_trade_threshold": (_INT, 1, None), "mid_price_source": _text(32)},
    "label_policy": {"resolution": _text(32), "entry_reference": _text(64), "decision_offset_minutes": _MINUTES, "tp_points": _POSITIVE, "sl_points": _POSITIVE, "trap_mfe_min": _NOT_NEGATIVE, "forward_bar_type": _text(16), "forward_cutoff": _text(64), "no_resolution_dropped": (_BOOL,)},
    "inference": {"eligible_class": _text(64), "eligible_session": _text(32), "confidence_gate": (_NUM, 0, 1, "closed")},
    "data_requirements": {"min_book_level": _text(8), "live_schemas": (_NAMES, 0, 16), "replay_schemas": (_NAMES, 0, 16), "depth_usage": _text(32)},
    "provenance": {"dataset_config_hash": _text(64), "catboost": (_DICT,)},
    "research_session_experiment": {"training_sessions": (_NAMES, 1, 3), "evaluation_sessions": (_NAMES, 1, 3), "production_gate_sessions": (_NAMES, 1, 3), "report_session_breakdowns": (_BOOL,)},
}
TOP = {"contract_version": _text(64), "engine_version": _text(64), "strategy_id": _text(256), "training_mode": _text(64), "supported_by_runtime": (_BOOL,), "instrument": _text(32), "tick_size": _POSITIVE, "point_value": _POSITIVE}
OPTIONAL = {"research_session_experiment", "report_session_breakdowns", "crosses_midnight"}
_WINDOW = {"start": _text(8), "end": _text(8), "crosses_midnight": (_BOOL,)}


def _check(value: Any, rule: tuple, where: str) -> None:
    kind, *bounds = rule
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    good = {
        "text": lambda: isinstance(value, str) and bounds[0] <= len(value) <= bounds[1],
        _BOOL: lambda: isinstance(value, bool),
        _INT: lambda: number and float(value).is_integer() and value >= bounds[0] and (bounds[1] is None or value <= bounds[1]),
        _NUM: lambda: number and value == value and (value > bounds[0] if bounds[2] == "open" else value >= bounds[0]) and (bounds[1] is None or value <= bounds[1]),
        _NAMES: lambda: isinstance(value, list) and all(isinstance(x, str) for x in value) and bounds[0] <= len(value) <= bounds[1],
        _DICT: lambda: isinstance(value, dict),
    }[kind]()
    if not good:
        raise ContractError(f"{where} is not valid")


def _fields(value: Any, rules: dict[str, tuple], where: str) -> None:
    if not isinstance(value, dict):
        raise ContractError(f"{where} is not an object")
    if unknown := set(value) - set(rules):
        raise ContractError(f"{where} has unknown keys: {', '.join(sorted(unknown))}")
    if missing := set(rules) - set(value) - OPTIONAL:
        raise ContractError(f"{where} lacks {', '.join(sorted(missing))}")
    for key, rule in rules.items():
        if key in value:
            _check(value[key], rule, f"{where}.{key}")


@dataclass(frozen=True)
class Contract:
    raw: dict[str, Any]

    @property
    def classes(self) -> tuple[str, ...]:
        c = {int(k): v for k, v in self.raw["class_map"].items()}
        return tuple(c[i] for i in range(len(c)))

    @property
    def feature_count(self) -> int:
        return len(self.raw["feature_set"]["names"])

    def engine(self) -> EngineConfig:
        """The settings of every operator."""
        r = self.raw
        at = time.fromisoformat
        s, w, p, i = r["session_scheme"], r["feature_windows"], r["label_policy"], r["inference"]
        return EngineConfig(
            tick_size=r["tick_size"], proximity_pts=r["touch_rule"]["zone_proximity_pts"],
            scheme=Scheme(s["timezone"], at(s["trading_day_boundary"]), tuple(Session(n, at(x["start"]), at(x["end"])) for n, x in s["sessions"].items())),
            windows=FeatureWindows(w["interaction_window_minutes"], w["approach_window_minutes"], w["within_band_pts"], w["level_proximity_pts"], w["large_trade_threshold"]),
            label=LabelPolicy(p["tp_points"], p["sl_points"], p["trap_mfe_min"], p["decision_offset_minutes"]),
            eligible_class=i["eligible_class"], eligible_session=i["eligible_session"], confidence=i["confidence_gate"],
        )


def parse(raw: Any, expected_engine: str | None = None, version: str | None = None) -> Contract:
    """Object, contract version, engine version, then every section, in this order."""
    if not isinstance(raw, dict):
        raise ContractError("a contract must be an object")
    if not isinstance(raw.get("contract_version"), str) or version is not None and raw["contract_version"] != version:
        raise ContractError("the contract version is missing or not supported")
    if expected_engine is not None and raw.get("engine_version") != expected_engine:
        raise ContractError("the contract was made for another engine version")
    names = set(TOP) | set(SECTIONS) | {"class_map"}
    if unknown := set(raw) - names:
        raise ContractError(f"unknown keys: {', '.join(sorted(unknown))}")
    if missing := names - set(raw) - OPTIONAL:
        raise ContractError(f"missing keys: {', '.join(sorted(missing))}")
    for key, rule in TOP.items():
        _check(raw[key], rule, key)
    for key, rules in SECTIONS.items():
        if raw.get(key) is not None or key not in OPTIONAL:
            _fields(raw[key], rules, key)
    for name, window in raw["session_scheme"]["sessions"].items():
        _fields(window, _WINDOW, f"session {name}")
    f = raw["feature_set"]
    if sorted(f["interaction_features"] + f["approach_features"]) != sorted(f["names"]) or len(set(f["names"])) != len(f["names"]):
        raise ContractError("feature names must be the interaction and approach features, each once")
    classes = raw["class_map"]
    try:
        keys = sorted(int(k) for k in classes)
    except (TypeError, ValueError) as e:
        raise ContractError("class_map keys must be integers") from e
    if not keys or keys != list(range(len(keys))) or len(set(map(str, classes.values()))) != len(keys) or not all(isinstance(v, str) for v in classes.values()):
        raise ContractError("class_map must number different labels from 0")
    return Contract(raw)


def load(path: str, expected_engine: str | None = None, version: str | None = None) -> Contract:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ContractError("the contract cannot be read") from e
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ContractError("the contract is not JSON") from e
    return parse(raw, expected_engine, version)
