"""Bars, levels, zones and touches from a stream of typed events, with typed state by symbol.

A state processor in Python, as no built-in streaming operator counts trades into bars; but no event is handled by
itself. Rows of a symbol's micro-batch are sorted in canonical order, and the trades between two control rows become
bars by arrays: their days and sessions, the cuts after every N trades, the extremes of each cut, the running
extremes of sessions, and the first bar that meets each zone while the levels stay as they are. Rows that come in a later
batch are never discarded: a trade earlier than what was accepted is noted, and processed or dropped as asked.

A day ends with the first trade of another one, with an `end` row, or by an event-time timer, once the stream as a whole is
`delay_min` minutes past the day's end. The watermark serves these timers alone: its column lies a hundred years ahead
of the events, so no row is ever late for it.

State of a symbol, in columns: the current day with the ranges of its sessions; open bars by size; the last quote; the last
bars and notes up to a limit; and by day a small record (next bar numbers, touched zones, range), of which the touched
zones go after `keep_days`. All rows that a symbol has in a micro-batch are handled in one task, so the source should bound a
batch (maxFilesPerTrigger or maxBytesPerTrigger). They reach it as blocks: Spark hands rows to a state processor one at a time, as
objects, so the tasks that read the source pack a symbol's rows into a few binary values, each an Arrow table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, time, timedelta
from typing import Any
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import DIRECTION, EASTERN, LEVEL_ORDER, LEVEL_SIDE, TICK_SIZE, Scheme
from ..operators import evolving

OUTPUT = "symbol string, kind string, ts timestamp_ntz, trading_day date, bar_index long, timeframe_ticks int, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, trade_count long, close_reason string, representative_price double, direction string, level_type string, code string, message string"
KIND = {n: {"long": "Int64", "int": "Int32", "double": "float64", "timestamp_ntz": "datetime64[us]"}.get(t, object) for n, t in (c.split() for c in OUTPUT.split(", "))}
#: Columns of the events: a row of kind trade, quote, warning, end, reset or clock has those that it needs. A clock row only tells the time.
EVENTS = "symbol string, kind string, ts_event timestamp_ntz, sequence long, price_ticks long, size long, side string, bid_ticks long, ask_ticks long, bid_size long, ask_size long, code string, message string"
KINDS = ("trade", "quote", "warning", "end", "reset", "clock")
CONTROL = ("warning", "end", "reset")
#: Rows that a task packs at a time.
BLOCK_ROWS = 65_536
#: How far the watermark's column is ahead of the events.
AHEAD_DAYS = 36_500
EPOCH = datetime(1970, 1, 1)
_NO_HIGH, _NO_LOW = np.iinfo(np.int64).min, np.iinfo(np.int64).max

BAR = "ts long, trading_day int, bar_index long, timeframe_ticks int, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, trade_count long, close_reason string"
STATE = {
    "tape": "day int, session string, accepted long, last_ts long, regressions long, events long, status string, high long, low long, asia_high long, asia_low long, london_high long, london_low long, pdh long, pdl long, fired array<string>",
    "quote": "ts long, bid_ticks long, ask_ticks long, bid_size long, ask_size long",
    "open": "first long, last long, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, trade_count long, next_index long",
    "days": "high long, low long, sizes array<int>, next_index array<long>, fired array<string>",
    "recent": BAR,
    "notes": "ts long, code string, message string",
}
_TAPE, _DAY = ([c.split()[0] for c in STATE[name].split(", ")] for name in ("tape", "days"))


def micros(ts: datetime) -> int:
    return (ts - EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=int(us))


def day_number(day: date) -> int:
    return (day - EPOCH.date()).days


@dataclass
class Clock:
    """Days and sessions of a scheme, for arrays of instants in microseconds."""

    scheme: Scheme

    def utc(self, day: int, at: time, shift: int = 0) -> int:
        here = datetime.combine(EPOCH.date() + timedelta(days=int(day) + shift), at, tzinfo=ZoneInfo(self.scheme.timezone))
        return micros(here.astimezone(ZoneInfo("UTC")).replace(tzinfo=None))

    def place(self, ts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(day number, session number): of sessions in the scheme's order, -1 for none and -2 within the closed window."""
        local = pd.DatetimeIndex(ts.astype("datetime64[us]")).tz_localize("UTC").tz_convert(self.scheme.timezone).tz_localize(None).to_numpy().astype("datetime64[us]").astype(np.int64)
        day, tod = np.divmod(local, 86_400_000_000)
        of = lambda t: ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond
        inside = lambda s: (tod >= of(s.start)) | (tod < of(s.end)) if s.crosses_midnight else (tod >= of(s.start)) & (tod < of(s.end))
        session = np.full(len(ts), -1)
        for k in reversed(range(len(self.scheme.sessions))):
            session[inside(self.scheme.sessions[k])] = k
        if self.scheme.closed:
            session[inside(self.scheme.closed)] = -2
        return day + (tod >= of(self.scheme.boundary)), session

    def name(self, session: int) -> str:
        return {-1: "none", -2: "closed"}.get(int(session)) or self.scheme.sessions[int(session)].name


@dataclass
class Settings:
    scheme: Scheme = EASTERN
    sizes: tuple[int, ...] = (147,)
    tick_size: float = TICK_SIZE
    proximity: float = 3.0
    static_levels: tuple[tuple[str, float, str], ...] = ()
    own_levels: bool = True  # levels of the stream's own days and sessions beside the static ones
    carry_prior_day: bool = False  # else only ranges of earlier days that are given count
    max_back: int = 7  # calendar days to the prior day, at most
    late: str = "process"  # or drop: what is done with a trade earlier than one accepted before
    keep_days: int = 30
    recent_bars: int = 500
    recent_notes: int = 100

    def __post_init__(self) -> None:
        self.sizes = tuple(sorted(set(self.sizes)))
        if not self.sizes or self.sizes[0] <= 0:
            raise ValueError("bar sizes must be positive")
        if self.late not in ("process", "drop"):
            raise ValueError("late events are processed or dropped")


@dataclass
class Open:
    """A forming bar of a size, if it has trades, and the number of the next bar of the day."""

    first: int = 0
    last: int = 0
    open_ticks: int = 0
    high_ticks: int = 0
    low_ticks: int = 0
    close_ticks: int = 0
    volume: int = 0
    trade_count: int = 0
    next_index: int = 0


@dataclass
class Found:
    """Rows that a batch gives, as columns."""

    frames: list[pd.DataFrame] = field(default_factory=list)

    def add(self, kind: str, **columns: Any) -> None:
        n = max((len(v) for v in columns.values() if isinstance(v, (list, np.ndarray))), default=1)
        self.frames.append(pd.DataFrame({"kind": [kind] * n} | {k: v if isinstance(v, (list, np.ndarray)) else [v] * n for k, v in columns.items()}))

    def frame(self, symbol: str) -> pd.DataFrame | None:
        if not self.frames:
            return None
        rows = pd.concat(self.frames, ignore_index=True)
        if "trading_day" in rows:
            dates = {d: EPOCH.date() + timedelta(days=int(d)) for d in rows["trading_day"].dropna().unique()}
            rows["trading_day"] = pd.Series([dates.get(d) for d in rows["trading_day"]], dtype=object)
        gone = rows["ts"].isna().to_numpy()
        rows["ts"] = np.where(gone, np.datetime64("NaT", "us"), rows["ts"].where(~gone, 0).to_numpy().astype(np.int64).astype("datetime64[us]"))
        rows["symbol"] = symbol
        return pd.DataFrame({c: rows[c].astype(k) if c in rows else pd.Series([None] * len(rows), dtype=k) for c, k in KIND.items()})


class TapeProcessor(StatefulProcessor):
    """prior_days: (symbol, day, high, low in ticks) of days before the stream begins."""

    def __init__(self, prior_days: tuple[tuple[str, date, int, int], ...] = (), delay_min: int = 60, **settings: Any):
        self.cfg = Settings(**settings)
        for _, _, high, low in prior_days:
            if high < low:
                raise ValueError("the high of a day is below its low")
        self.prior_days, self.clock, self.delay_min = prior_days, Clock(self.cfg.scheme), delay_min
        self._known: tuple[int | None, dict[str, int]] = (None, {})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tape, self.quote = handle.getValueState("tape", STATE["tape"]), handle.getValueState("quote", STATE["quote"])
        self.open, self.days = handle.getMapState("open", "size int", STATE["open"]), handle.getMapState("days", "day int", STATE["days"])
        self.recent, self.notes = handle.getListState("recent", STATE["recent"]), handle.getListState("notes", STATE["notes"])

    # What a symbol has: read once for a batch, and written once after it.

    def _begin(self, symbol: str) -> None:
        self._days: dict[int, dict[str, Any]] = {}  # records that were read or changed in this batch
        self._changed: set[int] = set()
        if self.tape.exists():
            self.st = dict(zip(_TAPE, self.tape.get(), strict=True))
            self.st["fired"] = list(self.st["fired"] or ())
        else:
            self.st = self._fresh()
            for name, day, high, low in self.prior_days:
                if name == symbol:
                    self._file(day_number(day), high=high, low=low)
        self.bars = {n: Open(*self.open.getValue((n,))) if self.open.containsKey((n,)) else Open() for n in self.cfg.sizes}
        self.found, self.new_bars, self.new_notes, self.fired = Found(), [], [], set(self.st["fired"])

    @staticmethod
    def _fresh() -> dict[str, Any]:
        return dict.fromkeys(_TAPE) | {"regressions": 0, "events": 0, "status": "ok", "fired": []}

    def _end(self) -> None:
        self.st["fired"] = sorted(self.fired)
        self.tape.update(tuple(self.st[c] for c in _TAPE))
        for day in sorted(self._changed):
            self.days.updateValue((day,), tuple(self._days[day][c] for c in _DAY))
        for n, bar in self.bars.items():
            self.open.updateValue((n,), tuple(vars(bar).values()))
        for state, new, most in ((self.recent, self.new_bars, self.cfg.recent_bars), (self.notes, self.new_notes, self.cfg.recent_notes)):
            if new:
                old = list(state.get()) if state.exists() and len(new) < most else []
                state.put([tuple(x) for x in (*old, *new)][-most:] if most else [])

    def _record(self, day: int) -> dict[str, Any]:
        if day not in self._days:
            self._days[day] = dict(zip(_DAY, self.days.getValue((day,)), strict=True)) if self.days.containsKey((day,)) else dict.fromkeys(_DAY)
        return self._days[day]

    def _file(self, day: int, **changes: Any) -> None:
        self._days[day] = self._record(day) | changes
        self._changed.add(day)

    # Events

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = in_order(unpacked(block for part in rows for block in part["block"]))
        kind = batch["kind"].to_numpy(object)
        if unknown := set(kind) - set(KINDS):
            raise TypeError(f"unsupported kind of event: {sorted(unknown)[0]}")
        if set(kind) == {"clock"}:
            return
        self._begin(key[0])
        batch, kind = self._sound(batch, kind)
        ts = batch["ts_event"].to_numpy("datetime64[us]").astype(np.int64)
        cuts = np.flatnonzero(np.isin(kind, CONTROL))
        start = 0
        for cut in [*cuts, len(batch)]:
            self._quotes(batch, kind, ts, start, cut)
            at = start + np.flatnonzero(kind[start:cut] == "trade")
            if len(at):
                self._trades(ts[at], batch["price_ticks"].to_numpy()[at].astype(np.int64), batch["size"].to_numpy()[at].astype(np.int64))
            if cut < len(batch):
                self._control(batch.iloc[cut], None if pd.isna(batch["ts_event"].iloc[cut]) else int(ts[cut]))
            start = cut + 1
        self._end()
        if (out := self.found.frame(key[0])) is not None:
            yield out

    def _sound(self, batch: pd.DataFrame, kind: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """Without trades and quotes that lack a time, a price or a size, each of which is noted."""
        timeless = batch["ts_event"].isna().to_numpy() & np.isin(kind, ("trade", "quote"))
        lacks = lambda *names: batch[list(names)].isna().any(axis=1).to_numpy()
        empty = (kind == "trade") & lacks("price_ticks", "size")
        if (quote := kind == "quote").any():
            empty |= quote & lacks("bid_ticks", "ask_ticks")
        for i in np.flatnonzero(timeless | empty):
            ts = batch["ts_event"].iloc[i]
            self._note("invalid_timestamp" if timeless[i] else "invalid_record", f"{kind[i]} record rejected", None if timeless[i] else micros(ts.to_pydatetime()))
        keep = ~(timeless | empty)
        return (batch, kind) if keep.all() else (batch[keep], kind[keep])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The day of the timer has ended, unless another one is current by now."""
        self._begin(key[0])
        if self.st["day"] is not None and self._day_end(self.st["day"]) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self._finish_day()
        self._end()
        if (out := self.found.frame(key[0])) is not None:
            yield out

    def _quotes(self, batch: pd.DataFrame, kind: np.ndarray, ts: np.ndarray, start: int, end: int) -> None:
        """Only the last quote is kept."""
        at = start + np.flatnonzero(kind[start:end] == "quote")
        if len(at):
            q = batch.iloc[at[-1]]
            self.quote.update((int(ts[at[-1]]), *(int(0 if pd.isna(q[c]) else q[c]) for c in ("bid_ticks", "ask_ticks", "bid_size", "ask_size"))))
            self.st["last_ts"] = int(ts[at[-1]])
            self.st["events"] += len(at)

    def _control(self, row: pd.Series, ts: int | None) -> None:
        if row["kind"] == "warning":
            self._note(row["code"], row["message"], ts)
        elif row["kind"] == "end":
            self._finish_day()
        else:  # reset: forget the day, but not the ranges of earlier days nor the static levels
            if self.st["day"] is not None:
                self._file(self.st["day"], sizes=None, next_index=None, fired=None)
            self.st, self.fired = self._fresh(), set()
            self.bars = {n: Open() for n in self.cfg.sizes}
            self.new_bars, self.new_notes = [], []
            for state in (self.quote, self.recent, self.notes):
                state.clear()

    def _note(self, code: str | None, message: str | None, ts: int | None) -> None:
        """A data-quality note: the latest are kept, and the feed is degraded."""
        self.new_notes.append((ts, code, message))
        self.st["status"] = "degraded"
        self.found.add("warning", ts=[ts], code=[code], message=[message])

    def _trades(self, ts: np.ndarray, price: np.ndarray, size: np.ndarray) -> None:
        """Trades in order of time."""
        accepted = self.st["accepted"]
        if accepted is not None and ts[0] < accepted:
            # Sorted trades can only be late for an earlier batch: all before what was accepted, or the first, with which it moves back.
            late = int(np.searchsorted(ts, accepted)) if self.cfg.late == "drop" else 1
            for t in ts[:late]:
                self._note("timestamp_regression", f"earlier than {moment(accepted).isoformat()}", int(t))
            self.st["regressions"] += late
            if self.cfg.late == "drop":
                ts, price, size = ts[late:], price[late:], size[late:]
        if not len(ts):
            return
        self.st["accepted"] = self.st["last_ts"] = int(ts[-1])
        self.st["events"] += len(ts)
        day, session = self.clock.place(ts)
        self.st["session"] = self.clock.name(session[-1])
        on = session != -2
        ts, price, size, day, session = ts[on], price[on], size[on], day[on], session[on]
        edges = [0, *(np.flatnonzero(np.diff(day)) + 1), len(day)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                if self.st["day"] != day[lo]:
                    self._finish_day()
                    self._turn_to(int(day[lo]))
                self._trades_of_day(ts[lo:hi], price[lo:hi], size[lo:hi], session[lo:hi])

    def _trades_of_day(self, ts: np.ndarray, price: np.ndarray, size: np.ndarray, session: np.ndarray) -> None:
        for n in self.cfg.sizes:
            bar = self.bars[n]
            starts = np.arange(0, len(ts), n) if not bar.trade_count else np.concatenate(([0], np.arange(n - bar.trade_count, len(ts), n)))
            ends = np.append(starts[1:], len(ts))
            cut = {
                "first": ts[starts], "last": ts[ends - 1], "open_ticks": price[starts], "high_ticks": np.maximum.reduceat(price, starts), "low_ticks": np.minimum.reduceat(price, starts),
                "close_ticks": price[ends - 1], "volume": np.add.reduceat(size, starts), "trade_count": ends - starts,
            }
            if bar.trade_count:  # the first cut goes on with the open bar
                cut["first"][0], cut["open_ticks"][0] = bar.first, bar.open_ticks
                cut["high_ticks"][0], cut["low_ticks"][0] = max(bar.high_ticks, cut["high_ticks"][0]), min(bar.low_ticks, cut["low_ticks"][0])
                cut["volume"][0] += bar.volume
                cut["trade_count"][0] += bar.trade_count
            full = len(starts) - (cut["trade_count"][-1] < n)
            left = {k: int(v[-1]) for k, v in cut.items()} if full < len(starts) else {}
            done = {k: v[:full] for k, v in cut.items()}
            self.bars[n] = Open(**left, next_index=bar.next_index + full)
            if full:
                self._tell(n, bar.next_index, done, "complete")
            if n == self.cfg.sizes[0]:
                self._touches(done, bar.next_index, ends[:full] - 1, price, session)
        st = self.st
        st["high"], st["low"] = max(int(price.max()), _NO_HIGH if st["high"] is None else st["high"]), min(int(price.min()), _NO_LOW if st["low"] is None else st["low"])

    def _tell(self, n: int, index: int, done: dict[str, np.ndarray], reason: str) -> None:
        count = len(done["last"])
        own = {k: v for k, v in done.items() if k not in ("first", "last")}
        self.found.add("bar", ts=done["last"], trading_day=self.st["day"], bar_index=np.arange(index, index + count), timeframe_ticks=n, **own, close_reason=reason)
        last = slice(max(0, count - self.cfg.recent_bars), count)
        for i in range(count)[last]:
            self.new_bars.append((int(done["last"][i]), self.st["day"], index + i, n, *(int(done[c][i]) for c in ("open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count")), reason))

    def _touches(self, done: dict[str, np.ndarray], index: int, ends: np.ndarray, price: np.ndarray, session: np.ndarray) -> None:
        """First touches by the closed bars of the smallest size, whose last trades are at ends; the sessions' ranges move on with all trades."""
        st, so_far = self.st, {}
        for k, s in enumerate(self.cfg.scheme.sessions):
            if s.name in evolving.SESSIONS:
                mine = session == k
                for name, none, least in ((f"{s.name}_high", _NO_HIGH, np.maximum), (f"{s.name}_low", _NO_LOW, np.minimum)):
                    run = least.accumulate(np.concatenate(([none if st[name] is None else st[name]], np.where(mine, price, none))))[1:]
                    so_far[name] = run[ends]
                    st[name] = None if run[-1] == none else int(run[-1])
        if not len(ends):
            return
        moves = np.zeros(len(ends), bool)
        moves[0] = True
        for run in so_far.values():
            moves[1:] |= run[1:] != run[:-1]
        edges = [*np.flatnonzero(moves), len(ends)]
        for lo, hi in zip(edges, edges[1:]):  # the zones are the same for all these bars
            known = {name: None if run[lo] in (_NO_HIGH, _NO_LOW) else int(run[lo]) for name, run in so_far.items()}
            self._first_hits(known, {k: v[lo:hi] for k, v in done.items()}, index + lo)

    def _first_hits(self, ranges: dict[str, int | None], bars: dict[str, np.ndarray], index: int) -> None:
        tick, day = self.cfg.tick_size, self.st["day"]
        hits = []
        for price, names, side, known in self._zones(ranges):
            key = f"{','.join(names)}|{price:.6f}|{side}"
            if key in self.fired:
                continue
            hit = (bars["low_ticks"] * tick <= price) & (price <= bars["high_ticks"] * tick)
            if known is not None:
                hit &= bars["last"] >= known
            if hit.any():
                self.fired.add(key)
                hits.append((int(hit.argmax()), price, side, names[0]))
        for at, price, side, name in sorted(hits, key=lambda h: h[0]):
            self.found.add("touch", ts=[int(bars["last"][at])], trading_day=[day], bar_index=[index + at], timeframe_ticks=[self.cfg.sizes[0]], representative_price=[price], direction=[DIRECTION[side]], level_type=[name])

    def _zones(self, ranges: dict[str, int | None]) -> list[tuple[float, tuple[str, ...], str, int | None]]:
        levels: list[tuple[float, str, str, int | None]] = [(p, n, s, None) for n, p, s in self.cfg.static_levels]
        if self.cfg.own_levels:
            ticks = ranges | {"pdh": self.st["pdh"], "pdl": self.st["pdl"]}
            for name in LEVEL_ORDER:
                if ticks.get(name) is not None:
                    levels.append((ticks[name] * self.cfg.tick_size, name, LEVEL_SIDE[name], self._known_from()[name]))
        groups: list[list] = []
        for level in sorted(levels, key=lambda x: x[0]):
            if groups and level[0] - groups[-1][-1][0] <= self.cfg.proximity:
                groups[-1].append(level)
            else:
                groups.append([level])
        return [(sum(x[0] for x in g) / len(g), tuple(x[1] for x in g), "HIGH" if 2 * sum(x[2] == "HIGH" for x in g) > len(g) else "LOW", max((x[3] for x in g if x[3] is not None), default=None)) for g in groups]

    def _known_from(self) -> dict[str, int]:
        """From when each level of the current day is known."""
        day = self.st["day"]
        if self._known[0] != day:
            ends = {s.name: s.end for s in self.cfg.scheme.sessions}
            self._known = day, {n: self.clock.utc(day, self.cfg.scheme.boundary, -1) if n.startswith("pd") else self.clock.utc(day, ends[n.split("_")[0]]) for n in LEVEL_ORDER}
        return self._known[1]

    # Days

    def _day_end(self, day: int) -> int:
        return self.clock.utc(day, self.cfg.scheme.boundary)

    def _finish_day(self) -> None:
        """Close what is open, as at the end of the day, with what it touches by the day's own levels; and file the day."""
        st = self.st
        if st["day"] is None:
            return
        for n in self.cfg.sizes:
            bar = self.bars[n]
            if bar.trade_count:
                done = {k: np.array([v]) for k, v in vars(bar).items() if k != "next_index"}
                self._tell(n, bar.next_index, done, "end_of_day")
                self.bars[n] = Open(next_index=bar.next_index + 1)
                if n == self.cfg.sizes[0]:
                    self._first_hits({f"{s}_{e}": st[f"{s}_{e}"] for s in evolving.SESSIONS for e in ("high", "low")}, done, bar.next_index)
        was = self._record(st["day"])
        changes: dict[str, Any] = {"sizes": list(self.bars), "next_index": [b.next_index for b in self.bars.values()], "fired": sorted(self.fired)}
        if self.cfg.carry_prior_day and st["high"] is not None:
            changes |= {"high": max(x for x in (was["high"], st["high"]) if x is not None), "low": min(x for x in (was["low"], st["low"]) if x is not None)}
        self._file(st["day"], **changes)

    def _turn_to(self, day: int) -> None:
        """Open a day, which may have been there before: then its bars go on with their numbers, and its zones stay touched."""
        was, st = self._record(day), self.st
        numbers = dict(zip(was["sizes"] or (), was["next_index"] or (), strict=True))
        self.bars = {n: Open(next_index=numbers.get(n, 0)) for n in self.cfg.sizes}
        self.fired = set(was["fired"] or ())
        st |= dict.fromkeys(["high", "low", *(f"{s}_{e}" for s in evolving.SESSIONS for e in ("high", "low")), "pdh", "pdl"]) | {"day": day}
        if self.cfg.own_levels:
            for back in range(1, self.cfg.max_back + 1):
                if (prior := self._record(day - back))["high"] is not None:
                    st["pdh"], st["pdl"] = prior["high"], prior["low"]
                    break
        for k in range(self.cfg.keep_days, self.cfg.keep_days + 7):  # a week, as some days have no trades
            if self._record(day - k)["fired"]:
                self._file(day - k, fired=[])
        self.handle.registerTimer(self._day_end(day) // 1000)

    def close(self) -> None:
        pass


def in_order(events: pd.DataFrame) -> pd.DataFrame:
    """Events of one symbol in canonical order; at an instant and number what ends or resets comes last."""
    trade = events["kind"].ne("quote").to_numpy()
    number = lambda c: events[c].fillna(0).to_numpy().astype(np.int64) if events[c].notna().any() else np.zeros(len(events), np.int64)
    price, size = number("price_ticks"), number("size")
    signed = np.where(events["side"].isin(["B", "b"]).to_numpy(), price, -price)
    ts = events["ts_event"].to_numpy("datetime64[us]").astype(np.int64)
    ts = np.where(events["ts_event"].isna().to_numpy(), np.iinfo(np.int64).max, ts)
    return events.iloc[np.lexsort((size * trade, signed * trade, number("sequence"), events["kind"].isin(["end", "reset"]).to_numpy(), ts))]


def canonical(events: DataFrame) -> list[Column]:
    """The same order as columns of a table of events, so that it can be cut at any place, between rows of an instant too."""
    have = set(events.columns)
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in have else F.lit(0).cast("long")
    kind = F.coalesce(F.col("kind"), F.lit("trade")) if "kind" in have else F.lit("trade")
    buys = F.coalesce(F.col("side").isin("B", "b"), F.lit(False)) if "side" in have else F.lit(False)
    of_trade = lambda c: F.when(kind == "quote", F.lit(0).cast("long")).otherwise(c)
    return [F.col("ts_event"), kind.isin("end", "reset"), number("sequence"), of_trade(F.when(buys, number("price_ticks")).otherwise(-number("price_ticks"))), of_trade(number("size"))]


_COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]
PACKED = "symbol string, ts_event timestamp_ntz, block binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: a row for each symbol and BLOCK_ROWS rows read, with its latest time and its rows as an Arrow stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield _blocks(held)
            held = []
    if held:
        yield _blocks(held)


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    names = pa.concat_arrays(table.column("symbol").chunks).dictionary_encode("encode")
    code = names.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    edges = np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(code))
    table, symbols, latest, blocks = table.take(pa.array(order)), [], [], []
    for lo, hi in zip(edges, edges[1:]):
        part = table.slice(lo, hi - lo)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.drop_columns(["symbol"]).schema) as out:
            out.write_table(part.drop_columns(["symbol"]))
        symbols.append(part.column("symbol")[0].as_py())
        latest.append(pa.compute.max(part.column("ts_event")).as_py())
        blocks.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(symbols, pa.string()), pa.array(latest, pa.timestamp("us")), pa.array(blocks, pa.binary())], names=["symbol", "ts_event", "block"])


def unpacked(blocks: Iterator[bytes]) -> pd.DataFrame:
    """The events of packed blocks; a column that the stream does not have is null."""
    table = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks])
    events = table.to_pandas()
    for name in _COLUMNS[1:]:
        if name not in events:
            events[name] = None
    return events


def tape_stream(events: DataFrame, delay_min: int = 60, **settings: Any) -> DataFrame:
    """Closed bars, touches and warnings (column kind) of a stream of events.

    events has columns of EVENTS; without a kind all are trades. settings: those of Settings, and prior_days
    (symbol, day, high, low in ticks), ranges of days before the stream. delay_min: how long after a day's end, by the latest event of any
    symbol, its open bars are closed.
    """
    have = set(events.columns)
    columns = [F.coalesce(F.col("kind"), F.lit("trade")).alias("kind") if n == "kind" and n in have else F.lit("trade").alias("kind") if n == "kind" else F.col(n).cast(t).alias(n) for n, t in (c.split() for c in EVENTS.split(", ")) if n in have or n == "kind"]
    ahead = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts_event"))) + F.expr(f"INTERVAL {AHEAD_DAYS} DAYS")
    blocks = events.select(*columns).mapInArrow(packed, PACKED)
    clocked = blocks.select("symbol", "block", ahead.alias("_clock")).withWatermark("_clock", f"{AHEAD_DAYS * 1440 + delay_min} minutes")
    return clocked.groupBy("symbol").transformWithStateInPandas(TapeProcessor(delay_min=delay_min, **settings), OUTPUT, "Append", "EventTime")


def read_snapshot(spark: SparkSession, checkpoint: str, scheme: Scheme = EASTERN, tick_size: float = TICK_SIZE, proximity: float = 3.0, static_levels: tuple[tuple[str, float, str], ...] = (), own_levels: bool = True) -> DataFrame:
    """A row a symbol of what a stopped or running stream has kept in its checkpoint, from its state tables.

    symbol, trading_day, session, status, events, regressions, last_ts, quote, current (open bars), recent (closed bars), notes,
    levels, and zones with whether they were touched; the zones are those that the next bar would be held against.
    """
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    at = lambda us: (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=(us / 1_000_000).cast("decimal(18,6)")))
    day = lambda n: F.date_add(F.lit(EPOCH.date()), n)
    tape = state("tape").select("key.symbol", "value.*")
    bar = F.struct(F.col("k.size").alias("timeframe_ticks"), at(F.col("v.first")).alias("open_ts"), at(F.col("v.last")).alias("close_ts"), *[F.col(f"v.{c}").alias(c) for c in ("open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count")], F.col("v.next_index").alias("bar_index"))
    current = state("open").select("key.symbol", F.col("user_map_key").alias("k"), F.col("user_map_value").alias("v")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.when(F.col("v.trade_count") > 0, bar))).alias("current"))
    listed = lambda name, item: state(name).select("key.symbol", F.col("list_element").alias("x")).groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias(name))
    closed = F.struct(at(F.col("x.ts")).alias("close_ts"), F.col("x.timeframe_ticks").alias("timeframe_ticks"), day(F.col("x.trading_day")).alias("trading_day"), *[F.col(f"x.{c}").alias(c) for c in ("bar_index", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count", "close_reason")])
    note = F.struct(at(F.col("x.ts")).alias("ts"), F.col("x.code").alias("code"), F.col("x.message").alias("message"))
    quote = state("quote").select("key.symbol", F.struct(at(F.col("value.ts")).alias("ts"), *[F.col(f"value.{c}").alias(c) for c in ("bid_ticks", "ask_ticks", "bid_size", "ask_size")]).alias("quote"))
    named = tape.select("symbol", day(F.col("day")).alias("trading_day"), "session", "status", "events", "regressions", at(F.col("last_ts")).alias("last_ts"), F.col("pdh").alias("pdh_ticks"), F.col("pdl").alias("pdl_ticks"), *[F.when(F.lit(own_levels), F.col(f"{s}_{e}")).alias(f"{s}_{e}") for s in evolving.SESSIONS for e in ("high", "low")], "fired")
    levels = evolving.with_levels(named, scheme, tick_size, static_levels)
    key = lambda z: F.concat_ws("|", F.array_join(z["names"], ","), F.format_string("%.6f", z["price"]), z["side"])
    zones = F.transform(evolving.folded("levels", proximity), lambda z: F.struct((z["total"] / z["n"]).alias("price"), z["names"].alias("names"), F.when(z["highs"] * 2 > z["n"], "HIGH").otherwise("LOW").alias("side"), z["known"].alias("available_from")))
    out = levels.withColumn("zones", zones).withColumn("zones", F.transform("zones", lambda z: F.struct(z["price"].alias("price"), z["names"].alias("names"), z["side"].alias("side"), z["available_from"].alias("available_from"), F.array_contains("fired", key(z)).alias("touched"))))
    for part in (current, listed("recent", closed), listed("notes", note), quote):
        out = out.join(part, "symbol", "left")
    return out.select("symbol", "trading_day", "session", "status", "events", "regressions", "last_ts", "quote", "current", "recent", "notes", "levels", "zones")
