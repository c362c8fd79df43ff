"""Life cycles of replayed and live streams, each around a StreamingQuery."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ticks import POSIX_PATH, SECRET, SECRET_WORD, WINDOWS_PATH


def clean_text(text: str | None) -> str | None:
    if text is None:
        return None
    for pattern, what in ((WINDOWS_PATH, "<path>"), (POSIX_PATH, "<path>"), (SECRET, "<redacted>"), (SECRET_WORD, "<redacted>")):
        text = re.sub(pattern, what, text)
    return text


def clean_metadata(metadata: dict[Any, Any] | None) -> dict[str, Any]:
    """Texts cleaned; a key that names a secret is hidden."""
    safe = lambda k: "<redacted_key>" if re.search(SECRET_WORD, str(k)) else clean_text(str(k))
    return {safe(k): clean_text(v) if isinstance(v, str) else v for k, v in (metadata or {}).items()}


@dataclass
class Controlled:
    """A stream (of tape_stream, say) with its sink and checkpoint; what it has done is told by state, events, warnings, error, started, ended.

    on_batch gets each micro-batch that has rows, with its number; a batch without any is no delta. Rows of kind warning are counted.
    """

    stream: DataFrame
    checkpoint: str
    on_batch: Callable[[DataFrame, int], None]
    mode: str = "append"
    state: str = "idle"
    error: str | None = None
    events: int = 0
    warnings: int = 0
    started: datetime | None = None
    ended: datetime | None = None
    query: StreamingQuery | None = None
    _seen: int = field(default=0, repr=False)

    def _batch(self, batch: DataFrame, number: int) -> None:
        told = "kind" in batch.columns
        if told:
            batch = batch.persist()
        try:
            rows, warnings = batch.agg(F.count("*"), F.count_if(F.col("kind") == "warning") if told else F.lit(0)).first()
            if rows:
                self.warnings += warnings
                self.on_batch(batch, number)
        finally:
            batch.unpersist()

    def _launch(self, **trigger: Any) -> None:
        if self.query is not None and self.query.isActive or self.state in ("running", "connecting"):
            raise RuntimeError("it is running already")
        self.state, self.error, self.ended = "connecting", None, None
        self.started = datetime.now(UTC)
        try:
            self.query = self.stream.writeStream.outputMode(self.mode).option("checkpointLocation", self.checkpoint).foreachBatch(self._batch).trigger(**trigger).start()
        except Exception as e:
            self._fail(e)
            raise
        self._seen, self.state = 0, "running"

    def _fail(self, e: Exception) -> None:
        self.state, self.error, self.ended = "failed", clean_text(str(e).split("\n")[0]), datetime.now(UTC)

    def _count(self) -> int:
        """Rows read, from the query's progress."""
        read = sum(p["numInputRows"] for p in self.query.recentProgress) if self.query else 0
        self.events, self._seen = self.events + read - self._seen, read
        return self.events

    def _halt(self, state: str) -> None:
        if self.query is not None:
            self.query.stop()
            self._count()
        self.state, self.ended = state, datetime.now(UTC)

    def _watch(self, ended: str, timeout: float | None, enough: Callable[[], bool] = lambda: False) -> str:
        """Until the query ends, so many seconds have gone, or there is enough."""
        until = None if timeout is None else time.monotonic() + timeout
        try:
            while self.state == "running" and (until is None or time.monotonic() < until):
                if self.query.awaitTermination(1 if until is None else max(0.05, min(1, until - time.monotonic()))):
                    self._count()
                    self.state, self.ended = ended, datetime.now(UTC)
                elif enough():
                    self._halt("stopped")
        except Exception as e:
            self._count()
            self._fail(e)
        return self.state


@dataclass
class Replay(Controlled):
    """A bounded stream, run to its end from files: idle, running, paused, completed, failed or stopped.

    Pausing stops the query; resuming starts it from its checkpoint. With max_events it stops after the micro-batch in
    which so many rows were read. With a speed, each batch waits for the time between its latest event and that of the batch
    before, divided by the speed, a quarter of a second at most.
    """

    max_events: int | None = None
    speed: float = 0.0
    time_column: str = "ts"
    longest_wait: float = 0.25
    _last: datetime | None = field(default=None, repr=False)

    def start(self) -> None:
        self._launch(availableNow=True)

    resume = start

    def _batch(self, batch: DataFrame, number: int) -> None:
        if self.speed > 0:
            latest = batch.agg(F.max(self.time_column)).first()[0]
            if latest is not None and self._last is not None:
                time.sleep(min(max((latest - self._last).total_seconds(), 0.0) / self.speed, self.longest_wait))
            self._last = latest or self._last
        super()._batch(batch, number)

    def wait(self, timeout: float | None = None) -> str:
        """Until the end, the most events, or so many seconds."""
        return self._watch("completed", timeout, lambda: self.max_events is not None and self._count() >= self.max_events)

    def pause(self) -> None:
        if self.state == "running":
            self._halt("paused")

    def stop(self) -> None:
        if self.state not in ("completed", "failed"):
            self._halt("stopped")

    def reset(self, checkpoint: str) -> None:
        """Begin anew: state lives in the checkpoint, so another one is empty; prior days and static levels are settings and stay."""
        self.stop()
        self.checkpoint, self.state, self.error, self.query, self.events, self.warnings, self._last = checkpoint, "idle", None, None, 0, 0, None


@dataclass
class Live(Controlled):
    """An unbounded stream: idle, connecting, running, stopped, failed, or disconnected if it ends by itself. start returns at once; if it fails, the error is told and raised."""

    interval: str = "1 second"

    def start(self) -> None:
        self._launch(processingTime=self.interval)

    def wait(self, timeout: float | None = None) -> str:
        return self._watch("disconnected", timeout)

    def stop(self) -> None:
        self._halt("stopped")
