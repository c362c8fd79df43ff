"""Prices, timestamps and text of data-quality notes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TICK_SIZE

# What is taken out of messages.
WINDOWS_PATH = r"[A-Za-z]:\\[^\s,;]+"
POSIX_PATH = r"/(?:[^\s,;]+/)+[^\s,;]+"
SECRET = r"(?i)(secret|token|password|api[_-]?key)\s*[:=]\s*[^\s,;]+"
SECRET_WORD = r"(?i)secret|token|password|api[_-]?key"


def exact_ticks(price: Column, tick_size: float = TICK_SIZE) -> Column:
    """Whole ticks of a price on the grid, by decimals; null for off-grid, null, NaN and infinite prices."""
    exact = price.cast("string").try_cast("decimal(38,18)")
    size = F.lit(str(tick_size)).cast("decimal(38,18)")
    return F.when((exact % size) == 0, F.round(exact / size).cast("long"))


def nearest_ticks(price: Column, tick_size: float = TICK_SIZE) -> Column:
    """The nearest tick, halves to even."""
    return F.rint(price / tick_size).cast("long")


def side_signed(price_ticks: Column, side: Column) -> Column:
    """Buys ascend, all else descends; so a sweep within one instant keeps its direction."""
    return F.when(F.upper(side) == "B", price_ticks).otherwise(-price_ticks)


def from_nanos(ns: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp, floored to microseconds."""
    micros = F.floor(ns / F.lit(1000).cast("decimal(4,0)")).cast("long")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def from_iso(text: Column) -> Column:
    """ISO text with an offset (Z is one) as UTC; null without an offset."""
    has_offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(has_offset, F.convert_timezone(F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")))


def redact(text: Column) -> Column:
    """Local paths and what looks like a secret replaced."""
    for pattern, what in ((WINDOWS_PATH, "<path>"), (POSIX_PATH, "<path>"), (SECRET, "<redacted>"), (SECRET_WORD, "<redacted>")):
        text = F.regexp_replace(text, pattern, what)
    return text


def safe_source(source: Column) -> Column:
    """A source name without its folders."""
    clean = redact(source)
    return F.when((clean == source) & source.rlike(r"[/\\]"), F.element_at(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), -1)).otherwise(clean)


def redact_metadata(metadata: Column) -> Column:
    """A map of texts with its values redacted; a key that names a secret is hidden, and of equal keys then the last stays."""
    name = lambda k: F.when(redact(k).rlike(SECRET_WORD) | k.rlike(SECRET_WORD), "<redacted_key>").otherwise(redact(k))
    entries = F.transform(F.map_entries(metadata), lambda e: F.struct(name(e["key"]).alias("key"), redact(e["value"]).alias("value")))
    # Maps refuse equal keys, so an entry goes if a later one has its key.
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))
