"""One query per operator, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CENTRAL, EASTERN, EngineConfig, FeatureWindows, LabelPolicy
from ..functions import ticks
from ..functions.calendar import day_bounds, session_of, to_local, with_session
from ..operators import bars, dataset, diff, evolving, features, levels, ordering, outcomes, touches, zones
from .. import sinks
from ..sources import market
from ..sources.tape import damaged_copy, tape_book, tape_dirty, tape_dirty_book, tape_events, tape_lineitem, tape_messages, tape_symbols, tape_ties
from ..streaming import runs
from ..streaming.engine import read_snapshot
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
N = 7
T, B, L, Z, H = S.TAPE, S.BARS, S.LEVELS, S.zones(), S.touches()
TO_TOUCH = (T, B, L, Z, H)


def query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _chain(s: SparkSession, d: str) -> tuple[DataFrame, dataset.Chain]:
    t = tape_events(s, d)
    return t, dataset.chain(t, N)


def _bars(s: SparkSession, d: str, n=N) -> DataFrame:
    return bars.tick_bars(tape_events(s, d), n, EASTERN)


def _flat(z: DataFrame) -> DataFrame:
    return z.withColumn("names", F.array_join("names", ","))


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return market.normalize_quotes(tape_book(s, d))[0].drop("bid_size", "ask_size")


# Sources and normalising
query("src_trades_scan", S.with_(T, then="SELECT ts_event, sequence, price_ticks, size, side FROM tape"))(lambda s, d: market.normalize_trades(tape_events(s, d).drop("price_ticks"))[0])
_EVENTS = "ev AS (SELECT ts_event, sequence, 'trade' AS kind, price_ticks, size, side, NULL::BIGINT AS bid_ticks, NULL::BIGINT AS ask_ticks, NULL::BIGINT AS bid_size, NULL::BIGINT AS ask_size FROM book WHERE action = 'T' UNION ALL SELECT ts_event, sequence, 'quote', NULL, NULL, NULL, bid_ticks, ask_ticks, bid_size, ask_size FROM quotes)"
query("src_events_merged", S.with_(T, _EVENTS, then="SELECT ts_event, sequence, kind, price_ticks, bid_ticks, row_number() OVER (ORDER BY ts_event, sequence, CASE WHEN kind = 'quote' THEN 0 WHEN side = 'B' THEN price_ticks ELSE -price_ticks END, coalesce(size, 0))::BIGINT AS rank FROM ev"))(lambda s, d: ordering.merged(market.book_events(tape_book(s, d).drop("price_ticks"))[0]).select("ts_event", "sequence", "kind", "price_ticks", "bid_ticks", F.col("rank").cast("long").alias("rank")))
query("src_book_fanout", S.with_(T, _EVENTS, then="SELECT * FROM ev"))(lambda s, d: market.book_events(tape_book(s, d).drop("price_ticks"))[0])


def _filed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The book as files of two feeds, read back as events: front month by file, a day and a half; beside them a path without a file, a file without needed columns and one damaged midway."""
    place = sinks.scratch(s, "feeds")
    book = tape_dirty_book(s, d)
    book.where("sequence % 2 = 0").coalesce(1).write.parquet(f"{place}/a")
    book.where("sequence % 2 = 1").coalesce(1).write.parquet(f"{place}/b")
    book.drop("price", "size").limit(1).coalesce(1).write.parquet(f"{place}/c")
    # A file damaged in its middle: what is left of it lies before the range, so only its note counts.
    tape_book(s, d).drop("price_ticks").where("ts_event < TIMESTAMP_NTZ '2024-01-09 00:00:00'").coalesce(1).write.parquet(f"{place}/whole")
    damaged_copy(s, s.read.parquet(f"{place}/whole").inputFiles()[0], f"{place}/d/part.parquet")
    return market.read_events(s, [f"{place}/{n}" for n in ("a", "b", "c", "d", "none")], "MBP-10", datetime(2024, 1, 9, 23), datetime(2024, 1, 11, 11), front_month_only=True)


_FILED = """fb AS (SELECT *, sequence % 2 AS f FROM book WHERE symbol NOT LIKE '%-%'),
fv AS (SELECT f, instrument_id, sum(greatest(coalesce(nullif(size, 0), 1), 1)) AS v FROM fb GROUP BY 1, 2),
ff AS (SELECT f, arg_max(instrument_id, v) AS instrument_id FROM fv GROUP BY 1),
kept AS (SELECT b.* FROM fb b SEMI JOIN ff USING (f, instrument_id)),
fe AS (SELECT ts_event, sequence, 'trade' AS kind, price_ticks, size, side, NULL::BIGINT AS bid_ticks, NULL::BIGINT AS ask_ticks, NULL::BIGINT AS bid_size, NULL::BIGINT AS ask_size FROM kept WHERE action = 'T' AND sequence % 101 <> 0
  UNION ALL SELECT ts_event, sequence, 'quote', NULL, NULL, NULL, price_ticks - 1, price_ticks + 1 + sequence % 3, 1 + sequence % 9, sequence % 7 FROM kept WHERE sequence % 83 <> 0 AND sequence % 101 <> 0 AND sequence % 89 <> 0)"""
query("src_read_files", S.with_(T, _FILED, then="SELECT * FROM fe WHERE ts_event >= TIMESTAMP '2024-01-09 23:00:00' AND ts_event < TIMESTAMP '2024-01-11 11:00:00'"))(lambda s, d: _filed(s, d)[0])
query("src_read_notes", S.with_(T, _FILED, then="SELECT code, severity, count(*) AS n FROM (SELECT 'invalid_timestamp' AS code, 'warning' AS severity FROM kept WHERE sequence % 101 = 0 AND action = 'T' UNION ALL SELECT CASE WHEN sequence % 101 = 0 THEN 'invalid_timestamp' ELSE 'invalid_price' END, 'warning' FROM kept WHERE sequence % 83 <> 0 AND (sequence % 101 = 0 OR sequence % 89 = 0) UNION ALL VALUES ('missing_required_column', 'error'), ('invalid_record', 'error'), ('invalid_record', 'error')) GROUP BY 1, 2"))(lambda s, d: _filed(s, d)[1].groupBy("code", "severity").agg(F.count("*").alias("n")))
query("src_time_range", S.with_(T, then="SELECT ts_event, sequence, price_ticks FROM tape WHERE ts_event >= TIMESTAMP '2024-01-10 00:00:00' AND ts_event < TIMESTAMP '2024-01-12 00:00:00'"))(lambda s, d: tape_events(s, d).where("ts_event >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts_event < TIMESTAMP_NTZ '2024-01-12 00:00:00'").select("ts_event", "sequence", "price_ticks"))
query("src_outright_only", S.with_(T, then="SELECT sequence, symbol FROM book WHERE symbol NOT LIKE '%-%'"))(lambda s, d: market.outright(tape_book(s, d)).select("sequence", "symbol"))
_VOLUME = "fm AS (SELECT instrument_id, sum(greatest(coalesce(nullif(size, 0), 1), 1))::BIGINT AS volume FROM book WHERE symbol NOT LIKE '%-%' GROUP BY 1 ORDER BY volume DESC, instrument_id LIMIT 1)"
query("src_front_month_volume", S.with_(T, _VOLUME, then="SELECT instrument_id, volume FROM fm"))(lambda s, d: market.front_month_by_volume(tape_book(s, d)))
query("src_front_month_rows", S.with_(T, then="SELECT symbol, count(*) AS n FROM book WHERE symbol NOT LIKE '%-%' GROUP BY 1 ORDER BY n DESC, symbol LIMIT 1"))(lambda s, d: market.front_month_by_rows(tape_book(s, d)))
query("join_semi_front_month", S.with_(T, _VOLUME, then="SELECT sequence, b.instrument_id, size FROM book b SEMI JOIN fm USING (instrument_id)"))(lambda s, d: market.only_front_month(market.outright(tape_book(s, d))).select("sequence", "instrument_id", "size"))
_WINDOW = ("2024-01-09 23:00:00", "2024-01-10 23:00:00")
query("src_day_window_trades", S.with_(T, then=f"SELECT sequence, ts_event, price_ticks FROM book WHERE symbol = 'AAF4' AND upper(action) = 'T' AND ts_event >= TIMESTAMP '{_WINDOW[0]}' AND ts_event < TIMESTAMP '{_WINDOW[1]}'"))(lambda s, d: market.day_window(tape_book(s, d), "AAF4", *_WINDOW).select("sequence", "ts_event", "price_ticks"))
query("src_book_mid", S.with_(T, then="SELECT ts_event, sequence, (bid_px_00 + ask_px_00) / 2 AS mid, round_even((bid_px_00 + ask_px_00) / 2 / 0.125, 0)::BIGINT AS price_ticks FROM book WHERE bid_px_00 > 0 AND ask_px_00 > 0"))(lambda s, d: market.book_mid(tape_book(s, d)).select("ts_event", "sequence", "mid", "price_ticks"))
_DIRTY = "dirty AS (SELECT ts_event, sequence, CASE WHEN sequence % 103 = 0 THEN NULL WHEN sequence % 97 = 0 THEN price + 0.10 ELSE price END AS price, CASE WHEN sequence % 101 = 0 THEN 0 ELSE size END AS size, side FROM signed)"
_GRID = "price IS NOT NULL AND price::VARCHAR::DECIMAL(38,18) % 0.25 = 0"
query("norm_trades", S.with_(T, _DIRTY, then=f"SELECT ts_event, sequence, (price / 0.25)::BIGINT AS price_ticks, size, side FROM dirty WHERE {_GRID} AND size > 0"))(lambda s, d: market.normalize_trades(tape_dirty(s, d))[0])
query("norm_quotes", S.with_(T, then="SELECT * FROM quotes"))(lambda s, d: market.normalize_quotes(tape_book(s, d))[0])
query("norm_ts_kinds", S.with_(T, then="SELECT sequence, ts_event AS from_nanos, ts_event AS from_text, NULL::TIMESTAMP AS from_naive_text FROM tape"))(
    lambda s, d: tape_events(s, d).select("sequence", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts_event) * 1000 + 999").alias("ns"), F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t")).select("sequence", ticks.from_nanos(F.col("ns")).alias("from_nanos"), ticks.from_iso(F.concat("t", F.lit("+00:00"))).alias("from_text"), ticks.from_iso(F.col("t")).alias("from_naive_text"))
)
query("norm_price_grid", S.with_(T, _DIRTY, then=f"SELECT sequence, CASE WHEN {_GRID} THEN (price / 0.25)::BIGINT END AS price_ticks FROM dirty"))(lambda s, d: tape_dirty(s, d).select("sequence", ticks.exact_ticks(F.col("price")).alias("price_ticks")))
query("norm_price_rint", S.with_(T, then="SELECT sequence, round_even((price + 0.125) / 0.25, 0)::BIGINT AS price_ticks FROM signed"))(lambda s, d: tape_events(s, d).select("sequence", ticks.nearest_ticks(F.col("price") + 0.125).alias("price_ticks")))
_PROVIDED = """pt AS (SELECT *, sequence % 97 = 0 OR sequence % 83 = 0 OR (sequence % 2 = 1 AND sequence % 89 = 0) AS bad FROM tape),
pq AS (SELECT *, sequence % 97 = 0 OR sequence % 79 = 0 OR sequence % 73 = 0 AS bad FROM tape)"""
query("norm_provider_messages", S.with_(T, _PROVIDED, then="SELECT ts_event, 0::BIGINT AS sequence, 'trade' AS kind, price_ticks, size, side, NULL::BIGINT AS bid_ticks, NULL::BIGINT AS ask_ticks, NULL::BIGINT AS bid_size, NULL::BIGINT AS ask_size FROM pt WHERE NOT bad UNION ALL SELECT ts_event, 0, 'quote', NULL, NULL, NULL, price_ticks - 1, price_ticks + 2, size, 0 FROM pq WHERE NOT bad"))(lambda s, d: market.provider_events(tape_messages(s, d))[0])
query("dq_provider_errors", S.with_(T, _PROVIDED, then="SELECT 'provider_error' AS code, (SELECT count(*) FROM pt WHERE bad) + (SELECT count(*) FROM pq WHERE bad) AS n"))(lambda s, d: market.provider_events(tape_messages(s, d))[1].groupBy("code").agg(F.count("*").alias("n")))
_BADBOOK = "CASE WHEN sequence % 101 = 0 THEN 'invalid_timestamp' WHEN sequence % 89 = 0 THEN 'invalid_price' END"
query("dq_quote_warnings", S.with_(T, then=f"SELECT {_BADBOOK} AS code, 'warning' AS severity, count(*) AS n FROM tape WHERE sequence % 83 <> 0 AND {_BADBOOK} IS NOT NULL GROUP BY 1"))(lambda s, d: market.normalize_quotes(tape_dirty_book(s, d).where("ask_px_00 is not null"))[1].groupBy("code", "severity").agg(F.count("*").alias("n")))
query("dq_book_warnings", S.with_(T, then=f"SELECT ts_event, kind, code FROM (SELECT CASE WHEN sequence % 101 <> 0 THEN ts_event END AS ts_event, 'trade' AS kind, CASE WHEN sequence % 101 = 0 THEN 'invalid_timestamp' END AS code FROM book WHERE action = 'T' UNION ALL SELECT CASE WHEN sequence % 101 <> 0 THEN ts_event END, 'quote', {_BADBOOK} FROM book WHERE sequence % 83 <> 0) WHERE code IS NOT NULL"))(lambda s, d: market.book_events(tape_dirty_book(s, d))[1].select("ts_event", F.element_at(F.split("message", " "), 1).alias("kind"), "code"))
_TEXTS = "CASE sequence % 4 WHEN 0 THEN 'cannot open /data/feeds/' || sequence || '.parquet, retry' WHEN 1 THEN 'token = abc' || sequence || '; next' WHEN 2 THEN 'C:\\feeds\\day' || sequence || ' missing' ELSE 'row ' || sequence || ' has no password' END"
query("dq_redact_text", S.with_(T, then=f"SELECT sequence, regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '[A-Za-z]:\\\\[^\\s,;]+', '<path>', 'g'), '/(?:[^\\s,;]+/)+[^\\s,;]+', '<path>', 'g'), '(?i)(secret|token|password|api[_-]?key)\\s*[:=]\\s*[^\\s,;]+', '<redacted>', 'g'), '(?i)secret|token|password|api[_-]?key', '<redacted>', 'g') AS message FROM (SELECT sequence, {_TEXTS} AS m FROM tape)"))(lambda s, d: tape_events(s, d).select("sequence", ticks.redact(F.expr(_TEXTS.replace("\\", "\\\\"))).alias("message")))
_META = "CASE sequence % 3 WHEN 0 THEN 'path' WHEN 1 THEN 'api_key' ELSE 'note' END"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[A-Za-z]:\\\\[^\\s,;]+', '<path>', 'g'), '/(?:[^\\s,;]+/)+[^\\s,;]+', '<path>', 'g'), '(?i)(secret|token|password|api[_-]?key)\\s*[:=]\\s*[^\\s,;]+', '<redacted>', 'g'), '(?i)secret|token|password|api[_-]?key', '<redacted>', 'g')"
query("dq_redact_metadata", S.with_(T, then=f"SELECT sequence, CASE WHEN sequence % 3 = 1 THEN '<redacted_key>' ELSE {_META} END AS key, {_CLEAN.format('m')} AS value FROM (SELECT sequence, {_TEXTS} AS m FROM tape)"))(lambda s, d: tape_events(s, d).select("sequence", F.explode(ticks.redact_metadata(F.create_map(F.expr(_META), F.expr(_TEXTS.replace("\\", "\\\\")))))).select("sequence", "key", "value"))
_SOURCES = "CASE sequence % 3 WHEN 0 THEN 'feeds/day' || sequence || '.parquet' WHEN 1 THEN '/data/feeds/day' || sequence || '.parquet' ELSE 'feed' || sequence END"
query("dq_safe_source", S.with_(T, then="SELECT sequence, CASE sequence % 3 WHEN 0 THEN 'day' || sequence || '.parquet' WHEN 1 THEN '<path>' ELSE 'feed' || sequence END AS source FROM tape"))(lambda s, d: tape_events(s, d).select("sequence", ticks.safe_source(F.expr(_SOURCES)).alias("source")))
_LATE = "SELECT sequence, ts_event, was AS accepted_ts FROM (SELECT *, {0} OVER (ORDER BY arrival ROWS BETWEEN {1} PRECEDING AND 1 PRECEDING) AS was FROM arr2) WHERE ts_event < was"
_ARRIVAL = "arr AS (SELECT *, sequence + CASE WHEN sequence % 13 = 0 THEN 5 ELSE 0 END AS arrival FROM signed), arr2 AS (SELECT ts_event, sequence, price_ticks, side, row_number() OVER (ORDER BY arrival, sequence) - 1 AS arrival FROM arr)"
query("dq_warning_counts", S.with_(T, _DIRTY, _ARRIVAL, _PROVIDED, then=f"SELECT CASE WHEN NOT ({_GRID}) THEN 'invalid_price' ELSE 'invalid_record' END AS code, 'warning' AS severity, count(*) AS n FROM dirty WHERE NOT ({_GRID}) OR size <= 0 GROUP BY 1 UNION ALL SELECT 'timestamp_regression', 'warning', count(*) FROM ({_LATE.format('max(ts_event)', 'UNBOUNDED')}) UNION ALL SELECT 'provider_error', 'warning', (SELECT count(*) FROM pt WHERE bad) + (SELECT count(*) FROM pq WHERE bad)"))(
    lambda s, d: market.normalize_trades(tape_dirty(s, d))[1].unionByName(ordering.regression_notes(ordering.regressions(_arrivals(s, d), "arrival", 4096))).unionByName(market.provider_events(tape_messages(s, d))[1]).groupBy("code", "severity").agg(F.count("*").alias("n"))
)

# Order
query("ord_side_signed", S.with_(T, then="SELECT sequence, side_signed FROM signed"))(lambda s, d: tape_events(s, d).select("sequence", ticks.side_signed(F.col("price_ticks"), F.col("side")).alias("side_signed")))
# Trades that tie in instant and number: price, side and size decide.
_RANK = "row_number() OVER (ORDER BY ts_event, sequence, side_signed, size)::BIGINT"
query("ord_canonical_rank", S.with_(T, S.TIES, then=f"SELECT ts_event, sequence, side_signed, size, {_RANK} AS rank FROM ties"))(lambda s, d: ordering.canonical_rank(tape_ties(s, d)).select("ts_event", "sequence", ticks.side_signed(F.col("price_ticks"), F.col("side")).alias("side_signed"), "size", F.col("rank").cast("long").alias("rank")))
query("ord_sorted_tape", S.with_(T, then=f"SELECT ts_event, sequence, price_ticks, size, side, {_RANK} AS rank FROM signed"))(lambda s, d: ordering.canonical_rank(tape_events(s, d)).select("ts_event", "sequence", "price_ticks", "size", "side", F.col("rank").cast("long").alias("rank")))


# Arrival swaps neighbours, so some rows come late.
def _arrivals(s: SparkSession, d: str) -> DataFrame:
    late = tape_events(s, d).withColumn("arrival", F.col("sequence") + F.when(F.col("sequence") % 13 == 0, 5).otherwise(0))
    return ordering.rank_in_order(late, [F.col("arrival"), F.col("sequence")], F.floor(F.col("arrival") / 4096), "rank").withColumn("arrival", F.col("rank") - 1).drop("rank")


query("ord_ts_regressions", S.with_(T, _ARRIVAL, then=_LATE.format("max(ts_event)", "UNBOUNDED")))(lambda s, d: ordering.regressions(_arrivals(s, d), "arrival", 4096).select("sequence", "ts_event", "accepted_ts"))
query("ord_ts_regressions_processed", S.with_(T, _ARRIVAL, then=_LATE.format("max(ts_event)", "1")))(lambda s, d: ordering.regressions(_arrivals(s, d), "arrival", 4096, processed=True).select("sequence", "ts_event", "accepted_ts"))
query("ord_inversion_count", S.with_(T, _ARRIVAL, then="SELECT coalesce(sum((ts_event < was)::BIGINT), 0)::BIGINT AS inversions, count(*) AS n_rows FROM (SELECT *, lag(ts_event) OVER (ORDER BY arrival) AS was FROM arr2)"))(lambda s, d: ordering.inversions(_arrivals(s, d), "arrival", 4096))
query("ord_sweep_breakdown", S.with_(T, "st AS (SELECT date_trunc('hour', ts_event) AS h, sequence, price_ticks, side, price_ticks - lag(price_ticks) OVER (PARTITION BY date_trunc('hour', ts_event) ORDER BY sequence) AS dd FROM tape), g AS (SELECT h, count(DISTINCT price_ticks) AS n_prices, count(DISTINCT side) AS n_sides, min(dd) AS lo, max(dd) AS hi FROM st GROUP BY 1)", then="SELECT CASE WHEN lo >= 0 THEN 'ascending' WHEN hi <= 0 THEN 'descending' ELSE 'non_monotone' END AS shape, n_sides > 1 AS mixed_side, count(*) AS n FROM g WHERE n_prices > 1 GROUP BY 1, 2"))(lambda s, d: ordering.sweeps(tape_events(s, d).withColumn("h", F.date_trunc("hour", "ts_event")), ["h"], "sequence").groupBy("shape", "mixed_side").agg(F.count("*").alias("n")))
query("lim_first_n_events", S.with_(T, then="SELECT ts_event, sequence, price_ticks FROM signed ORDER BY ts_event, sequence, side_signed, size LIMIT 100"))(lambda s, d: tape_events(s, d).orderBy(*ordering.canonical_key()).limit(100).select("ts_event", "sequence", "price_ticks"))
query("topk_recent_bars", S.with_(T, B, then="SELECT bar_id, recency FROM (SELECT bar_id, row_number() OVER (ORDER BY trading_day DESC, bar_index DESC)::INTEGER AS recency FROM bars WHERE is_complete) WHERE recency <= 500"))(lambda s, d: bars.recent_bars(_bars(s, d), 500).select("bar_id", "recency"))

# Calendar
query("cal_local_ts", S.with_(T, then="SELECT sequence, local_ts FROM num"))(lambda s, d: with_session(tape_events(s, d), EASTERN).select("sequence", "local_ts"))
query("cal_trading_day", S.with_(T, then="SELECT sequence, trading_day FROM num"))(lambda s, d: with_session(tape_events(s, d), EASTERN).select("sequence", "trading_day"))
query("cal_classify_session", S.with_(T, then=f"SELECT sequence, session AS et_session, {S.session(S.local('ts_event', S.CT), 'CT')} AS ct_session FROM num"))(lambda s, d: tape_events(s, d).select("sequence", session_of(to_local(F.col("ts_event"), EASTERN), EASTERN).alias("et_session"), session_of(to_local(F.col("ts_event"), CENTRAL), CENTRAL).alias("ct_session")))
query("cal_closed_window_drop", S.with_(T, then=f"SELECT sequence, {S.day(S.local('ts_event', S.CT))} AS trading_day FROM tape WHERE {S.session(S.local('ts_event', S.CT), 'CT')} <> 'closed'"))(lambda s, d: with_session(tape_events(s, d), CENTRAL).where("trading_day is not null").select("sequence", "trading_day"))
query("cal_day_bounds", S.with_(T, then=f"SELECT DISTINCT trading_day, {S.utc(chr(40) + 'trading_day - 1 + TIME ' + chr(39) + '18:00:00' + chr(39) + chr(41))} AS start_ts, {S.utc(chr(40) + 'trading_day + TIME ' + chr(39) + '18:00:00' + chr(39) + chr(41))} AS end_ts FROM num"))(lambda s, d: with_session(tape_events(s, d), EASTERN).select("trading_day").distinct().select("trading_day", *[c.alias(n) for c, n in zip(day_bounds(F.col("trading_day"), EASTERN), ("start_ts", "end_ts"), strict=True)]))
query("cal_session_summary", S.with_(T, then="SELECT trading_day, session, count(*) AS n, sum(size)::BIGINT AS volume, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks FROM num GROUP BY 1, 2"))(lambda s, d: with_session(tape_events(s, d), EASTERN).groupBy("trading_day", "session").agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.max("price_ticks").alias("high_ticks"), F.min("price_ticks").alias("low_ticks")))
query("cal_missing_days", S.with_(T, then="SELECT x::DATE AS trading_day FROM range(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-11', INTERVAL 1 DAY) t(x) ANTI JOIN num ON num.trading_day = x::DATE"))(lambda s, d: diff.missing_days(with_session(tape_events(s, d), EASTERN), "2023-12-25", "2024-02-10"))

# Bars
for _n in (1, 7, 147):
    query(f"bars_tick_{_n}", S.with_(T, S.bars(_n), then=f"SELECT {S.BAR_COLUMNS} FROM bars"))(lambda s, d, n=_n: _bars(s, d, n))
query("bars_multi_timeframe", S.with_(T, S.bars(7, "b1"), S.bars(21, "b2"), S.bars(147, "b3"), then=" UNION ALL ".join(f"SELECT {S.BAR_COLUMNS} FROM b{i}" for i in (1, 2, 3))))(lambda s, d: _bars(s, d, (147, 7, 21, 7)))
query("bars_partials_only", S.with_(T, B, then="SELECT bar_id, trade_count, close_reason FROM bars WHERE is_partial"))(lambda s, d: _bars(s, d).where("is_partial").select("bar_id", "trade_count", "close_reason"))
_SOME = (7, 11, 13, 147)
query("bars_current_snapshot", S.with_(T, *[S.bars(n, f"f{n}") for n in _SOME], then=" UNION ALL ".join(f"SELECT bar_id, trade_count, NULL::VARCHAR AS close_reason FROM f{n} WHERE NOT is_complete AND trading_day = (SELECT max(trading_day) FROM f{n})" for n in _SOME)))(lambda s, d: bars.current_bars(_bars(s, d, _SOME)).select("bar_id", "trade_count", "close_reason"))
query("bars_ties", S.with_(T, S.TIES, S.bars(7, source="numt"), then=f"SELECT {S.BAR_COLUMNS} FROM bars"))(lambda s, d: bars.tick_bars(tape_ties(s, d), N, EASTERN))
query("bars_lineitem_147", S.with_(S.TAPE_LINEITEM, S.bars(147), then=f"SELECT {S.BAR_COLUMNS} FROM bars"))(lambda s, d: bars.tick_bars(tape_lineitem(s, d), 147, EASTERN))
_CONT = "crn AS (SELECT *, row_number() OVER (ORDER BY ts_event, sequence, side_signed, size) - 1 AS g FROM signed), cont AS (SELECT g // 7 AS bar_index, min(ts_event) AS open_ts, max(ts_event) AS close_ts, min_by(price_ticks, g) AS open_ticks, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks, max_by(price_ticks, g) AS close_ticks, sum(size)::BIGINT AS volume, count(*)::BIGINT AS trade_count FROM crn GROUP BY 1 HAVING count(*) = 7)"
query("bars_continuous", S.with_(T, _CONT, then="SELECT * FROM cont"))(lambda s, d: bars.continuous_bars(tape_events(s, d), N))
query("bars_book_mid", S.with_(T, f"mid AS (SELECT ts_event, sequence, round_even((bid_px_00 + ask_px_00) / 2 / 0.125, 0)::BIGINT AS price_ticks, size, side FROM book), midn AS (SELECT *, {S.day(S.local('ts_event'))} AS trading_day, row_number() OVER (PARTITION BY {S.day(S.local('ts_event'))} ORDER BY ts_event, sequence, CASE WHEN side = 'B' THEN price_ticks ELSE -price_ticks END, size) - 1 AS rn FROM mid)", S.bars(7, source="midn"), then="SELECT bar_id, open_ticks, high_ticks, low_ticks, close_ticks, volume FROM bars"))(lambda s, d: bars.tick_bars(market.book_mid(tape_book(s, d)), N, EASTERN).select("bar_id", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume"))
query("bars_points", S.with_(T, B, then="SELECT bar_id, open_ticks * 0.25::DOUBLE AS open, high_ticks * 0.25::DOUBLE AS high, low_ticks * 0.25::DOUBLE AS low, close_ticks * 0.25::DOUBLE AS close FROM bars"))(lambda s, d: bars.in_points(_bars(s, d)))
_BY_PRICE = "byp AS (SELECT *, row_number() OVER (PARTITION BY trading_day ORDER BY date_trunc('hour', ts_event), price_ticks, sequence) - 1 AS rp FROM num)"
query("bars_price_asc_order", S.with_(T, _BY_PRICE, S.bars(7, source="byp", rn="rp"), then="SELECT bar_id, open_ticks, high_ticks, low_ticks, close_ticks FROM bars"))(lambda s, d: bars.tick_bars(tape_events(s, d), N, EASTERN, [F.date_trunc("hour", "ts_event"), F.col("price_ticks"), F.col("sequence")]).select("bar_id", "open_ticks", "high_ticks", "low_ticks", "close_ticks"))
query("bars_first_of_day_recompute", S.with_(T, then="SELECT trading_day, min_by(price_ticks, rn) AS open_ticks, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks, max_by(price_ticks, rn) AS close_ticks, count(*) AS trade_count FROM num WHERE rn < 7 GROUP BY 1"))(lambda s, d: _bars(s, d).where("bar_index = 0").select("trading_day", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "trade_count"))
query("runtime_snapshot", S.with_(T, B, then="SELECT (SELECT count(*) FROM bars WHERE is_complete) AS complete_bars, (SELECT count(*) FROM bars WHERE NOT is_complete AND trading_day = (SELECT max(trading_day) FROM bars)) AS forming_bars, (SELECT max(trading_day) FROM bars) AS trading_day, (SELECT max_by(bid_ticks, (ts_event, sequence)) FROM quotes) AS bid_ticks, (SELECT max_by(ask_ticks, (ts_event, sequence)) FROM quotes) AS ask_ticks"))(
    lambda s, d: _bars(s, d).withColumn("_last", F.lit(1)).groupBy("_last").agg(F.count(F.when(F.col("is_complete"), 1)).alias("complete_bars"), F.max("trading_day").alias("trading_day"), F.max(F.struct("trading_day", "bar_index", (~F.col("is_complete")).cast("long").alias("open"))).alias("m")).join(_quotes(s, d).groupBy(F.lit(1).alias("_last")).agg(F.max(F.struct("ts_event", "sequence", "bid_ticks", "ask_ticks")).alias("q")), "_last").select("complete_bars", F.col("m.open").alias("forming_bars"), "trading_day", F.col("q.bid_ticks").alias("bid_ticks"), F.col("q.ask_ticks").alias("ask_ticks"))
)
_SINK = ("trading_day", "bar_index", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "close_reason")


def _through_sink(s: SparkSession, d: str) -> DataFrame:
    """Bars written as JSON lines and read back as they stand in the files."""
    b = _bars(s, d).select("bar_id", *_SINK)
    return sinks.read_json_lines(s, sinks.write_json_lines(b, sinks.scratch(s, "bars")), b.schema)


query("sink_bars_json", S.with_(T, B, then=f"SELECT bar_id, {', '.join(_SINK)} FROM bars"))(_through_sink)

# Streams, run to their end over the same tape; timers close the last days
_STATIC = (("mid", 17075.0, "LOW"), ("top", 17225.0, "HIGH"))
_STATIC_SQL = "levels AS (SELECT DISTINCT trading_day, name, price::DOUBLE AS price, side, NULL::TIMESTAMP AS available_from, ordinal::INTEGER AS ordinal FROM bars, (VALUES ('mid', 17075.0, 'LOW', 0), ('top', 17225.0, 'HIGH', 1)) v(name, price, side, ordinal))"


def _streamed(s: SparkSession, d: str, tape: DataFrame | None = None, **settings) -> DataFrame:
    tape = tape_events(s, d).withColumn("symbol", F.lit("AA")) if tape is None else tape
    return runs.run_to_end(tape.drop("price"), **settings)


query("stream_bars", S.with_(T, S.bars(7, "b1"), S.bars(147, "b2"), then=" UNION ALL ".join(f"SELECT timeframe_ticks, trading_day, bar_index, open_ticks, high_ticks, low_ticks, close_ticks, volume, trade_count, close_reason FROM b{i}" for i in (1, 2))))(
    lambda s, d: _streamed(s, d, sizes=(7, 147), own_levels=False).where("kind = 'bar'").select("timeframe_ticks", "trading_day", "bar_index", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count", "close_reason")
)
query("stream_touches", S.with_(T, B, _STATIC_SQL, Z, H, then="SELECT trading_day, bar_index, bar_ts, representative_price, direction, level_type FROM touches"))(
    lambda s, d: _streamed(s, d, sizes=(7,), static_levels=_STATIC, own_levels=False).where("kind = 'touch'").select("trading_day", "bar_index", F.col("ts").alias("bar_ts"), "representative_price", "direction", "level_type")
)

# Levels and zones
query("lvl_full_day_hl", S.with_(T, B, L, then="SELECT * FROM days"))(lambda s, d: levels.full_day(_bars(s, d)))
query("lvl_pdh_pdl", S.with_(T, B, L, then="SELECT * FROM prior"))(lambda s, d: levels.prior_day(levels.full_day(_bars(s, d))))
query("lvl_session_hl", S.with_(T, B, L, then="SELECT * FROM sess"))(lambda s, d: levels.session_extremes(_bars(s, d), EASTERN))
query("lvl_session_hl_trades", S.with_(T, then="SELECT trading_day, session, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks FROM num GROUP BY 1, 2"))(lambda s, d: levels.session_extremes_of_trades(tape_events(s, d), EASTERN))
query("lvl_level_set", S.with_(T, B, L, then="SELECT * FROM levels"))(lambda s, d: levels.level_set(_bars(s, d), EASTERN))
_FIXED = "fixed AS (SELECT trading_day, 'weekly' AS name, 17100.0::DOUBLE AS price, 'HIGH' AS side, NULL::TIMESTAMP AS available_from, -1::INTEGER AS ordinal FROM days)"


def _with_static(s: SparkSession, d: str) -> DataFrame:
    b = _bars(s, d)
    fixed = levels.full_day(b).select("trading_day", F.lit("weekly").alias("name"), F.lit(17100.0).alias("price"), F.lit("HIGH").alias("side"), F.lit(None).cast("timestamp_ntz").alias("available_from"), F.lit(-1).alias("ordinal"))
    return levels.level_set(b, EASTERN, static=fixed)


query("lvl_static_levels", S.with_(T, B, L, _FIXED, then="SELECT * FROM levels UNION ALL SELECT * FROM fixed"))(_with_static)
_ZONES = "SELECT trading_day, zone_id, representative_price, array_to_string(names, ',') AS names, side, available_from, n_levels FROM zones"
query("zone_build", S.with_(T, B, L, Z, then=_ZONES))(lambda s, d: _flat(_chain(s, d)[1].zones))
query("zone_build_wide", S.with_(T, B, L, S.zones(12.0), then=_ZONES))(lambda s, d: _flat(zones.merge_levels(_chain(s, d)[1].levels, 12.0)))

# Touches
query("touch_all_intersections", S.with_(*TO_TOUCH, then="SELECT trading_day, zone_id, bar_index FROM hits"))(lambda s, d: (lambda c: touches.intersections(c.bars, c.zones).select("trading_day", "zone_id", "bar_index"))(_chain(s, d)[1]))
query("touch_first", S.with_(*TO_TOUCH, then="SELECT * FROM touches"))(lambda s, d: _chain(s, d)[1].touches)
query("touch_first_ungated", S.with_(T, B, L, Z, S.touches(False), then="SELECT * FROM touches"))(lambda s, d: (lambda c: touches.first_touches(c.bars, c.zones, gated=False))(_chain(s, d)[1]))
query("touch_ny_eligible", S.with_(*TO_TOUCH, then=f"SELECT trading_day, zone_id, bar_ts FROM touches WHERE {S.session(S.local('bar_ts'))} = 'ny'"))(lambda s, d: touches.in_session(_chain(s, d)[1].touches, EASTERN).select("trading_day", "zone_id", "bar_ts"))
query("join_anti_untouched_zones", S.with_(*TO_TOUCH, then="SELECT trading_day, zone_id, side FROM zones ANTI JOIN touches USING (trading_day, zone_id)"))(lambda s, d: (lambda c: touches.untouched(c.zones, c.touches).select("trading_day", "zone_id", "side"))(_chain(s, d)[1]))

# Zones as known at each bar's close, from the levels of the day so far
_RUNTIME = "SELECT trading_day, bar_index, bar_ts, representative_price, direction, level_type, array_to_string(names, ',') AS names FROM rt"


def _runtime(trades: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _flat(evolving.runtime_touches(trades, N, EASTERN, by=by)).select(*by, "trading_day", "bar_index", "bar_ts", "representative_price", "direction", "level_type", "names")


query("touch_runtime", S.with_(T, B, L, S.RUNTIME_TOUCHES, then=_RUNTIME))(lambda s, d: _runtime(tape_events(s, d)))
query("zone_runtime", S.with_(T, B, L, S.RUNTIME_TOUCHES, then="SELECT trading_day, bar_index, representative_price, array_to_string(names, ',') AS names, side, available_from FROM rt_zones"))(lambda s, d: _flat(evolving.zones_at_close(evolving.levels_at_close(evolving.bars_with_ranges(tape_events(s, d), N, EASTERN), EASTERN))).select("trading_day", "bar_index", "representative_price", "names", "side", "available_from"))

# Features
W = FeatureWindows()
_FEATS = {"feat_time_beyond": "int_time_beyond_level", "feat_time_within": "int_time_within_2pts", "feat_absorption": "int_absorption_ratio", "feat_large_vol_pct": "app_large_trade_vol_pct", "feat_avg_size": "app_avg_trade_size", "feat_max_spread": "app_max_spread"}


def _features(s: SparkSession, d: str) -> DataFrame:
    t, c = _chain(s, d)
    return features.touch_features(c.touches, t, _quotes(s, d), W)


def _feature(name: str, column: str):
    part = {"feat_time_beyond": features.dwell, "feat_time_within": features.dwell, "feat_absorption": features.absorption, "feat_large_vol_pct": features.approach, "feat_avg_size": features.approach, "feat_max_spread": features.spread}[name]

    def run(s: SparkSession, d: str) -> DataFrame:
        t, c = _chain(s, d)
        return part(c.touches, _quotes(s, d) if name == "feat_max_spread" else t, W).select("trading_day", "zone_id", column)

    source = {"feat_time_beyond": "f_inter", "feat_time_within": "f_inter", "feat_absorption": "f_inter", "feat_large_vol_pct": "f_appr", "feat_avg_size": "f_appr", "feat_max_spread": "f_spread"}[name]
    expr = "CASE WHEN at_level + past > 0 THEN round(at_level / (at_level + past), 6) ELSE 0.0 END::DOUBLE AS int_absorption_ratio" if name == "feat_absorption" else column
    query(name, S.with_(*TO_TOUCH, S.FEATURES, then=f"SELECT trading_day, zone_id, {expr} FROM {source}"))(run)


for _name, _column in _FEATS.items():
    _feature(_name, _column)
query("feat_least_trades", S.with_(*TO_TOUCH, S.FEATURES, "many AS (SELECT trading_day, zone_id FROM inter GROUP BY 1, 2 HAVING count(*) >= 2)", then="SELECT * FROM feats JOIN many USING (trading_day, zone_id)"))(lambda s, d: (lambda c: features.touch_features(c[1].touches, c[0], _quotes(s, d), W, least_trades=2))(_chain(s, d)))
query("feat_vector", S.with_(*TO_TOUCH, S.FEATURES, then="SELECT * FROM feats"))(_features)

# Outcomes
P = LabelPolicy()
# A long entry at the open of each bar, held through the bar.
_HELD = "SELECT bar_id, (high_ticks - open_ticks) * 0.25::DOUBLE AS mfe, (open_ticks - low_ticks) * 0.25::DOUBLE AS mae FROM bars"


def _held(s: SparkSession, d: str) -> DataFrame:
    held = _bars(s, d, 147).select("bar_id", ((F.col("high_ticks") - F.col("open_ticks")) * 0.25).alias("mfe"), ((F.col("open_ticks") - F.col("low_ticks")) * 0.25).alias("mae"))
    return held.select("*", outcomes.ladder(F.col("mfe"), F.col("mae"), P).alias("label"), outcomes.ladder(F.col("mfe"), F.col("mae"), LabelPolicy(forced=True)).alias("label_forced"))


query("out_classify_kernel", S.with_(T, S.bars(147), then=f"SELECT *, {S.ladder('mfe', 'mae')} AS label, {S.ladder('mfe', 'mae', forced=True)} AS label_forced FROM ({_HELD})"))(_held)


def _level_entries(c: dataset.Chain) -> DataFrame:
    from ..functions.calendar import instant_on

    return c.touches.select("trading_day", "zone_id", "direction", F.col("representative_price").alias("entry_price"), F.col("bar_ts").alias("after_ts"), instant_on(F.col("trading_day"), P.cutoff, EASTERN).alias("before_ts"))


_LEVEL_ENTRIES = "le AS (SELECT trading_day, zone_id, direction, representative_price AS entry_price, bar_ts AS after_ts, " + S.utc("(trading_day + TIME '17:00:00')") + " AS before_ts FROM touches)"
query("out_resolve_level_entry", S.with_(*TO_TOUCH, _LEVEL_ENTRIES, S.resolve("le"), then="SELECT * FROM resolved"))(lambda s, d: (lambda c: outcomes.resolve(_level_entries(c), c.bars, P, "after_ts", "before_ts"))(_chain(s, d)[1]))
query("out_resolve_forced", S.with_(*TO_TOUCH, _LEVEL_ENTRIES, S.resolve("le", trap=2.0, forced=True), then="SELECT * FROM resolved"))(lambda s, d: (lambda c: outcomes.resolve(_level_entries(c), c.bars, LabelPolicy(trap_min=2.0, forced=True), "after_ts", "before_ts"))(_chain(s, d)[1]))


def _honest(s: SparkSession, d: str) -> DataFrame:
    t, c = _chain(s, d)
    return outcomes.decision_outcomes(c.touches, c.bars, t, P, EASTERN)


query("out_honest", S.with_(*TO_TOUCH, S.DECISIONS, then="SELECT * FROM honest"))(_honest)
# A narrow fill window and an early cutoff, so that every reason occurs.
_TIGHT = LabelPolicy(fill_tolerance_min=4, cutoff=time(13), flatten=time(14))


def _tight(s: SparkSession, d: str) -> DataFrame:
    t, c = _chain(s, d)
    return outcomes.decision_outcomes(c.touches, c.bars, t, _TIGHT, EASTERN)


_TIGHT_SQL = S.decisions(4, "13:00:00", 50400)
query("out_honest_tight", S.with_(*TO_TOUCH, _TIGHT_SQL, then="SELECT * FROM honest"))(_tight)
query("out_drop_counts_tight", S.with_(*TO_TOUCH, _TIGHT_SQL, then="SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM honest GROUP BY 1"))(lambda s, d: _tight(s, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))
query("out_drop_counts", S.with_(*TO_TOUCH, S.DECISIONS, then="SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM honest GROUP BY 1"))(lambda s, d: _honest(s, d).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))
query("out_class_balance", S.with_(*TO_TOUCH, S.DECISIONS, then="SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM honest WHERE label IS NOT NULL GROUP BY 1"))(lambda s, d: dataset.class_balance(_honest(s, d)))
_ROWS = "SELECT t.trading_day, t.zone_id, bar_ts, representative_price, direction, level_type, entry_price, label, label_encoded, max_mfe, max_mae, bars_to_resolution, int_time_beyond_level, int_time_within_2pts, int_absorption_ratio, app_large_trade_vol_pct, app_avg_trade_size, app_max_spread FROM touches t JOIN honest USING (trading_day, zone_id) JOIN feats USING (trading_day, zone_id) WHERE drop_reason IS NULL AND label_encoded IS NOT NULL"
query("dataset_training", S.with_(*TO_TOUCH, S.DECISIONS, S.FEATURES, then=_ROWS))(lambda s, d: dataset.training_rows(tape_events(s, d), _quotes(s, d), N))
# A confidence made up from the row stands for a model's; the gate itself is what is shown.
query("gate_eligible", S.with_(*TO_TOUCH, S.DECISIONS, then=f"SELECT trading_day, zone_id, confidence FROM (SELECT h.trading_day, zone_id, label, {S.session(S.local('bar_ts'))} AS session, (60 + (bar_index * 7) % 40) / 100.0::DOUBLE AS confidence FROM honest h JOIN touches USING (trading_day, zone_id)) WHERE label = 'tradeable_reversal' AND session = 'ny' AND confidence >= 0.70"))(
    lambda s, d: (lambda c: dataset.gate(outcomes.decision_outcomes(c[1].touches, c[1].bars, c[0], P, EASTERN).join(c[1].touches.select("trading_day", "zone_id", "bar_index", "bar_ts"), ["trading_day", "zone_id"]).select("trading_day", "zone_id", "label", session_of(to_local(F.col("bar_ts"), EASTERN), EASTERN).alias("session"), ((60 + (F.col("bar_index") * 7) % 40) / 100.0).alias("confidence")), EngineConfig()).select("trading_day", "zone_id", "confidence"))(_chain(s, d))
)

# Joins
query("asof_trade_price", S.with_(*TO_TOUCH, "ap AS (SELECT t.trading_day, zone_id, max_by(price_ticks, (x.ts_event, x.sequence)) * 0.25::DOUBLE AS entry_price FROM touches t JOIN signed x ON x.ts_event <= bar_ts AND x.ts_event >= bar_ts - INTERVAL 30 MINUTE GROUP BY 1, 2)", then="SELECT * FROM ap"))(lambda s, d: (lambda c: outcomes.asof_price(c[1].touches, c[0], "bar_ts", 30))(_chain(s, d)))
query("join_asof_entry_price", S.with_(*TO_TOUCH, S.DECISIONS, then="SELECT * FROM fills"))(lambda s, d: _honest(s, d).where("entry_price is not null").select("trading_day", "zone_id", "entry_price"))
query("join_touch_trades_window", S.with_(*TO_TOUCH, then="SELECT t.trading_day, zone_id, x.sequence, x.price_ticks FROM touches t JOIN signed x ON x.ts_event >= bar_ts - INTERVAL 90 MINUTE AND x.ts_event < bar_ts + INTERVAL 5 MINUTE"))(lambda s, d: (lambda c: features.window_join(c[1].touches, c[0], 90, 5).select("trading_day", "zone_id", "sequence", "price_ticks"))(_chain(s, d)))
query("join_forward_bars", S.with_(*TO_TOUCH, S.DECISIONS, then="SELECT e.trading_day, zone_id, bar_index FROM early e JOIN bars b ON b.trading_day = e.trading_day AND close_ts > decision_ts AND close_ts < cutoff_ts"))(
    lambda s, d: (lambda c: (lambda e: e.join(c.bars.select("trading_day", "bar_index", "close_ts"), "trading_day").where((F.col("close_ts") > F.col("after_ts") + F.expr("INTERVAL 5 MINUTE")) & (F.col("close_ts") < F.col("before_ts"))).select("trading_day", "zone_id", "bar_index"))(_level_entries(c)))(_chain(s, d)[1])
)

# Sets and differences
_DAY = "ts_event >= TIMESTAMP{1} '2024-01-{0} 00:00:00' AND ts_event < TIMESTAMP{1} '2024-01-{0} 23:59:59'"
query("set_union_days", S.with_(T, then=f"SELECT sequence, price_ticks FROM tape WHERE {_DAY.format('09', '')} UNION ALL SELECT sequence, price_ticks FROM tape WHERE {_DAY.format('10', '')}"))(lambda s, d: (lambda t: t.where(_DAY.format("09", "_NTZ")).unionByName(t.where(_DAY.format("10", "_NTZ")), allowMissingColumns=True).select("sequence", "price_ticks"))(tape_events(s, d)))
_UNGATED = S.touches(False, "ungated", "hits2")
query("set_touch_intersect", S.with_(*TO_TOUCH, _UNGATED, then="SELECT trading_day, zone_id, bar_index FROM touches INTERSECT SELECT trading_day, zone_id, bar_index FROM ungated"))(lambda s, d: (lambda c: c.touches.select("trading_day", "zone_id", "bar_index").intersect(touches.first_touches(c.bars, c.zones, gated=False).select("trading_day", "zone_id", "bar_index")))(_chain(s, d)[1]))
query("set_touch_except", S.with_(*TO_TOUCH, _UNGATED, then="SELECT trading_day, zone_id, bar_index FROM ungated EXCEPT ALL SELECT trading_day, zone_id, bar_index FROM touches"))(lambda s, d: (lambda c: touches.first_touches(c.bars, c.zones, gated=False).select("trading_day", "zone_id", "bar_index").exceptAll(c.touches.select("trading_day", "zone_id", "bar_index")))(_chain(s, d)[1]))
_BARS2 = S.bars(7, "bars2", "byp", "rp")


def _two_orders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tape_events(s, d)
    return bars.tick_bars(t, N, EASTERN), bars.tick_bars(t, N, EASTERN, [F.date_trunc("hour", "ts_event"), F.col("price_ticks"), F.col("sequence")])


_FIELDS = ("open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume")
_DIFFS = "nullif(concat_ws(',', " + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in _FIELDS) + "), '')"
query("diff_bars", S.with_(T, B, _BY_PRICE, _BARS2, then=f"SELECT coalesce(a.trading_day, b.trading_day) AS trading_day, coalesce(a.bar_index, b.bar_index) AS bar_index, CASE WHEN b.bar_id IS NULL THEN 'left_only' WHEN a.bar_id IS NULL THEN 'right_only' WHEN {_DIFFS} IS NOT NULL THEN 'differs' ELSE 'same' END AS status, CASE WHEN a.bar_id IS NOT NULL AND b.bar_id IS NOT NULL THEN {_DIFFS} END AS fields FROM bars a FULL JOIN bars2 b ON a.trading_day = b.trading_day AND a.bar_index = b.bar_index"))(lambda s, d: diff.diff_by_key(*_two_orders(s, d), ["trading_day", "bar_index"], list(_FIELDS)))
query("diff_touches", S.with_(*TO_TOUCH, _UNGATED, then="SELECT coalesce(a.trading_day, b.trading_day) AS trading_day, coalesce(a.zone_id, b.zone_id) AS zone_id, CASE WHEN b.zone_id IS NULL THEN 'left_only' WHEN a.zone_id IS NULL THEN 'right_only' WHEN a.bar_index <> b.bar_index THEN 'differs' ELSE 'same' END AS status, CASE WHEN a.bar_index <> b.bar_index THEN 'bar_index' END AS fields FROM touches a FULL JOIN ungated b ON a.trading_day = b.trading_day AND a.zone_id = b.zone_id"))(lambda s, d: (lambda c: diff.diff_by_key(c.touches, touches.first_touches(c.bars, c.zones, gated=False), ["trading_day", "zone_id"], ["bar_index"]))(_chain(s, d)[1]))
query("agg_divergence_percentiles", S.with_(T, B, _BY_PRICE, _BARS2, "dv AS (SELECT abs(a.open_ticks - b.open_ticks) AS v FROM bars a JOIN bars2 b USING (trading_day, bar_index))", then="SELECT count(v) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5)::DOUBLE AS median, quantile_cont(v, 0.95)::DOUBLE AS p95, max(v) AS max FROM dv"))(
    lambda s, d: (lambda a, b: diff.divergence(a.join(b.select("trading_day", "bar_index", F.col("open_ticks").alias("o2")), ["trading_day", "bar_index"]).withColumn("v", F.abs(F.col("open_ticks") - F.col("o2"))), "v"))(*_two_orders(s, d))
)
query("diff_even_sample", S.with_(*TO_TOUCH, "sm AS (SELECT trading_day, zone_id, row_number() OVER (ORDER BY trading_day, zone_id) - 1 AS r, count(*) OVER () AS n FROM touches)", then="SELECT trading_day, zone_id FROM sm WHERE n <= 20 OR r = 0 OR (r * 20) // n <> ((r - 1) * 20) // n"))(lambda s, d: diff.even_sample(_chain(s, d)[1].touches.select("trading_day", "zone_id"), ["trading_day", "zone_id"], 20))
query("diff_bars_continuous", S.with_(T, B, _CONT, "p AS (SELECT open_ts, close_ts, volume FROM bars WHERE is_complete)", then="SELECT (SELECT count(*) FROM p) AS n_days, (SELECT count(*) FROM cont) AS n_continuous, (SELECT count(*) FROM p JOIN cont USING (open_ts, close_ts, volume)) AS n_same"))(
    lambda s, d: (lambda p, c: p.agg(F.count("*").alias("n_days")).join(c.agg(F.count("*").alias("n_continuous")), F.lit(True)).join(p.join(c, ["open_ts", "close_ts", "volume"]).agg(F.count("*").alias("n_same")), F.lit(True)))(_bars(s, d).where("is_complete").select("open_ts", "close_ts", "volume"), bars.continuous_bars(tape_events(s, d), N).select("open_ts", "close_ts", "volume"))
)

# Two runs of the chain that differ in the order of trades within an hour, compared stage by stage and day by day
_RUN = (T, B, L, Z, H, S.DECISIONS, S.FEATURES)
_OTHER = (T, _BY_PRICE, S.bars(7, "bars", "byp", "rp"), L, Z, H, S.DECISIONS, S.FEATURES)
_FEATURES = (*features.ZERO, *features.NULL)
_STAGES = (
    ("bars", "bars", ("trading_day", "bar_index"), dict.fromkeys(("open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count")), True),
    ("levels", "levels", ("trading_day", "name"), {"price": 1e-9, "side": None, "available_from": None}, True),
    ("zones", "zones", ("trading_day", "zone_id"), {"representative_price": 1e-9, "side": None, "names": None, "n_levels": None}, True),
    ("touches", "touches", ("trading_day", "zone_id"), {"bar_ts": None, "direction": None, "representative_price": 1e-9, "level_type": None}, True),
    ("labels", "judged", ("trading_day", "zone_id"), {"label": None, "label_encoded": None, "max_mfe": 1e-9, "max_mae": 1e-9, "drop_reason": None}, True),
    ("interaction", "judged", ("trading_day", "zone_id"), dict.fromkeys(features.ZERO, 1e-9), False),
    ("approach", "judged", ("trading_day", "zone_id"), dict.fromkeys(features.NULL, 1e-6), False),
)
_JUDGED = f"SELECT t.*, {S.session(S.local('bar_ts'))} AS session, h.* EXCLUDE (trading_day, zone_id), f.* EXCLUDE (trading_day, zone_id) FROM touches t JOIN honest h USING (trading_day, zone_id) JOIN feats f USING (trading_day, zone_id)"
_SIDES = ", ".join(f"{side}_{name} AS ({S.with_(*parts, then=then)})" for side, parts in (("l", _RUN), ("r", _OTHER)) for name, then in (("bars", "SELECT * FROM bars"), ("levels", "SELECT * FROM levels"), ("zones", "SELECT * FROM zones"), ("touches", "SELECT * FROM touches"), ("judged", _JUDGED)))


def _two_runs(s: SparkSession, d: str) -> tuple[diff.Run, diff.Run]:
    """Both runs; their bars are written once, and all that follows is made from that table."""
    t, out = tape_events(s, d), []
    for name, b in zip(("left", "right"), _two_orders(s, d), strict=True):
        place = sinks.scratch(s, f"bars-{name}")
        b.write.parquet(place)
        c = dataset.chain_of_bars(s.read.parquet(place))
        out.append(diff.Run(c.bars, c.levels, c.zones, dataset.judged_touches(c, t, _quotes(s, d))))
    return out[0], out[1]


def _stage_sql(name: str, table: str, keys: tuple[str, ...], fields: dict[str, float | None], must_match: bool) -> str:
    differ = " OR ".join(f"a.{f} IS DISTINCT FROM b.{f}" if eps is None else f"((a.{f} IS NULL) <> (b.{f} IS NULL) OR abs(a.{f} - b.{f}) > {eps})" for f, eps in fields.items())
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    alone = f"(a.{keys[0]} IS NULL OR b.{keys[0]} IS NULL)"
    bad = f"({alone} OR coalesce({differ}, false))"
    both = ", ".join(f"coalesce(a.{k}, b.{k})" for k in keys)
    text = " || '/' || ".join(f"coalesce(a.{k}, b.{k})::VARCHAR" for k in keys)
    return f"SELECT '{name}' AS stage, '{'must_match' if must_match else 'expected_differ'}' AS scope, count(*) AS total, count(*) FILTER (NOT {bad}) AS matched, count(*) FILTER ({bad}) AS mismatched, count(*) FILTER ({alone}) AS one_sided, min_by({text}, ({both})) FILTER ({bad}) AS first_key, {'count(*) FILTER (' + bad + ') = 0' if must_match else 'true'} AS passed FROM l_{table} a FULL JOIN r_{table} b ON {on}"


def _stage_tally(s: SparkSession, d: str) -> DataFrame:
    a, b = _two_runs(s, d)
    table = {"bars": (a.bars, b.bars), "levels": (a.levels, b.levels), "zones": (a.zones, b.zones), "touches": (a.touches, b.touches), "judged": (a.touches, b.touches)}
    return diff.tally([diff.Stage(name, *table[of], keys, fields, must) for name, of, keys, fields, must in _STAGES])


query("diff_stage_tally", "WITH " + _SIDES + "\n" + "\nUNION ALL ".join(_stage_sql(*x) for x in _STAGES))(_stage_tally)
query("diff_first", S.with_(T, B, _BY_PRICE, _BARS2, then=" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, min_by(trading_day, (trading_day, bar_index)) AS trading_day, min_by(bar_index, (trading_day, bar_index)) AS bar_index, min_by(a.{f}, (trading_day, bar_index))::VARCHAR AS \"left\", min_by(b.{f}, (trading_day, bar_index))::VARCHAR AS \"right\" FROM bars a JOIN bars2 b USING (trading_day, bar_index) WHERE a.{f} IS DISTINCT FROM b.{f} HAVING count(*) > 0" for f in _FIELDS)))(
    lambda s, d: diff.first_differences(*_two_orders(s, d), ["trading_day", "bar_index"], dict.fromkeys(_FIELDS))
)


def _set_sql(name: str, table: str, item: str) -> str:
    return f"""{name}_i AS (SELECT trading_day, {item} AS item, max(l) AS l, max(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM l_{table} UNION ALL BY NAME SELECT *, 0 AS l, 1 AS r FROM r_{table}) GROUP BY 1, 2),
{name}_s AS (SELECT trading_day, sum(l)::BIGINT AS {name}_left, sum(r)::BIGINT AS {name}_right, sum(l * r)::BIGINT AS {name}_matched, coalesce(string_agg(item, '; ' ORDER BY item) FILTER (l = 1 AND r = 0), '') AS {name}_left_only, coalesce(string_agg(item, '; ' ORDER BY item) FILTER (l = 0 AND r = 1), '') AS {name}_right_only FROM {name}_i GROUP BY 1)"""


_BOTH = "a.label IS NOT NULL AND b.label IS NOT NULL"
_APART = {f: f"{_BOTH} AND ((a.{f} IS NULL) <> (b.{f} IS NULL) OR coalesce(abs(a.{f} - b.{f}) > 1e-6, false))" for f in _FEATURES}
_LABELS = ("tradeable_reversal", "trap_reversal", "aggressive_blowthrough", "no_resolution")
_OUTCOME_SQL = f"""o_s AS (
  SELECT coalesce(a.trading_day, b.trading_day) AS trading_day, count(*) FILTER (a.session = 'ny' OR b.session = 'ny') AS eligible_touches,
    count(a.label) AS labelled_left, count(b.label) AS labelled_right, count(a.drop_reason) AS dropped_left, count(b.drop_reason) AS dropped_right,
    count(*) FILTER ((a.label IS NULL) <> (b.label IS NULL)) AS survivors_differ, count(*) FILTER (a.label <> b.label) AS label_flips,
    {', '.join(f'count(*) FILTER ({on}) AS {f}_differ, coalesce(max(abs(coalesce(a.{f}, 0) - coalesce(b.{f}, 0))) FILTER ({on}), 0)::DOUBLE AS {f}_worst' for f, on in _APART.items())},
    {', '.join(f"count(*) FILTER (a.label = '{x}') AS n_{x}" for x in _LABELS)}
  FROM l_judged a FULL JOIN r_judged b ON a.trading_day = b.trading_day AND a.level_type = b.level_type AND a.direction = b.direction AND a.bar_ts = b.bar_ts AND round(a.representative_price, 6) = round(b.representative_price, 6)
  GROUP BY 1)"""
_COUNTS = ["bars_left", "bars_right", *(f"{x}_{y}" for x in ("levels", "zones", "touches") for y in ("left", "right", "matched")), "eligible_touches", "labelled_left", "labelled_right", "dropped_left", "dropped_right", "survivors_differ", "label_flips", *(f"{f}_differ" for f in _FEATURES), *(f"n_{x}" for x in _LABELS)]
_DAY_SQL = f"""WITH {_SIDES},
{_set_sql("levels", "levels", "name || '|' || format('{:.6f}', price) || '|' || side")},
{_set_sql("zones", "zones", "format('{:.6f}', representative_price) || '|' || side || '|' || array_to_string(names, ',')")},
{_set_sql("touches", "touches", "level_type || '|' || direction || '|' || strftime(bar_ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || format('{:.6f}', round(representative_price, 6))")},
{_OUTCOME_SQL},
lb AS (SELECT trading_day, count(*) AS bars_left FROM l_bars GROUP BY 1), rb AS (SELECT trading_day, count(*) AS bars_right FROM r_bars GROUP BY 1),
d AS (SELECT * FROM lb FULL JOIN rb USING (trading_day) LEFT JOIN levels_s USING (trading_day) LEFT JOIN zones_s USING (trading_day) LEFT JOIN touches_s USING (trading_day) LEFT JOIN o_s USING (trading_day)),
e AS (SELECT trading_day, CASE WHEN bars_left IS NULL OR bars_right IS NULL THEN 'empty bar set' END AS reason, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*_COUNTS, *(f'{f}_worst' for f in _FEATURES)])}, {', '.join(f"coalesce({x}_{y}_only, '') AS {x}_{y}_only" for x in ('levels', 'zones', 'touches') for y in ('left', 'right'))} FROM d)
SELECT *, {', '.join(f'{x}_left = {x}_matched AND {x}_right = {x}_matched AS {x}_identical' for x in ('levels', 'zones', 'touches'))}, survivors_differ = 0 AS survivors_identical, label_flips = 0 AS labels_identical, {' + '.join(f'{f}_differ' for f in _FEATURES)} = 0 AS features_identical FROM e"""
query("diff_day", _DAY_SQL)(lambda s, d: diff.day_differences(*_two_runs(s, d), _FEATURES))


def _in_files(s: SparkSession, d: str) -> DataFrame:
    """The tape with ties, written as files in canonical order; the rank is a row's file and place."""
    t = tape_ties(s, d)
    return sinks.read_ordered(s, sinks.write_ordered(t, sinks.scratch(s, "ordered"), ordering.canonical_key()))


query("ord_files_rank", S.with_(T, S.TIES, then=f"SELECT ts_event, sequence, side_signed, size, {_RANK} AS rank FROM ties"))(lambda s, d: _in_files(s, d).select("ts_event", "sequence", ticks.side_signed(F.col("price_ticks"), F.col("side")).alias("side_signed"), "size", F.col("rank").cast("long").alias("rank")))
_DRAINED = "dr AS (SELECT *, date_trunc('hour', ts_event) AS drain, row_number() OVER (PARTITION BY date_trunc('hour', ts_event) ORDER BY sequence) AS k FROM tape)"


def _drained(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return market.bounded(tape_events(s, d).withColumn("drain", F.date_trunc("hour", "ts_event").cast("timestamp_ntz")), "drain", "sequence", 5)


query("src_queue_kept", S.with_(T, _DRAINED, then="SELECT drain, sequence, price_ticks FROM dr WHERE k <= 5"))(lambda s, d: _drained(s, d)[0].select("drain", "sequence", "price_ticks"))
query("src_queue_drops", S.with_(T, _DRAINED, then="SELECT 'backpressure_drop' AS code, (count(*) - 5)::VARCHAR || ' messages dropped' AS message, drain, count(*) - 5 AS count FROM dr GROUP BY drain HAVING count(*) > 5"))(lambda s, d: _drained(s, d)[1].select("code", "message", "drain", "count"))

# Several instruments in one tape: each has bars, levels, zones, touches and outcomes of its own. The SQL runs the chain of one for each.
_BY = ("symbol",)


def _sym_chain(s: SparkSession, d: str) -> dataset.Chain:
    return dataset.chain(tape_symbols(s, d), N, by=_BY)


def _sym_quotes(s: SparkSession, d: str) -> DataFrame:
    """One quote beside each trade."""
    k = F.col("sequence")
    return tape_symbols(s, d).select("symbol", "ts_event", "sequence", (F.col("price_ticks") - 1).alias("bid_ticks"), (F.col("price_ticks") + 1 + k % 3).alias("ask_ticks"))


query("sym_bars", S.each_symbol(T, B, then=f"SELECT {S.BAR_COLUMNS} FROM bars"))(lambda s, d: bars.tick_bars(tape_symbols(s, d), N, EASTERN, by=_BY))
query("sym_levels", S.each_symbol(T, B, L, then="SELECT * FROM levels"))(lambda s, d: _sym_chain(s, d).levels)
query("sym_zones", S.each_symbol(T, B, L, Z, then=_ZONES))(lambda s, d: _flat(_sym_chain(s, d).zones).select("symbol", "trading_day", "zone_id", "representative_price", "names", "side", "available_from", "n_levels"))
query("sym_touches", S.each_symbol(*TO_TOUCH, then="SELECT * FROM touches"))(lambda s, d: _sym_chain(s, d).touches)
query("sym_touch_runtime", S.each_symbol(T, B, L, S.RUNTIME_TOUCHES, then=_RUNTIME))(lambda s, d: _runtime(tape_symbols(s, d), _BY))
_STREAM_BAR = ("timeframe_ticks", "trading_day", "bar_index", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "trade_count", "close_reason")
query("stream_symbols", S.each_symbol(T, S.bars(7, "b1"), S.bars(147, "b2"), then=" UNION ALL ".join(f"SELECT {', '.join(_STREAM_BAR)} FROM b{i}" for i in (1, 2))))(lambda s, d: _streamed(s, d, tape_symbols(s, d), sizes=(7, 147), batches=4).where("kind = 'bar'").select("symbol", *_STREAM_BAR))
query("stream_touches_runtime", S.each_symbol(T, B, L, S.RUNTIME_TOUCHES, then="SELECT trading_day, bar_index, bar_ts, representative_price, direction, level_type FROM rt"))(lambda s, d: _streamed(s, d, tape_symbols(s, d), sizes=(7,), batches=4, carry_prior_day=True).where("kind = 'touch'").select("symbol", "trading_day", "bar_index", F.col("ts").alias("bar_ts"), "representative_price", "direction", "level_type"))
# The state that a stream of trades and quotes leaves behind: the range of the day before, open and closed bars, the last quote.
_LAST_DAY = "last AS (SELECT max(trading_day) AS trading_day FROM bars)"
_SNAPSHOT = """SELECT trading_day, (SELECT count(*) FROM num) + (SELECT count(*) FROM quotes) AS events, (SELECT max_by(bid_ticks, (ts_event, sequence)) FROM quotes) AS bid_ticks, (SELECT max_by(ask_ticks, (ts_event, sequence)) FROM quotes) AS ask_ticks,
  (SELECT max(price) FROM levels l WHERE l.trading_day = last.trading_day AND name = 'pdh') AS pdh, (SELECT max(price) FROM levels l WHERE l.trading_day = last.trading_day AND name = 'pdl') AS pdl,
  least(500, (SELECT count(*) FROM bars)) AS recent, (SELECT count(*) FROM rt_zones z WHERE z.trading_day = last.trading_day AND bar_index = (SELECT max(bar_index) FROM rt_zones y WHERE y.trading_day = last.trading_day)) AS n_zones,
  (SELECT count(*) FROM rt_zones z WHERE z.trading_day = last.trading_day AND bar_index = (SELECT max(bar_index) FROM rt_zones y WHERE y.trading_day = last.trading_day) AND EXISTS (SELECT 1 FROM rt WHERE rt.trading_day = z.trading_day AND rt.names = z.names AND rt.side = z.side AND round(rt.representative_price, 6) = round(z.representative_price, 6))) AS n_touched
FROM last"""


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    place = sinks.scratch(s, "state")
    tape = tape_symbols(s, d).drop("price").withColumn("kind", F.lit("trade"))
    quotes = _sym_quotes(s, d).withColumns({"kind": F.lit("quote"), "bid_size": F.lit(1).cast("long"), "ask_size": F.lit(1).cast("long")})
    runs.run_to_end(tape.unionByName(quotes, allowMissingColumns=True), checkpoint=place, sizes=(7,), batches=3, carry_prior_day=True)
    level = lambda name: F.array_max(F.transform(F.filter("levels", lambda x: x["name"] == name), lambda x: x["price"]))
    return read_snapshot(s, place).where("symbol != ''").select("symbol", "trading_day", "events", "quote.bid_ticks", "quote.ask_ticks", level("pdh").alias("pdh"), level("pdl").alias("pdl"), F.size("recent").cast("long").alias("recent"), F.size("zones").cast("long").alias("n_zones"), F.size(F.filter("zones", lambda z: z["touched"])).cast("long").alias("n_touched"))


query("stream_snapshot", S.each_symbol(T, B, L, S.RUNTIME_TOUCHES, _LAST_DAY, then=_SNAPSHOT))(_snapshot)
query("sym_outcomes", S.each_symbol(*TO_TOUCH, S.DECISIONS, then="SELECT * FROM honest"))(lambda s, d: (lambda c: outcomes.decision_outcomes(c.touches, c.bars, tape_symbols(s, d), P, EASTERN, by=_BY))(_sym_chain(s, d)))
query("sym_dataset", S.each_symbol(*TO_TOUCH, S.DECISIONS, S.FEATURES, then=_ROWS))(lambda s, d: dataset.training_rows(tape_symbols(s, d), _sym_quotes(s, d), N, by=_BY))
