"""The same results as SQL that DuckDB runs: common table expressions for each step, put before a final select."""

from __future__ import annotations

ET = "America/New_York"
CT = "America/Chicago"


def local(ts: str, zone: str = ET) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"


def utc(ts: str, zone: str = ET) -> str:
    return f"(({ts} AT TIME ZONE '{zone}') AT TIME ZONE 'UTC')"


def session(local_ts: str, scheme: str = "ET") -> str:
    t = f"(epoch_us({local_ts}) % 86400000000 // 1000000)"
    if scheme == "CT":
        return f"CASE WHEN {t} >= 57600 AND {t} < 64800 THEN 'closed' WHEN {t} >= 64800 OR {t} < 7200 THEN 'asia' WHEN {t} >= 7200 AND {t} < 28800 THEN 'london' WHEN {t} >= 28800 AND {t} < 57600 THEN 'ny' ELSE 'none' END"
    return f"CASE WHEN {t} >= 68400 OR {t} < 9900 THEN 'asia' WHEN {t} >= 10800 AND {t} < 28800 THEN 'london' WHEN {t} >= 32400 AND {t} < 61200 THEN 'ny' ELSE 'none' END"


def day(local_ts: str) -> str:
    return f"CAST({local_ts} + INTERVAL 6 HOUR AS DATE)"


TAPE = f"""
raw AS (SELECT *, epoch_us(ts) // 60000000 AS m FROM events),
tape AS (
  SELECT ts AS ts_event, event_id AS sequence,
    (68000 + abs(m % 1260 - 630) // 2 + abs(m % 4200 - 2100) // 6 + floor(value * 100)::BIGINT % 25)::BIGINT AS price_ticks,
    (1 + user_id % 17)::BIGINT AS size,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'B' WHEN event_type = 'error' THEN 'N' ELSE 'A' END AS side
  FROM raw),
signed AS (SELECT *, price_ticks * 0.25::DOUBLE AS price, CASE WHEN side = 'B' THEN price_ticks ELSE -price_ticks END AS side_signed, {local('ts_event')} AS local_ts FROM tape),
num AS (
  SELECT *, {session('local_ts')} AS session, {day('local_ts')} AS trading_day,
    row_number() OVER (PARTITION BY {day('local_ts')} ORDER BY ts_event, sequence, side_signed, size) - 1 AS rn
  FROM signed),
book AS (
  SELECT ts_event, sequence, price_ticks, side, CASE WHEN sequence % 11 IN (8, 9) THEN size * 10 ELSE size END AS size,
    CASE WHEN sequence % 3 = 0 THEN 'T' ELSE 'A' END AS action,
    CASE WHEN sequence % 11 < 8 THEN 'AAF4' WHEN sequence % 11 < 10 THEN 'AAH4' ELSE 'AAF4-AAH4' END AS symbol,
    CASE WHEN sequence % 11 < 8 THEN 1 WHEN sequence % 11 < 10 THEN 2 ELSE 3 END::BIGINT AS instrument_id,
    price - 0.25 AS bid_px_00, price + 0.25 * (1 + sequence % 3) AS ask_px_00, 1 + sequence % 9 AS bid_size, sequence % 7 AS ask_size
  FROM signed),
quotes AS (SELECT ts_event, sequence, price_ticks - 1 AS bid_ticks, price_ticks + 1 + sequence % 3 AS ask_ticks, 1 + sequence % 9 AS bid_size, sequence % 7 AS ask_size FROM tape)"""

#: The longer tape, as num.
TAPE_LINEITEM = f"""
li AS (
  SELECT l_shipdate::TIMESTAMP + INTERVAL 1 SECOND * ((l_orderkey * 7919 + l_linenumber * 104729) % 86400) AS ts_event, l_orderkey * 8 + l_linenumber AS sequence, l_partkey, l_quantity::BIGINT AS size FROM lineitem),
lim AS (SELECT *, epoch_us(ts_event) // 60000000 AS m FROM li),
lip AS (SELECT ts_event, sequence, size, (68000 + abs(m % 1260 - 630) // 2 + abs(m % 4200 - 2100) // 6 + l_partkey % 25)::BIGINT AS price_ticks FROM lim),
num AS (SELECT *, {day(local('ts_event'))} AS trading_day, row_number() OVER (PARTITION BY {day(local('ts_event'))} ORDER BY ts_event, sequence, -price_ticks, size) - 1 AS rn FROM lip)"""
#: Trades that tie in instant and number, as numt.
TIES = f"""
ties AS (SELECT date_trunc('hour', ts_event) AS ts_event, sequence % 2 AS sequence, price_ticks, size, side, side_signed FROM signed),
numt AS (SELECT *, {day(local('ts_event'))} AS trading_day, row_number() OVER (PARTITION BY {day(local('ts_event'))} ORDER BY ts_event, sequence, side_signed, size) - 1 AS rn FROM ties)"""

BAR_COLUMNS = "timeframe_ticks, trading_day, bar_index, open_ts, close_ts, open_ticks, high_ticks, low_ticks, close_ticks, volume, trade_count, bar_id, is_complete, is_partial, close_reason"


def bars(n: int, name: str = "bars", source: str = "num", rn: str = "rn") -> str:
    return f"""
{name}_g AS (
  SELECT {n}::INTEGER AS timeframe_ticks, trading_day, {rn} // {n} AS bar_index, min(ts_event) AS open_ts, max(ts_event) AS close_ts,
    min_by(price_ticks, {rn}) AS open_ticks, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks, max_by(price_ticks, {rn}) AS close_ticks,
    sum(size)::BIGINT AS volume, count(*)::BIGINT AS trade_count
  FROM {source} GROUP BY trading_day, {rn} // {n}),
{name} AS (
  SELECT *, '{n}t:' || trading_day::VARCHAR || ':' || bar_index AS bar_id, trade_count = {n} AS is_complete, trade_count <> {n} AS is_partial,
    CASE WHEN trade_count = {n} THEN 'complete' ELSE 'end_of_day' END AS close_reason
  FROM {name}_g)"""


LEVELS = f"""
days AS (SELECT trading_day, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks FROM bars GROUP BY 1),
prior AS (
  SELECT trading_day, pdh_ticks, pdl_ticks FROM (
    SELECT trading_day, lag(trading_day) OVER w AS p, lag(high_ticks) OVER w AS pdh_ticks, lag(low_ticks) OVER w AS pdl_ticks FROM days WINDOW w AS (ORDER BY trading_day))
  WHERE p IS NOT NULL AND trading_day - p <= 7),
sess AS (SELECT trading_day, session, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks FROM (SELECT *, {session(local('close_ts'))} AS session FROM bars) GROUP BY 1, 2),
lv AS (
  SELECT trading_day, 'pdh' AS name, pdh_ticks AS ticks, 'HIGH' AS side, {utc("(trading_day - 1 + TIME '18:00:00')")} AS available_from, 0 AS ordinal FROM prior
  UNION ALL SELECT trading_day, 'pdl', pdl_ticks, 'LOW', {utc("(trading_day - 1 + TIME '18:00:00')")}, 1 FROM prior
  UNION ALL SELECT trading_day, 'asia_high', high_ticks, 'HIGH', {utc("(trading_day + TIME '02:45:00')")}, 2 FROM sess WHERE session = 'asia'
  UNION ALL SELECT trading_day, 'asia_low', low_ticks, 'LOW', {utc("(trading_day + TIME '02:45:00')")}, 3 FROM sess WHERE session = 'asia'
  UNION ALL SELECT trading_day, 'london_high', high_ticks, 'HIGH', {utc("(trading_day + TIME '08:00:00')")}, 4 FROM sess WHERE session = 'london'
  UNION ALL SELECT trading_day, 'london_low', low_ticks, 'LOW', {utc("(trading_day + TIME '08:00:00')")}, 5 FROM sess WHERE session = 'london'),
levels AS (SELECT trading_day, name, ticks * 0.25::DOUBLE AS price, side, available_from, ordinal::INTEGER AS ordinal FROM lv)"""


def zones(proximity: float = 3.0, name: str = "zones") -> str:
    return f"""
{name}_s AS (SELECT *, CASE WHEN price - lag(price) OVER (PARTITION BY trading_day ORDER BY price, ordinal) > {proximity} THEN 1 ELSE 0 END AS gap FROM levels),
{name}_n AS (SELECT *, sum(gap) OVER (PARTITION BY trading_day ORDER BY price, ordinal ROWS UNBOUNDED PRECEDING)::BIGINT AS zone_id FROM {name}_s),
{name} AS (
  SELECT trading_day, zone_id, sum(price) / count(*) AS representative_price, list(name ORDER BY price, ordinal) AS names,
    CASE WHEN 2 * count(*) FILTER (side = 'HIGH') > count(*) THEN 'HIGH' ELSE 'LOW' END AS side, max(available_from) AS available_from, count(*) AS n_levels
  FROM {name}_n GROUP BY 1, 2)"""


def touches(gated: bool = True, name: str = "touches", all_hits: str = "hits") -> str:
    gate = "AND (available_from IS NULL OR close_ts >= available_from)" if gated else ""
    return f"""
{all_hits} AS (
  SELECT b.trading_day, zone_id, bar_index, close_ts, representative_price, names, z.side, available_from
  FROM bars b JOIN zones z ON b.trading_day = z.trading_day AND representative_price BETWEEN low_ticks * 0.25 AND high_ticks * 0.25 {gate}),
{name}_f AS (SELECT *, row_number() OVER (PARTITION BY trading_day, zone_id ORDER BY bar_index) AS k FROM {all_hits}),
{name} AS (
  SELECT trading_day, zone_id, bar_index, close_ts AS bar_ts, representative_price, side, CASE side WHEN 'LOW' THEN 'LONG' ELSE 'SHORT' END AS direction,
    names[1] AS level_type, row_number() OVER (PARTITION BY trading_day ORDER BY bar_index, zone_id)::INTEGER AS touch_order
  FROM {name}_f WHERE k = 1)"""


FEATURES = """
inter AS (
  SELECT t.trading_day, zone_id, direction, representative_price AS level, x.price_ticks * 0.25 AS price, x.size, x.ts_event,
    lead(x.ts_event) OVER (PARTITION BY t.trading_day, zone_id ORDER BY x.ts_event, x.sequence, x.side_signed, x.size) AS next_ts
  FROM touches t JOIN signed x ON x.ts_event >= bar_ts AND x.ts_event < bar_ts + INTERVAL 5 MINUTE),
gaps AS (
  SELECT *, CASE WHEN direction = 'LONG' THEN price < level ELSE price > level END AS adverse,
    CASE WHEN epoch_us(next_ts) - epoch_us(ts_event) BETWEEN 0 AND 600000000 THEN epoch_us(next_ts) - epoch_us(ts_event) END AS gap
  FROM inter),
f_inter AS (
  SELECT trading_day, zone_id, round(coalesce(sum(gap) FILTER (adverse), 0) / 1e6, 4) AS int_time_beyond_level,
    round(coalesce(sum(gap) FILTER (abs(price - level) <= 2.0), 0) / 1e6, 4) AS int_time_within_2pts,
    coalesce(sum(size) FILTER (abs(price - level) <= 0.5), 0) AS at_level, coalesce(sum(size) FILTER (abs(price - level) > 0.5 AND adverse), 0) AS past
  FROM gaps GROUP BY 1, 2),
appr AS (SELECT t.trading_day, zone_id, x.size FROM touches t JOIN signed x ON x.ts_event >= bar_ts - INTERVAL 90 MINUTE AND x.ts_event < bar_ts),
f_appr AS (SELECT trading_day, zone_id, CASE WHEN sum(size) > 0 THEN coalesce(sum(size) FILTER (size >= 10), 0) / sum(size) END AS app_large_trade_vol_pct, sum(size) / count(*) AS app_avg_trade_size FROM appr GROUP BY 1, 2),
f_spread AS (SELECT t.trading_day, zone_id, max(ask_ticks - bid_ticks) * 0.25::DOUBLE AS app_max_spread FROM touches t JOIN quotes q ON q.ts_event >= bar_ts - INTERVAL 90 MINUTE AND q.ts_event < bar_ts GROUP BY 1, 2),
feats AS (
  SELECT t.trading_day, t.zone_id, coalesce(int_time_beyond_level, 0) AS int_time_beyond_level, coalesce(int_time_within_2pts, 0) AS int_time_within_2pts,
    CASE WHEN at_level + past > 0 THEN round(at_level / (at_level + past), 6) ELSE 0.0 END::DOUBLE AS int_absorption_ratio, app_large_trade_vol_pct, app_avg_trade_size, app_max_spread
  FROM touches t LEFT JOIN f_inter USING (trading_day, zone_id) LEFT JOIN f_appr USING (trading_day, zone_id) LEFT JOIN f_spread USING (trading_day, zone_id))"""


def ladder(mfe: str, mae: str, trap: float = 5.0, forced: bool = False) -> str:
    loss = f"CASE WHEN {mfe} >= {trap} THEN 'trap_reversal' ELSE 'aggressive_blowthrough' END"
    return f"CASE WHEN {mae} >= 30.0 THEN {loss} WHEN {mfe} >= 15.0 THEN 'tradeable_reversal' {'ELSE ' + loss if forced else ''} END"


ENCODE = "CASE {0} WHEN 'tradeable_reversal' THEN 0 WHEN 'trap_reversal' THEN 1 WHEN 'aggressive_blowthrough' THEN 2 END::INTEGER"


def resolve(entries: str, name: str = "resolved", trap: float = 5.0, forced: bool = False) -> str:
    """entries: trading_day, zone_id, direction, entry_price, after_ts, before_ts."""
    return f"""
{name}_w AS (
  SELECT e.trading_day, zone_id, direction, entry_price, bar_index, row_number() OVER w - 1 AS k,
    greatest(0.0, max(CASE WHEN direction = 'LONG' THEN high_ticks * 0.25 - entry_price ELSE entry_price - low_ticks * 0.25 END) OVER w) AS mfe,
    greatest(0.0, max(CASE WHEN direction = 'LONG' THEN entry_price - low_ticks * 0.25 ELSE high_ticks * 0.25 - entry_price END) OVER w) AS mae
  FROM {entries} e JOIN bars b ON b.trading_day = e.trading_day AND close_ts > after_ts AND close_ts < before_ts
  WINDOW w AS (PARTITION BY e.trading_day, zone_id ORDER BY bar_index ROWS UNBOUNDED PRECEDING)),
{name}_l AS (SELECT *, {ladder('mfe', 'mae', trap, forced)} AS lab FROM {name}_w),
{name} AS (
  SELECT trading_day, zone_id, coalesce(arg_min(lab, k) FILTER (lab IS NOT NULL), 'no_resolution') AS label,
    {ENCODE.format('(arg_min(lab, k) FILTER (lab IS NOT NULL))')} AS label_encoded,
    round(coalesce(arg_min(mfe, k) FILTER (lab IS NOT NULL), max(mfe)), 4)::DOUBLE AS max_mfe, round(coalesce(arg_min(mae, k) FILTER (lab IS NOT NULL), max(mae)), 4)::DOUBLE AS max_mae,
    coalesce(min(k) FILTER (lab IS NOT NULL), -1)::INTEGER AS bars_to_resolution, count(*) AS n_forward
  FROM {name}_l GROUP BY 1, 2)"""


def decisions(tolerance_min: int = 30, cutoff: str = "17:00:00", flatten_s: int = 60000) -> str:
    return f"""
dec AS (
  SELECT trading_day, zone_id, direction, bar_ts + INTERVAL 5 MINUTE AS decision_ts, {utc(f"(trading_day + TIME '{cutoff}')")} AS cutoff_ts FROM touches),
early AS (
  SELECT *, CASE WHEN epoch_us({local('decision_ts')}) % 86400000000 >= {flatten_s} * 1000000::BIGINT THEN 'flatten' WHEN decision_ts >= cutoff_ts THEN 'cutoff' END AS reason FROM dec),
fills AS (
  SELECT e.trading_day, zone_id, max_by(price_ticks, (x.ts_event, x.sequence, x.side_signed, x.size)) * 0.25::DOUBLE AS entry_price
  FROM early e JOIN signed x ON x.ts_event <= decision_ts AND x.ts_event >= decision_ts - INTERVAL {tolerance_min} MINUTE WHERE reason IS NULL GROUP BY 1, 2),
entries AS (SELECT e.trading_day, zone_id, direction, entry_price, decision_ts AS after_ts, cutoff_ts AS before_ts FROM early e JOIN fills USING (trading_day, zone_id)),
{resolve('entries').lstrip()},
honest AS (
  SELECT e.trading_day, zone_id, decision_ts, entry_price, label, label_encoded, max_mfe, max_mae, bars_to_resolution,
    coalesce(reason, CASE WHEN entry_price IS NULL THEN 'no_fill' WHEN label IS NULL THEN 'no_forward' END) AS drop_reason
  FROM early e LEFT JOIN fills USING (trading_day, zone_id) LEFT JOIN resolved USING (trading_day, zone_id))"""


_RT_LEVELS = " UNION ALL ".join(
    f"SELECT trading_day, bar_index, close_ts, high_ticks, low_ticks, '{name}' AS name, {ticks} * 0.25::DOUBLE AS price, '{side}' AS side, {utc(known)} AS available_from, {i} AS ordinal FROM rt_bars WHERE {ticks} IS NOT NULL"
    for i, (name, ticks, side, known) in enumerate([
        ("pdh", "pdh_ticks", "HIGH", "(trading_day - 1 + TIME '18:00:00')"), ("pdl", "pdl_ticks", "LOW", "(trading_day - 1 + TIME '18:00:00')"),
        ("asia_high", "asia_high", "HIGH", "(trading_day + TIME '02:45:00')"), ("asia_low", "asia_low", "LOW", "(trading_day + TIME '02:45:00')"),
        ("london_high", "london_high", "HIGH", "(trading_day + TIME '08:00:00')"), ("london_low", "london_low", "LOW", "(trading_day + TIME '08:00:00')"),
    ])
)
#: Zones by the levels known when each bar closed (rt_zones), and the first bar that meets each of them (rt).
RUNTIME_TOUCHES = f"""
rt_ranges AS (
  SELECT trading_day, rn // 7 AS bar_index, max(price_ticks) FILTER (session = 'asia') AS asia_high, min(price_ticks) FILTER (session = 'asia') AS asia_low,
    max(price_ticks) FILTER (session = 'london') AS london_high, min(price_ticks) FILTER (session = 'london') AS london_low
  FROM num GROUP BY 1, 2),
rt_bars AS (
  SELECT trading_day, bar_index, close_ts, high_ticks, low_ticks, pdh_ticks, pdl_ticks,
    max(asia_high) OVER w AS asia_high, min(asia_low) OVER w AS asia_low, max(london_high) OVER w AS london_high, min(london_low) OVER w AS london_low
  FROM bars JOIN rt_ranges USING (trading_day, bar_index) LEFT JOIN prior USING (trading_day)
  WINDOW w AS (PARTITION BY trading_day ORDER BY bar_index ROWS UNBOUNDED PRECEDING)),
rt_levels AS ({_RT_LEVELS}),
rt_gaps AS (SELECT *, CASE WHEN price - lag(price) OVER (PARTITION BY trading_day, bar_index ORDER BY price, ordinal) > 3.0 THEN 1 ELSE 0 END AS gap FROM rt_levels),
rt_numbered AS (SELECT *, sum(gap) OVER (PARTITION BY trading_day, bar_index ORDER BY price, ordinal ROWS UNBOUNDED PRECEDING) AS z FROM rt_gaps),
rt_zones AS (
  SELECT trading_day, bar_index, any_value(close_ts) AS close_ts, any_value(high_ticks) AS high_ticks, any_value(low_ticks) AS low_ticks, sum(price) / count(*) AS representative_price,
    list(name ORDER BY price, ordinal) AS names, CASE WHEN 2 * count(*) FILTER (side = 'HIGH') > count(*) THEN 'HIGH' ELSE 'LOW' END AS side, max(available_from) AS available_from
  FROM rt_numbered GROUP BY trading_day, bar_index, z),
rt_hits AS (
  SELECT *, row_number() OVER (PARTITION BY trading_day, names, side, round(representative_price, 6) ORDER BY bar_index) AS k
  FROM rt_zones WHERE representative_price BETWEEN low_ticks * 0.25 AND high_ticks * 0.25 AND close_ts >= available_from),
rt AS (SELECT trading_day, bar_index, close_ts AS bar_ts, representative_price, side, CASE side WHEN 'LOW' THEN 'LONG' ELSE 'SHORT' END AS direction, names[1] AS level_type, names FROM rt_hits WHERE k = 1)"""

DECISIONS = decisions()

BARS = bars(7)


def with_(*parts: str, then: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + then


def each_symbol(tape: str, *parts: str, then: str) -> str:
    """The result of one instrument's tape for each of three symbols, with a column symbol."""
    own = lambda k: tape.replace("FROM events)", f"FROM events WHERE user_id % 3 = {k})")
    return "\nUNION ALL\n".join(f"SELECT 'S{k}' AS symbol, of_{k}.* FROM ({with_(own(k), *parts, then=then)}) of_{k}" for k in range(3))
