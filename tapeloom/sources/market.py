"""Normalising of trades and quotes from files and messages, with data-quality notes as a second result."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import ticks

# Column aliases and schema names of feeds.
BID, ASK = ("bid_price", "bid_px", "bid", "bid_px_00"), ("ask_price", "ask_px", "ask", "ask_px_00")
BID_SIZE, ASK_SIZE = ("bid_size", "bid_sz", "bid_sz_00"), ("ask_size", "ask_sz", "ask_sz_00")
SYMBOL, SEQUENCE = ("raw_symbol", "symbol"), ("sequence", "seq")
TRADE_SCHEMAS = ("trades", "trade")
BOOK_SCHEMAS = ("mbp-10", "mbp10", "cmbp-10", "cmbp10")
TOP_SCHEMAS = ("mbp-1", "cmbp-1", "bbo", "cbbo", "tbbo")
REQUIRED = {"trade": {"ts_event", "price", "size"}, "book": {"ts_event", "price", "size", "action"}, "top": {"ts_event"}}
NOTES = "code string, message string, severity string, source string, ts_event timestamp_ntz"
EVENTS = "ts_event timestamp_ntz, sequence long, kind string, price_ticks long, size long, side string, bid_ticks long, ask_ticks long, bid_size long, ask_size long"


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column | None:
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else None


def event_time(df: DataFrame, column: str = "ts_event") -> Column:
    """By the column's type: nanoseconds, text with an offset, or a UTC timestamp."""
    kind = dict(df.dtypes)[column]
    if kind in ("bigint", "int"):
        return ticks.from_nanos(F.col(column))
    if kind == "string":
        return ticks.from_iso(F.col(column))
    if kind == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz"))
    return F.col(column).cast("timestamp_ntz")


def _sequence(df: DataFrame) -> Column:
    have = [F.nullif(F.col(n).cast("long"), F.lit(0)) for n in SEQUENCE if n in df.columns]
    return F.coalesce(*have, F.lit(0).cast("long"))


def notes_of(rejected: DataFrame, message: str, severity: str = "warning", source: str | None = None) -> DataFrame:
    """Notes about rejected rows (code, ts_event); source: a column that names where a row comes from, told without its folders."""
    where = ticks.safe_source(F.col(source)) if source else F.lit(None).cast("string")
    return rejected.select("code", F.lit(message).alias("message"), F.lit(severity).alias("severity"), where.alias("source"), "ts_event")


def _split(judged: DataFrame, message: str, source: str | None) -> tuple[DataFrame, DataFrame]:
    return judged.where("code is null").drop("code", "_source"), notes_of(judged.where("code is not null"), message, source=source and "_source")


def normalize_trades(df: DataFrame, tick_size: float = 0.25, source: str | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(trades, notes). A row must have a time, a price on the grid and a whole positive size. keep: more columns, such as a symbol."""
    whole = dict(df.dtypes)["size"] in ("bigint", "int", "smallint", "tinyint")
    row = df.select(
        event_time(df).alias("ts_event"), _sequence(df).alias("sequence"), ticks.exact_ticks(F.col("price"), tick_size).alias("price_ticks"),
        (F.col("size").cast("long") if whole else F.lit(None).cast("long")).alias("size"),
        (F.upper("side") if "side" in df.columns else F.lit(None).cast("string")).alias("side"),
        (F.col(source) if source else F.lit(None).cast("string")).alias("_source"), *keep,
    )
    code = F.when(F.col("ts_event").isNull(), "invalid_timestamp").when(F.col("price_ticks").isNull(), "invalid_price").when(F.coalesce(F.col("size") <= 0, F.lit(True)), "invalid_record")
    return _split(row.withColumn("code", code), "trade record rejected", source)


def normalize_quotes(df: DataFrame, tick_size: float = 0.25, source: str | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(quotes, notes) of the top of book. A row must have a time, and both sides on the grid; sizes default to 0."""
    bid, ask = first_of(df, BID), first_of(df, ASK)
    if bid is None or ask is None:
        raise ValueError("quotes need a bid and an ask column")
    size = lambda names: F.coalesce(*[x.try_cast("long") for x in [first_of(df, names)] if x is not None], F.lit(0).cast("long"))
    row = df.select(
        event_time(df).alias("ts_event"), _sequence(df).alias("sequence"), ticks.exact_ticks(bid, tick_size).alias("bid_ticks"), ticks.exact_ticks(ask, tick_size).alias("ask_ticks"),
        size(BID_SIZE).alias("bid_size"), size(ASK_SIZE).alias("ask_size"), (F.col(source) if source else F.lit(None).cast("string")).alias("_source"), *keep,
    )
    code = F.when(F.col("ts_event").isNull(), "invalid_timestamp").when(F.col("bid_ticks").isNull() | F.col("ask_ticks").isNull(), "invalid_price")
    return _split(row.withColumn("code", code), "quote record rejected", source)


def outright(df: DataFrame) -> DataFrame:
    """Without spreads, whose symbol holds a hyphen."""
    symbol = first_of(df, SYMBOL)
    return df if symbol is None else df.where(F.coalesce(~symbol.contains("-"), F.lit(True)))


def front_month_by_volume(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., instrument_id) of the largest volume of outright rows; a size of null or 0 counts 1; ties to the lower id."""
    weight = F.greatest(F.coalesce(F.nullif(F.col("size"), F.lit(0)), F.lit(1)), F.lit(1))
    total = outright(df).where("instrument_id is not null").groupBy(*by, "instrument_id").agg(F.sum(weight).alias("volume"))
    return total.groupBy(*by).agg(F.max(F.struct("volume", (-F.col("instrument_id")).alias("k"))).alias("m")).select(*by, (-F.col("m.k")).alias("instrument_id"), F.col("m.volume").alias("volume"))


def front_month_by_rows(df: DataFrame) -> DataFrame:
    """(symbol, n) of the most rows; ties to the first symbol in order."""
    return outright(df).groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol").limit(1)


def only_front_month(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One instrument per group is a table as small as the groups; a semi-join lets Spark broadcast it by its size."""
    front = front_month_by_volume(df, by).select(*by, "instrument_id")
    return df.join(front, [*by, "instrument_id"], "left_semi")


def day_window(df: DataFrame, symbol: str, start: str, end: str) -> DataFrame:
    """Trades of one symbol in a book within [start, end) of event time (UTC), with a positive price."""
    inside = (F.col("ts_event") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts_event") < F.lit(end).cast("timestamp_ntz"))
    return df.where((F.col("symbol") == symbol) & F.upper("action").isin("T", "TRADE") & (F.col("price") > 0) & inside)


def typed(events: DataFrame, kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """events with keep and all columns of EVENTS, those that a kind lacks null."""
    have = set(events.columns)
    return events.select(*keep, *[F.lit(kind).alias("kind") if n == "kind" else (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in EVENTS.split(", "))])


def book_events(df: DataFrame, tick_size: float = 0.25, source: str | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, notes) of book rows fanned out: a trade for action T, and a quote if both sides are known."""
    trades, bad_trades = normalize_trades(df.where(F.upper("action").isin("T", "TRADE")), tick_size, source, keep)
    bid, ask = first_of(df, BID), first_of(df, ASK)
    if bid is None or ask is None:
        return typed(trades, "trade", keep), bad_trades
    quotes, bad_quotes = normalize_quotes(df.where(bid.isNotNull() & ask.isNotNull()), tick_size, source, keep)
    return typed(trades, "trade", keep).unionByName(typed(quotes, "quote", keep)), bad_trades.unionByName(bad_quotes)


def book_mid(df: DataFrame) -> DataFrame:
    """Events at the middle of a two-sided book, in eighths of a point."""
    both = df.where("bid_px_00 > 0 and ask_px_00 > 0")
    return both.select("ts_event", "sequence", ((F.col("bid_px_00") + F.col("ask_px_00")) / 2).alias("mid"), ticks.nearest_ticks((F.col("bid_px_00") + F.col("ask_px_00")) / 2, 0.125).alias("price_ticks"), "size", "side")


def feed_kind(schema: str) -> str | None:
    name = schema.lower()
    return "trade" if name in TRADE_SCHEMAS else "book" if name in BOOK_SCHEMAS else "top" if name in TOP_SCHEMAS else None


def missing_columns(columns: list[str], kind: str) -> list[str]:
    """What a file of a kind lacks; a top-of-book file needs one name of each side."""
    have = set(columns)
    lacks = sorted(REQUIRED[kind] - have)
    return lacks + [names[0] for names in (BID, ASK) if not have & set(names)] if kind == "top" else lacks


def _known_names() -> tuple[str, ...]:
    """The columns that any feed is read for."""
    return tuple(dict.fromkeys(("ts_event", *SEQUENCE, "price", "size", "side", "action", *SYMBOL, "instrument_id", *BID, *ASK, *BID_SIZE, *ASK_SIZE)))


def file_schemas(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(path, fingerprint, error) of each file or folder of files: the known columns with their types, or why it can't be opened.

    Footers are read by one job on the executors. Paths of a store that only Spark's readers open are left to it, one by one.
    """
    known = set(_known_names())

    def told(columns: list[tuple[str, str]]) -> str:
        return json.dumps([c for c in sorted(columns) if c[0] in known])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for part in batches for p in part.column(0).to_pylist()):
            schema = error = None
            try:
                fs, place = _opened(path)
                info = fs.get_file_info(place)
                if info.type == pafs.FileType.Directory:
                    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if f.type == pafs.FileType.File and not os.path.basename(f.path).startswith(("_", ".")))
                    place = found[0] if found else place
                elif info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError
                schema = told([(f.name, str(f.type)) for f in pq.read_schema(place, filesystem=fs)])
            except (pa.ArrowException, OSError, ValueError) as e:
                error = UNKNOWN_STORE if "Unrecognized filesystem" in str(e) else type(e).__name__
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "fingerprint": pa.array([schema], pa.string()), "error": pa.array([error], pa.string())})

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism), "path") if paths else None
    out = {r["path"]: (r["fingerprint"], r["error"]) for r in rows.mapInArrow(probe, "path string, fingerprint string, error string").collect()} if rows else {}
    for path in [p for p, (_, error) in out.items() if error == UNKNOWN_STORE]:
        try:
            out[path] = told([(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema]), None
        except (PySparkException, Py4JJavaError) as e:  # of a store without a reader
            out[path] = None, type(e).__name__
    return [(p, *out[p]) for p in dict.fromkeys(paths)]


UNKNOWN_STORE = "another store"


def lost_rows(scan: DataFrame) -> DataFrame:
    """(file_path, n_rows, n_read) of the files of a scan (with file_path) that give fewer rows than their footers tell, as a page can't be decoded.

    A count that needs no column comes from the footers alone; a hash of all columns has every page decoded.
    """
    told = scan.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"))
    read = scan.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_read"), F.max(F.xxhash64(*[c for c in scan.columns if c != "file_path"])).alias("_all")).where("_all is not null").drop("_all")
    both = told.join(read, "file_path", "left").select("file_path", "n_rows", F.coalesce("n_read", F.lit(0).cast("long")).alias("n_read"))
    return both.where("n_read < n_rows")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def _row_groups(files: DataFrame) -> DataFrame:
    """(file_path, n) of files (file_path): the number of row groups of each, by its footer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for part in batches for p in part.column(0).to_pylist()):
            fs, place = _opened(path)
            with pq.ParquetFile(place, filesystem=fs) as f:
                yield pa.RecordBatch.from_pydict({"file_path": pa.array([path]), "n": pa.array([f.num_row_groups], pa.int32())})

    return files.mapInArrow(run, "file_path string, n int")


def good_row_groups(files: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of damaged files (file_path), each row group tried by itself on the executors.

    rows: the columns of the DataFrame columns and file_path, of the row groups that can be decoded, checksums compared;
    failures: (file_path, first, n), the place of each other group: the number of its first row, and its rows.
    """
    groups = _row_groups(files).select("file_path", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("g")).repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file_path", "g")
    wanted = [c for c in columns.columns if c != "file_path"]
    target = to_arrow_schema(columns.select(*wanted).schema)

    def read(path: str, g: int) -> tuple[pa.Table | None, int, int]:
        fs, place = _opened(path)
        with pq.ParquetFile(place, filesystem=fs, page_checksum_verification=True) as f:
            first, n = sum(f.metadata.row_group(i).num_rows for i in range(g)), f.metadata.row_group(g).num_rows
            try:
                table = f.read_row_group(g, columns=wanted)
            except (pa.ArrowException, OSError):
                return None, first, n
        return pa.table([table.column(c).cast(target.field(c).type) for c in wanted], names=wanted), first, n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, g in zip(*(c.to_pylist() for c in part.columns), strict=True):
                table, _, _ = read(path, g)
                if table is not None:
                    for batch in table.append_column("file_path", pa.array([path] * table.num_rows, pa.string())).to_batches(max_chunksize=65_536):
                        yield batch

    def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, g in zip(*(c.to_pylist() for c in part.columns), strict=True):
                table, first, n = read(path, g)
                if table is None:
                    yield pa.RecordBatch.from_pydict({"file_path": pa.array([path]), "first": pa.array([first], pa.int64()), "n": pa.array([n], pa.int64())})

    schema = StructType([*columns.select(*wanted).schema.fields, StructField("file_path", StringType())])
    return groups.mapInArrow(rows, schema), groups.mapInArrow(failures, "file_path string, first long, n long")


def read_events(spark: SparkSession, paths: list[str], schema: str, start=None, end=None, front_month_only: bool = False, tick_size: float = 0.25, keep: tuple[str, ...] = (), recover: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, notes) of parquet files of one feed schema, [start, end) by event time, front month by file.

    All footers are read first, by one job. Files whose known columns have the same types become one scan, so the plan
    has a scan for each schema (two for a book, whose rows are fanned out), however many files there are. A file that can't
    be opened or lacks a column is noted as an error and left out. Where a page can't be decoded (checksums are
    compared, if the file has them), the rows of its split before it stay, the other files and splits are read, and an
    error tells how many rows of the file are missing. With recover, all pages are decoded once before (a job), and of the files that
    fail every row group that can be decoded is read, also behind a damaged one, with an error for each of the others
    that tells its place. keep: more columns of the events, such as a symbol.
    """
    note = lambda rows: spark.createDataFrame([(code, message, "error", None, None, source and source.rstrip("/").rpartition("/")[2]) for code, message, source in rows], NOTES + ", path string").withColumn("source", ticks.safe_source(F.col("path"))).drop("path")
    kept = [f"{c} string" for c in keep]
    none = spark.createDataFrame([], ", ".join([*kept, EVENTS]))
    kind = feed_kind(schema)
    if kind is None:
        return none, note([("unsupported_schema", "schema is not supported", None)])
    bad, groups = [], {}
    for path, fingerprint, error in file_schemas(spark, paths):
        lacks = [] if error else missing_columns([n for n, _ in json.loads(fingerprint)], kind)
        if error:
            bad.append(("invalid_record", f"could not open file: {error}", path))
        elif lacks:
            bad.append(("missing_required_column", f"missing {', '.join(lacks)}", path))
        else:
            groups.setdefault(fingerprint, []).append(path)
    notes, parts = note(bad), []
    reader = spark.read.option("ignoreCorruptFiles", "true").option("parquet.page.verify-checksum.enabled", "true")
    for group in groups.values():
        df = reader.parquet(*group)
        df = df.select(*[c for c in dict.fromkeys((*_known_names(), *keep)) if c in df.columns], "_metadata.file_path", "_metadata.file_name")
        lost = lost_rows(df.drop("file_name"))
        said = lambda message: [F.lit("invalid_record").alias("code"), message.alias("message"), F.lit("error").alias("severity"), ticks.safe_source(F.element_at(F.split("file_path", "/"), -1)).alias("source"), F.lit(None).cast("timestamp_ntz").alias("ts_event")]
        damaged = [r["file_path"] for r in lost.select("file_path").collect()] if recover else []
        if damaged:  # as many as there are damaged files
            whole = df.where(~F.col("file_path").isin(damaged))
            found, failed = good_row_groups(spark.createDataFrame([(p,) for p in damaged], "file_path string").repartition(len(damaged)), df.drop("file_name"))
            df = whole.unionByName(found.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1)))
            notes = notes.unionByName(failed.select(*said(F.concat(F.lit("rows "), F.col("first").cast("string"), F.lit(" to "), (F.col("first") + F.col("n") - 1).cast("string"), F.lit(" could not be decoded")))))
        message = F.concat((F.col("n_rows") - F.col("n_read")).cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit(" rows could not be decoded"))
        if not recover:
            notes = notes.unionByName(lost.select(*said(message)))
        df = outright(df)
        if front_month_only and "instrument_id" in df.columns:
            df = only_front_month(df, ("file_path",))
        if kind == "trade":
            good, rejected = normalize_trades(df, tick_size, "file_name", keep)
            good = typed(good, "trade", keep)
        elif kind == "book":
            good, rejected = book_events(df, tick_size, "file_name", keep)
        else:
            good, rejected = normalize_quotes(df, tick_size, "file_name", keep)
            good = typed(good, "quote", keep)
        parts.append(good)
        notes = notes.unionByName(rejected)
    events = reduce(DataFrame.unionByName, parts) if parts else none
    if start is not None:
        events = events.where(F.col("ts_event") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts_event") < F.lit(end).cast("timestamp_ntz"))
    return events, notes


def provider_events(messages: DataFrame, tick_size: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(events, notes) of JSON messages (schema, message) of a provider.

    Explicit ticks win over prices; a trade's size (or qty) must be positive; quote sizes default to 0. A message that
    can't be read, or of another schema than trades and top of book, is a provider_error.
    """
    j = lambda *names: F.coalesce(*[F.get_json_object("message", f"$.{n}") for n in names])
    at = j("ts_event", "event_ts_utc", "ts")
    price = lambda explicit, *names: F.coalesce(j(explicit).try_cast("long"), ticks.exact_ticks(j(*names), tick_size))
    whole = lambda *names: F.coalesce(j(*names).try_cast("long"), F.when(j(*names).isNull(), F.lit(0).cast("long")))
    name = F.lower("schema")
    kind = F.when(name.isin(*TRADE_SCHEMAS), "trade").when(name.isin(*TOP_SCHEMAS), "quote")
    row = messages.select(
        F.when(at.rlike(r"^-?\d+$"), ticks.from_nanos(at.try_cast("long"))).otherwise(ticks.from_iso(at)).alias("ts_event"), F.lit(0).cast("long").alias("sequence"), kind.alias("kind"),
        price("price_ticks", "price", "px").alias("price_ticks"), j("size", "qty").try_cast("long").alias("size"), F.upper(j("side")).alias("side"),
        price("bid_price_ticks", *BID[1:]).alias("bid_ticks"), price("ask_price_ticks", *ASK[1:]).alias("ask_ticks"), whole(*BID_SIZE).alias("bid_size"), whole(*ASK_SIZE).alias("ask_size"),
    )
    trade = F.col("price_ticks").isNotNull() & (F.col("size") > 0)
    quote = F.col("bid_ticks").isNotNull() & F.col("ask_ticks").isNotNull() & F.col("bid_size").isNotNull() & F.col("ask_size").isNotNull()
    fine = F.coalesce(F.col("ts_event").isNotNull() & ((F.col("kind") == "trade") & trade | (F.col("kind") == "quote") & quote), F.lit(False))
    only = lambda k, *names: {n: F.when(F.col("kind") == k, F.col(n)) for n in names}
    good = row.where(fine).withColumns(only("trade", "price_ticks", "size", "side") | only("quote", "bid_ticks", "ask_ticks", "bid_size", "ask_size"))
    return typed_columns(good), notes_of(row.where(~fine).withColumn("code", F.lit("provider_error")), "provider message could not be normalised")


def bounded(messages: DataFrame, drain: str, arrival: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(messages, notes) of a feed whose buffer holds size messages between two drains: the newest beyond that are dropped, with one note a drain that tells how many.

    Only drains that overflow are numbered: the counts of all are combined before the shuffle.
    """
    full = messages.groupBy(drain).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    over = messages.join(full.select(drain), drain, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(drain).orderBy(arrival)))
    kept = messages.join(full.select(drain), drain, "left_anti").unionByName(over.where(F.col("_k") <= size).drop("_k"))
    dropped = (F.col("_n") - size).alias("count")
    told = full.select(F.lit("backpressure_drop").alias("code"), F.concat((F.col("_n") - size).cast("string"), F.lit(" messages dropped")).alias("message"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("timestamp_ntz").alias("ts_event"), drain, dropped)
    return kept, told


def typed_columns(events: DataFrame) -> DataFrame:
    return events.select(*[c.split()[0] for c in EVENTS.split(", ")])


def latest_quotes(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The last quote of each group, by an aggregate that is combined before the shuffle."""
    rest = [c for c in quotes.columns if c not in (*by, "ts_event", "sequence")]
    return quotes.groupBy(*by).agg(F.max(F.struct("ts_event", "sequence", *rest)).alias("q")).select(*by, "q.*")
