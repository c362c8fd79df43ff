"""Files of a feed: damaged ones lose nothing in silence, and the plan has a scan for each schema."""

from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapeloom.sources import market
from tapeloom.sources.tape import damaged_copy, tape_book, tape_events

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_damaged_file_is_noted(spark, tmp_path):
    trades = tape_events(spark, "/root/testdata/sf0.01").drop("price_ticks")
    trades.coalesce(1).write.option("parquet.block.size", 40_000).parquet(f"{tmp_path}/whole")
    trades.limit(50).coalesce(1).write.parquet(f"{tmp_path}/sound")
    n = trades.count()
    damaged_copy(spark, spark.read.parquet(f"{tmp_path}/whole").inputFiles()[0], f"{tmp_path}/bad/part.parquet")
    events, notes = market.read_events(spark, [f"{tmp_path}/bad", f"{tmp_path}/sound"], "trades")
    left = events.count() - 50
    told = notes.collect()
    assert 0 <= left < n
    assert [(r.code, r.severity, r.source, r.message) for r in told] == [("invalid_record", "error", "part.parquet", f"{n - left} of {n} rows could not be decoded")]
    events, notes = market.read_events(spark, [f"{tmp_path}/whole", f"{tmp_path}/sound"], "trades")
    assert events.count() == n + 50 and notes.count() == 0


def test_a_scan_for_each_schema(spark, tmp_path):
    """500 files of two schemas give two scans, with the columns that are needed alone."""
    trades = tape_events(spark, SF).drop("price_ticks").withColumn("extra", F.lit("x")).cache()
    trades.repartition(250).write.parquet(f"{tmp_path}/a")
    trades.withColumn("size", F.col("size").cast("int")).repartition(250).write.parquet(f"{tmp_path}/b")
    files = [f for x in ("a", "b") for f in spark.read.parquet(f"{tmp_path}/{x}").inputFiles()]
    assert len(files) == 500
    events, _ = market.read_events(spark, files, "trades")
    assert plan_of(events).count(" parquet") == 2, plan_of(events)
    scans = [line for line in events._jdf.queryExecution().sparkPlan().toString().splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("extra" not in line for line in scans)
    assert events.count() == 2 * trades.count()


def test_front_month_by_file_in_one_scan(spark, tmp_path):
    book = tape_book(spark, SF).drop("price_ticks")
    book.where("sequence % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/a")
    # In the second file the other instrument trades most.
    book.where("sequence % 2 = 1 and instrument_id = 1").limit(3).unionByName(book.where("sequence % 2 = 1 and instrument_id = 2")).coalesce(1).write.parquet(f"{tmp_path}/b")
    got = market.read_events(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], "mbp-10", front_month_only=True)[0].where("kind = 'quote'")
    one = market.only_front_month(market.outright(book.where("sequence % 2 = 0"))).select("sequence")
    two = book.where("sequence % 2 = 1 and instrument_id = 2").select("sequence")
    assert sorted(r.sequence for r in got.collect()) == sorted(r.sequence for r in one.union(two).collect())


def test_paths_that_cannot_be_opened(spark, tmp_path):
    (tmp_path / "text.parquet").write_text("no parquet")
    (tmp_path / "empty").mkdir()
    tape_events(spark, SF).drop("price_ticks").coalesce(1).write.parquet(f"{tmp_path}/good")
    events, notes = market.read_events(spark, [f"file://{tmp_path}/good", f"{tmp_path}/text.parquet", f"{tmp_path}/empty", "nostore://x/y"], "trades", start=datetime(2024, 1, 1))
    assert {(r.code, r.source) for r in notes.collect()} == {("invalid_record", "text.parquet"), ("invalid_record", "empty"), ("invalid_record", "y")}
    assert notes.count() == 3 and events.count() == tape_events(spark, SF).count()


@pytest.mark.parametrize("paths", [[], ["/nowhere"]])
def test_no_files(spark, paths):
    events, notes = market.read_events(spark, paths, "trades")
    assert events.count() == 0 and notes.count() == len(paths)


def test_row_groups_behind_a_damaged_one(spark, tmp_path):
    """With recover, only the damaged row groups are missing, and each is noted with its place."""
    trades = tape_events(spark, "/root/testdata/sf0.01").drop("price_ticks").withColumn("symbol", F.lit("AA"))
    table = pa.Table.from_pandas(trades.orderBy("sequence").toPandas())
    pq.write_table(table, f"{tmp_path}/odd.parquet", row_group_size=1000, coerce_timestamps="us", use_dictionary=False, write_page_checksum=True)
    pq.write_table(table.slice(0, 100), f"{tmp_path}/sound.parquet", coerce_timestamps="us")
    meta = pq.read_metadata(f"{tmp_path}/odd.parquet")
    block = bytearray((tmp_path / "odd.parquet").read_bytes())
    for g in (2, 7):
        column = meta.row_group(g).column(meta.schema.names.index("price"))
        at = (column.dictionary_page_offset or column.data_page_offset) + column.total_compressed_size // 2
        block[at : at + 40] = b"\xff" * 40
    (tmp_path / "odd.parquet").write_bytes(block)
    events, notes = market.read_events(spark, [f"{tmp_path}/odd.parquet", f"{tmp_path}/sound.parquet"], "trades", keep=("symbol",), recover=True)
    want = sorted([i for i in range(table.num_rows) if i // 1000 not in (2, 7)] + list(range(100)))
    number = {s: i for i, s in enumerate(table.column("sequence").to_pylist())}
    got = events.select("symbol", "sequence").collect()
    assert sorted(number[r.sequence] for r in got) == want and {r.symbol for r in got} == {"AA"}
    assert {(r.code, r.source, r.message) for r in notes.collect()} == {("invalid_record", "odd.parquet", f"rows {g}000 to {g}999 could not be decoded") for g in (2, 7)}
    plain, told = market.read_events(spark, [f"{tmp_path}/odd.parquet"], "trades")
    assert told.count() == 1 and plain.count() < table.num_rows - 2000
