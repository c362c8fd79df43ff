"""Every query with SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert rows(__spark_entry__.queries()[name](spark, SF).toPandas()) == rows(duck.execute(__spark_entry__.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_invariants(spark):
    from tapeloom.config import EASTERN
    from tapeloom.operators import bars
    from tapeloom.sources.tape import tape_lineitem

    tape = tape_lineitem(spark, SF)
    b = bars.tick_bars(tape, (3, 20), EASTERN).toPandas()
    assert (b.groupby("timeframe_ticks").trade_count.sum() == tape.count()).all()
    partial = b[~b.is_complete].groupby(["timeframe_ticks", "trading_day"]).size()
    assert partial.max() == 1 and ((b.high_ticks >= b.open_ticks) & (b.low_ticks <= b.close_ticks)).all()
