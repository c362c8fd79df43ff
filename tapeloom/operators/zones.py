"""Zones: levels of a day that lie close together, by gaps and islands over the price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_levels(levels: DataFrame, proximity: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, trading_day, zone_id, representative_price, names, side, available_from, n_levels). A level joins the last if it is at most proximity above it, so chains may span more."""
    w = Window.partitionBy(*by, "trading_day").orderBy("price", "ordinal")
    apart = F.coalesce((F.col("price") - F.lag("price").over(w) > proximity).cast("int"), F.lit(0))
    numbered = levels.withColumn("_gap", apart).withColumn("zone_id", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    high = F.sum((F.col("side") == "HIGH").cast("int"))
    merged = numbered.groupBy(*by, "trading_day", "zone_id").agg((F.sum("price") / F.count("*")).alias("representative_price"), F.transform(F.array_sort(F.collect_list(F.struct("price", "ordinal", "name"))), lambda x: x["name"]).alias("names"), high.alias("_h"), F.count("*").alias("n_levels"), F.max("available_from").alias("available_from"))
    return merged.withColumn("side", F.when(F.col("_h") * 2 > F.col("n_levels"), "HIGH").otherwise("LOW")).drop("_h")
