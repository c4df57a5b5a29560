"""Quote intake: completed minute bars, first value kept, conflicts aside, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partial_quotes(quotes: DataFrame) -> DataFrame:
    """Per (instrument, ts, source) the earliest arrival with its value, and the least and largest value: partial results of
    any part of the quotes, that merge to those of the whole.

    quotes: instrument, ts, source, price, arrived. Bars in the future of their arrival and non-positive prices are dropped.
    """
    ok = quotes.filter((F.col("ts") + F.expr("interval 1 minute") <= F.col("arrived")) & (F.col("price") > 0))
    return ok.groupBy("instrument", "ts", "source").agg(F.min(F.struct("arrived", "price")).alias("first"), F.min("price").alias("low"), F.max("price").alias("high"))


def merged_quotes(partial: DataFrame) -> DataFrame:
    """One row per quote: its first value by arrival, and whether another value came too."""
    g = partial.groupBy("instrument", "ts", "source").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"))
    return g.select("instrument", "ts", "source", "first.price", "first.arrived", (F.col("low") != F.col("high")).alias("conflict"), "low", "high")


def first_seen(quotes: DataFrame) -> DataFrame:
    """First value per (instrument, ts, source) by arrival, with a mark when a later arrival changed it."""
    return merged_quotes(partial_quotes(quotes)).drop("low", "high")


def freshness(quotes: DataFrame, most_seconds: int = 120, offset_hours: int = 9) -> DataFrame:
    """Age of the quote at arrival and whether it can be used: young enough and inside the local session."""
    end = F.col("ts") + F.expr("interval 1 minute")
    age = F.unix_seconds(F.col("arrived").cast("timestamp")) - F.unix_seconds(end.cast("timestamp"))
    clock = F.date_format(end + F.make_dt_interval(F.lit(0), F.lit(offset_hours)), "HH:mm:ss")
    return quotes.withColumn("age", age).withColumn("fresh", (F.col("age") <= most_seconds) & (clock > "09:00:00") & (clock <= "15:30:00"))
