"""Session calendars and month or quarter spines.

A calendar holds one row per session with an ordinal, so "n sessions ahead" is arithmetic on
the ordinal and an equality join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .frames import names


def sessions_of(bars: DataFrame, cal: str = "B1", time: str = "session") -> DataFrame:
    """Calendar of the distinct sessions; one row per day of history, so the window is bounded by days."""
    days = bars.select(F.col(time).alias("session")).distinct().withColumn("cal", F.lit(cal))
    ordinal = F.row_number().over(Window.partitionBy("cal").orderBy("session")).cast("bigint")
    return days.select("cal", "session", ordinal.alias("ordinal"))


def session_spine(bars: DataFrame, calendar: DataFrame, key="instrument", time: str = "session") -> DataFrame:
    """Every calendar session between each instrument's first and last bar (no cross join: ordinals are unrolled)."""
    key = names(key)
    days = calendar.select(F.col("session").alias(time), "ordinal")
    span = bars.join(days, time).groupBy(*key).agg(F.min("ordinal").alias("_a"), F.max("ordinal").alias("_b"))
    grid = span.select(*key, F.explode(F.sequence("_a", "_b")).alias("ordinal"))
    return grid.join(days, "ordinal").select(*key, time, "ordinal")


def session_reindex(bars: DataFrame, calendar: DataFrame, key="instrument", time: str = "session") -> DataFrame:
    """Bars on the calendar; a session without a bar stays empty and is never filled."""
    return session_spine(bars, calendar, key, time).join(bars, [*names(key), time], "left")


def nth_session(dates: DataFrame, date: str, calendar: DataFrame, n: int, out: str = "nth") -> DataFrame:
    """The n-th session strictly after each date; missing beyond the calendar."""
    here = asof_join(dates, calendar, date, "session", (), ["ordinal"], chunk_days=3650)
    target = calendar.select((F.col("ordinal") - n).alias("ordinal"), F.col("session").alias(out))
    return here.withColumn("ordinal", F.coalesce("ordinal", F.lit(0).cast("bigint"))).join(target, "ordinal", "left").drop("ordinal")


def month_spine(series: DataFrame, key="series_id", month: str = "month", value: str = "value") -> DataFrame:
    """Every month between the first and last of a series; a gap stays a gap."""
    key = names(key)
    span = series.groupBy(*key).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    grid = span.select(*key, F.explode(F.expr("sequence(_a, _b, interval 1 month)")).alias(month))
    return grid.join(series.select(*key, month, value), [*key, month], "left")


def working_days(calendar: DataFrame) -> DataFrame:
    """Sessions per month."""
    return calendar.groupBy(F.trunc("session", "MM").alias("month")).agg(F.count(F.lit(1)).alias("days"))


def quarter_ordinal(d) -> "F.Column":
    d = F.col(d) if isinstance(d, str) else d
    return (F.year(d) * 4 + F.quarter(d) - 1).cast("int")


def expected_minus_received(expected: DataFrame, received: DataFrame, key) -> DataFrame:
    return expected.join(received.select(*names(key)).distinct(), names(key), "left_anti")
