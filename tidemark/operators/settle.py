"""Provisional, confirmed and final actual values: a state per key that any order of arrival leads to.

An observation is (key, observed_at, kind, value) with kind ``provisional`` or ``confirmed``. A key is pending until its first
observation, provisional while only provisional values are known, and final from its first confirmed value on; what
is observed later does not move it. All of this is minima and maxima over observation time, so observations may arrive late,
twice or in any order and give one result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import names

RTOL = 1e-12


def standing(observations: DataFrame, key, by_time=None, rtol: float = RTOL) -> DataFrame:
    """key..., ``state``, ``actual``, ``first_seen``, ``updated_at``, ``changes``: what holds of each observed key.

    ``by_time`` leaves out what was observed after it. Of observations at one instant a confirmed one counts after a
    provisional one, and of two alike the lesser value first. ``updated_at`` is when the value that holds took effect: an
    observation that repeats it within ``rtol`` moves neither value nor time. Null values say nothing.
    """
    key = names(key)
    o = observations.select(*key, "observed_at", "kind", F.col("value").cast("double").alias("value")).filter("value is not null and observed_at is not null")
    if by_time is not None:
        o = o.filter(F.col("observed_at") <= by_time)
    o = o.distinct().withColumn("_rank", F.when(F.col("kind") == "confirmed", 1).otherwise(0))
    at = F.struct("observed_at", "_rank", "value")
    whole = Window.partitionBy(*key)
    closing = F.min(F.when(F.col("_rank") == 1, at)).over(whole)
    o = o.withColumn("_at", at).withColumn("_close", closing).filter(F.col("_close").isNull() | (F.col("_at") <= F.col("_close")))
    before = F.lag("value").over(whole.orderBy("_at"))
    moved = before.isNull() | (F.abs(F.col("value") - before) > rtol * F.abs(before))
    g = o.withColumn("_moved", moved).groupBy(*key).agg(
        F.max("_rank").alias("_final"), F.max(F.when(F.col("_moved"), F.col("_at"))).alias("_held"), F.min("observed_at").alias("first_seen"),
        (F.sum(F.col("_moved").cast("bigint")) - 1).alias("changes"))
    return g.select(*key, F.when(F.col("_final") == 1, "final").otherwise("provisional").alias("state"), F.col("_held.value").alias("actual"), "first_seen",
                    F.col("_held.observed_at").alias("updated_at"), "changes")


def settled(forecasts: DataFrame, observations: DataFrame, key, point: str = "point", by_time=None) -> DataFrame:
    """The forecasts with their state, actual, error, absolute error over the actual, and the time of the last change."""
    s = standing(observations, key, by_time)
    j = forecasts.join(s, names(key), "left")
    error = F.col(point) - F.col("actual")
    return j.withColumns({"state": F.coalesce("state", F.lit("pending")), "error": error, "ape": F.try_divide(F.abs(error), F.abs("actual")),
                          "changes": F.coalesce("changes", F.lit(0).cast("bigint"))})
