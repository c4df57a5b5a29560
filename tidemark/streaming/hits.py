"""Visit counting on a stream: deduplication with per-key state, daily windows, running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.traffic import countable, with_day

COUNTED = "visitor string, page string, day date, ts timestamp, event_id bigint"


def _count(minutes: int):
    span = pd.Timedelta(minutes=minutes)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kept = []
        for ts, event in zip(rows["ts"], rows["event_id"]):
            if last is None or ts - last >= span:
                kept.append((*key, ts, event))
                last = ts
        state.update((last.to_pydatetime(),))
        # The key carries its day, so the state can go once the watermark passes the next midnight.
        state.setTimeoutTimestamp(int((pd.Timestamp(key[2]) + pd.Timedelta(days=1)).value // 1_000_000) + 1)
        yield pd.DataFrame(kept, columns=["visitor", "page", "day", "ts", "event_id"])

    return step


def count_visits(hits: DataFrame, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Counted visits of a hit stream; one timestamp of state per (visitor, page, day)."""
    h = with_day(countable(hits)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return h.select("visitor", "page", "day", "ts", "event_id").groupBy("visitor", "page", "day").applyInPandasWithState(
        _count(minutes), COUNTED, "last timestamp", "append", GroupStateTimeout.EventTimeTimeout)


_STATE = "last long, ts array<long>, ids array<long>"


def _in_order(minutes: int):
    span = minutes * 60_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ts, ids = state.get if state.exists else (None, [], [])
        waiting = list(zip(ts, ids))
        for rows in batches:
            waiting += zip((rows["ts"].astype("int64") // 1000 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist())
        waiting.sort()
        known = state.getCurrentWatermarkMs() * 1000
        done = sum(at <= known for at, _ in waiting)
        kept = []
        for at, event in waiting[:done]:
            if last is None or at - last >= span:
                kept.append((*key, pd.Timestamp(at, unit="us"), event))
                last = at
        waiting = waiting[done:]
        midnight = (pd.Timestamp(key[2]) + pd.Timedelta(days=1)).value // 1_000_000
        if not waiting and known // 1000 >= midnight:
            state.remove()
        else:
            state.update((last, [a for a, _ in waiting], [i for _, i in waiting]))
            # Woken once the watermark has passed the first hit that waits, or the day.
            state.setTimeoutTimestamp(max((waiting[0][0] // 1000 if waiting else midnight) + 1, known // 1000 + 1))
        if kept:
            yield pd.DataFrame(kept, columns=["visitor", "page", "day", "ts", "event_id"])

    return step


def count_visits_in_order(hits: DataFrame, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """Counted visits in event order, whatever order hits arrive in within ``late``.

    Hits wait in the state of their (visitor, page, day) until the watermark has passed them; then no earlier one can come,
    and they are walked as the batch walks them. A timer on the first waiting hit wakes the key. The state holds the last
    counted instant and the hits of the last ``late``, and goes with the day.
    """
    h = with_day(countable(hits)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return h.select("visitor", "page", "day", "ts", "event_id").groupBy("visitor", "page", "day").applyInPandasWithState(
        _in_order(minutes), COUNTED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def daily_views(hits: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Views and approximate visitors per day window and page."""
    h = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return h.groupBy(F.window("ts", "1 day"), "page").agg(
        F.count(F.lit(1)).alias("views"), F.approx_count_distinct("visitor").alias("visitors"))


def first_quotes(quotes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """First value per (instrument, ts, source) on a stream."""
    return quotes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["instrument", "ts", "source"])
