"""Joins of dates, events, filings and headlines to sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .asof import asof_join
from .frames import nxt, prev, ratio
from .joins import range_join


def next_calendar_date(dates: DataFrame, date: str, calendar: DataFrame, out: str = "next_session", chunk_days: int = 365) -> DataFrame:
    """First calendar session strictly after each date."""
    c = calendar.select(F.col("session").alias(out))
    return asof_join(dates, c, date, out, (), [out], strict=True, forward=True, chunk_days=chunk_days)


def attach_shared(panel: DataFrame, date: str, calendar: DataFrame, shared: DataFrame) -> DataFrame:
    """Give every instrument the shared features of the next calendar session after its row."""
    days = next_calendar_date(panel.select(date).distinct(), date, calendar)
    return panel.join(days, date).join(shared.withColumnRenamed("session", "next_session"), "next_session", "left")


def events_before(sessions: DataFrame, events: DataFrame, back: int = 4, out: str = "labels") -> DataFrame:
    """Labels of events in the ``back`` days before each session, without the session itself."""
    spans = events.select(F.date_add("date", 1).alias("_a"), F.date_add("date", back).alias("_b"), "label").distinct()
    hit = range_join(sessions.select("session").distinct(), spans, "session", "_a", "_b", bucket_days=back * 2)
    labels = hit.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias(out))
    return sessions.join(labels, "session", "left").withColumn(out, F.coalesce(out, F.lit("")))


def events_ahead(sessions: DataFrame, events: DataFrame, ahead: int = 10) -> DataFrame:
    """Events on the session's day or in the next ``ahead`` days."""
    spans = events.select(F.date_sub("date", ahead).alias("_a"), F.col("date").alias("event_date"), "label")
    return range_join(sessions.select("session").distinct(), spans, "session", "_a", "event_date", bucket_days=ahead * 2).drop("_a")


def periods_on(sessions: DataFrame, periods: DataFrame, by=()) -> DataFrame:
    """Sessions inside [start, end] of a filing period."""
    return range_join(sessions, periods, "session", "start", "end", by=by, bucket_days=60)


def open_periods(sessions: DataFrame, periods: DataFrame) -> DataFrame:
    """Per session with an open period [start, end]: how many, their amount, and the smallest filing.

    Periods fold to one row per pair of days before they are spread over the days between, so what is spread is bounded
    by the calendar and not by the filings.
    """
    spans = periods.groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"), F.min("filing").alias("first_filing"))
    days = spans.filter(F.col("start") <= F.col("end")).withColumn("session", F.explode(F.sequence("start", "end")))
    return days.groupBy("session").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.min("first_filing").alias("first_filing")).join(
        sessions.select("session"), "session")


def period_transition(flows: DataFrame, periods: DataFrame, calendar: DataFrame, windows=(5, 20)) -> DataFrame:
    """Net flow over the last n sessions of a period and the first n sessions after it, complete windows only."""
    w = Window.partitionBy("instrument").orderBy("ordinal")
    f = flows.join(calendar.select("session", "ordinal"), "session")
    newest = calendar.agg(F.max("session")).scalar()
    follows = F.lead("session").over(Window.orderBy("session"))  # the calendar: one row a session
    spans = calendar.select("ordinal", "session", F.coalesce(F.date_sub(follows, 1), F.col("session")).alias("_until"))
    days = spans.select("ordinal", F.explode(F.sequence("session", "_until")).alias("_day"))
    ends = periods.withColumn("_day", F.least("end", newest)).join(days, "_day").drop("_day").withColumnRenamed("ordinal", "_e")
    for n in windows:
        # A window is complete when its n rows span exactly n ordinals.
        back, ahead = w.rowsBetween(-(n - 1), 0), w.rowsBetween(1, n)
        f = f.withColumn(f"b{n}", F.when(F.col("ordinal") - F.min("ordinal").over(back) == n - 1, F.sum("foreign_net").over(back)))
        f = f.withColumn(f"a{n}", F.when(F.max("ordinal").over(ahead) - F.col("ordinal") == n, F.sum("foreign_net").over(ahead)))
    return ends.join(f.select("instrument", F.col("ordinal").alias("_e"), *[f"{s}{n}" for n in windows for s in "ba"]), "_e").drop("_e")


def news_in_window(events: DataFrame, headlines: DataFrame, name: str, relevant, noise, before=90, after=15, limit=5) -> DataFrame:
    """Headlines around each event (event_id, ts), best scored first; a tie goes to the earlier, then the smaller id.

    Of headlines of one time only the best ``limit`` can be among the best of a window, and events of one time share
    their window; so windows meet headlines by distinct times, and an event meets no more than its own result. Rows that
    share an event_id are ranked together.
    """
    minutes = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    order = (F.col("score").desc(), "time", "doc_id")
    best = lambda rows, key: rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= limit)
    scored = best(headlines.select("doc_id", "time", text.term_score(F.col("title"), name, relevant, noise).alias("score")), "time").drop("rank")
    spans = events.select("ts").distinct().select("ts", (F.col("ts") - minutes(before)).alias("_a"), (F.col("ts") + minutes(after)).alias("_b"))
    windows = best(range_join(scored, spans, "time", "_a", "_b", bucket_days=1 / 12).select("ts", "doc_id", "time", "score"), "ts")
    counted = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"), F.min("ts").alias("ts"))
    again = counted.filter("_n > 1").select(F.col("event_id").alias("_id"))
    shared = events.join(again, F.col("event_id").eqNullSafe(F.col("_id")), "left_semi").join(windows.drop("rank"), "ts")
    columns = ["event_id", "rank", "doc_id", "time", "score"]
    return counted.filter("_n = 1").join(windows, "ts").select(*columns).unionByName(best(shared, "event_id").select(*columns))


def first_in_window(quarters: DataFrame, filings: DataFrame, today, lo: int = 1, hi: int = 45) -> DataFrame:
    """First filing lo..hi days after each quarter end; empty once the window closed, else open."""
    spans = quarters.select("quarter_end", F.date_add("quarter_end", lo).alias("_a"), F.date_add("quarter_end", hi).alias("_b"))
    hit = range_join(filings.select("date"), spans, "date", "_a", "_b", bucket_days=60).groupBy("quarter_end").agg(F.min("date").alias("first_filing"))
    state = F.when(F.col("first_filing").isNotNull(), "found").when(F.date_add("quarter_end", hi) < today, "none").otherwise("open")
    return quarters.join(hit, "quarter_end", "left").withColumn("status", state)


def attribution_summary(contributions: DataFrame, scored: DataFrame) -> DataFrame:
    """Over correct forecasts: how often each feature appears, tops, and its mean share of the absolute contributions.

    contributions: run_id, model, instrument, prediction_date, feature, contribution.
    """
    key = ["run_id", "model", "instrument", "prediction_date"]
    c = contributions.groupBy(*key, "feature").agg(F.max(F.abs("contribution")).alias("c"))
    w = Window.partitionBy(*key)
    c = c.withColumn("share", ratio("c", F.sum("c").over(w))).withColumn("top", F.col("c") == F.max("c").over(w))
    right = scored.filter("status = 'scored' and direction_correct = 1").select(*key)
    return c.join(right, key, "left_semi").groupBy("model", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("top").cast("bigint")).alias("n_top"), F.avg("share").alias("mean_share"))


def spread_pairs(series: DataFrame, a: str, b: str, sid="series_id", month="month", value="value") -> DataFrame:
    """Difference of two series on the months both have, with its change from the adjacent month."""
    both = series.filter(F.col(sid).isin(a, b)).groupBy(month).agg(
        F.max(F.when(F.col(sid) == a, F.col(value))).alias("va"), F.max(F.when(F.col(sid) == b, F.col(value))).alias("vb")).dropna()
    both = both.select(F.lit(f"{a}-{b}").alias("pair"), month, (F.col("va") - F.col("vb")).alias("spread"))
    adjacent = prev(month, "pair", month) == F.add_months(month, -1)
    return both.withColumn("change", F.when(adjacent, F.col("spread") - prev("spread", "pair", month)))


def event_reactions(bars: DataFrame, events: DataFrame, least: int = 8) -> DataFrame:
    """Same-day, prior 20-session and next 5-session returns at event sessions, counted by the sign of the prior."""
    K, T = "instrument", "session"
    f = bars.select(K, T, (ratio("close", prev("close", K, T)) - 1).alias("ret"),
                    (ratio(prev("close", K, T), prev("close", K, T, 21)) - 1).alias("prior20"),
                    (ratio(nxt("close", K, T, 5), "close") - 1).alias("next5"))
    f = f.join(events.select(F.col("date").alias(T)).distinct(), T, "left_semi").filter("prior20 is not null")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    up, down = F.col("prior20") > 0, F.col("prior20") <= 0
    return f.groupBy(K).agg(
        F.count(F.lit(1)).alias("n"), n(F.col("ret") < 0).alias("down"), F.avg("ret").alias("mean_ret"),
        n(up).alias("prior_up_n"), n(up & (F.col("ret") < 0)).alias("prior_up_down"),
        n(down).alias("prior_down_n"), n(down & (F.col("ret") < 0)).alias("prior_down_down"),
        n(down & F.col("next5").isNotNull()).alias("prior_down_next5_n"), n(down & (F.col("next5") > 0)).alias("prior_down_next5_up"),
    ).filter(F.col("n") >= least)


def group_gap_stats(bars: DataFrame, marks: DataFrame) -> DataFrame:
    """Mean and median absolute moves on event days and others, per definition of event day.

    ``marks``: definition, session. Every bar is counted under every definition.
    """
    K, T = "instrument", "session"
    pc = prev("close", K, T)
    f = bars.select(K, T, F.abs(ratio("open", pc) - 1).alias("abs_gap"), F.abs(ratio("close", pc) - 1).alias("abs_move"),
                    F.abs(ratio("close", "open") - 1).alias("abs_intraday")).dropna()
    tags = marks.groupBy(T).agg(F.collect_set("definition").alias("defs"))
    f = f.join(tags, T, "left").withColumn("definition", F.explode(F.array(F.lit("next"), F.lit("flagged"))))
    f = f.withColumn("is_event", F.coalesce(F.array_contains("defs", F.col("definition")), F.lit(False)))
    aggs = []
    for c in ("abs_gap", "abs_move", "abs_intraday"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median")]
    return f.groupBy(K, "definition", "is_event").agg(F.count(F.lit(1)).alias("n"), *aggs)
