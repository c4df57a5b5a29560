"""Intraday bars: turning points, after-hours moves, returns up to a cut-off, session timelines.

One (instrument, session) holds at most 288 five-minute bars, so arrays per session are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .frames import ratio

SPAN = ["instrument", "session"]


def session_profile(bars: DataFrame) -> DataFrame:
    """Bar return inside the session, cumulative move from the open, robust scale and volume median."""
    w = Window.partitionBy(*SPAN).orderBy("ts")
    f = bars.withColumn("i", F.row_number().over(w)).withColumn(
        "ret", F.coalesce(ratio("close", F.lag("close").over(w)) - 1, F.lit(0.0)))
    whole = f.groupBy(*SPAN).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("ret", F.lit(0.5)).alias("mid"), F.stddev_pop("ret").alias("dev"),
        F.percentile(F.when(F.col("volume") > 0, F.col("volume")), F.lit(0.5)).alias("vol_mid"),
        F.min_by("open", "ts").alias("first_open"), F.max_by("close", "ts").alias("last_close"))
    f = f.join(whole, SPAN)
    mad = f.groupBy(*SPAN).agg(F.percentile(F.abs(F.col("ret") - F.col("mid")), F.lit(0.5)).alias("mad"))
    return f.join(mad, SPAN).withColumn(
        "sigma", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("dev") > 0, F.col("dev")).otherwise(1e-9))


def detect_events(bars: DataFrame, z_min: float, spike: float, merge_minutes: int, most: int) -> DataFrame:
    """Bars that moved the session: large against the robust scale, or traded heavily; near ones merged by score."""
    w = Window.partitionBy(*SPAN).orderBy("ts")
    f = session_profile(bars).filter("n >= 12").withColumn("cum", ratio("close", "first_open") - 1).withColumn(
        "cum_before", F.coalesce(F.lag("cum").over(w), F.lit(0.0)))
    f = f.withColumn("z", F.abs("ret") / F.col("sigma")).withColumn("vr", F.coalesce(ratio("volume", "vol_mid"), F.lit(0.0)))
    f = f.withColumn("move", ratio("last_close", "first_open") - 1)
    heavy = (F.col("vr") >= spike) & (F.col("i") > 1) & (F.col("z") >= 1)
    c = f.filter((F.col("z") >= z_min) | heavy)
    score = F.col("z") + F.when(F.col("vr") >= spike, 1.0).otherwise(0.0) + F.least("vr", F.lit(5.0)) / 5
    item = F.struct(
        (-F.round(score, 9)).alias("order"), F.col("ts"), F.col("ret"), F.col("z"), F.col("vr"), F.col("cum_before"), F.col("cum"),
        F.when(F.abs("move") > 1e-9, ratio("ret", "move")).alias("share"))
    per = c.select(*SPAN, item.alias("e")).groupBy(*SPAN).agg(F.array_sort(F.collect_list("e")).alias("es"))
    typ = per.schema["es"].dataType
    near = lambda a, b: F.abs(F.unix_seconds(a["ts"].cast("timestamp")) - F.unix_seconds(b["ts"].cast("timestamp"))) <= merge_minutes * 60
    kept = F.aggregate("es", F.slice("es", 1, 0).cast(typ), lambda acc, e: F.when(
        (F.size(acc) >= most) | F.exists(acc, lambda k: near(k, e)), acc).otherwise(F.concat(acc, F.array(e))))
    return per.select(*SPAN, F.explode(kept).alias("e")).select(
        *SPAN, "e.ts", "e.ret", F.round("e.z", 2).alias("z"), F.round("e.vr", 2).alias("volume_ratio"), "e.cum_before",
        F.col("e.cum").alias("cum_after"), F.col("e.share").alias("session_share"), (-F.col("e.order")).alias("score"))


def after_hours_move(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Per day cut at midnight UTC: the last regular close before it and the moves after that close.

    A day without regular bars continues the previous one. The window runs on one row per day.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), "ts")
    clock = F.date_format(local, "HH:mm")
    f = bars.withColumn("day", F.col("ts").cast("date")).withColumn("regular", (clock >= "09:30") & (clock < "16:00"))
    w = Window.partitionBy("instrument", "day")
    f = f.withColumn("reg_end", F.max(F.when(F.col("regular"), F.col("ts"))).over(w))
    after = F.col("reg_end").isNull() | (F.col("ts") > F.col("reg_end"))
    only = lambda x: F.when(after, F.col(x))
    d = f.groupBy("instrument", "day").agg(
        F.max_by("close", F.when(F.col("regular"), F.col("ts"))).alias("reg"),
        F.max("reg_end").alias("reg_end"), F.min(only("close")).alias("lo"), F.max(only("close")).alias("hi"),
        F.max_by(only("close"), only("ts")).alias("end"), F.max(only("ts")).alias("end_ts"))
    d = d.withColumn("reg", F.when(F.col("reg_end").isNotNull(), F.col("reg")))
    by = Window.partitionBy("instrument").orderBy("day")
    d = d.withColumn("island", F.count("reg").over(by))
    run = Window.partitionBy("instrument", "island").orderBy("day")
    g = d.select(
        "instrument", F.date_add("day", 1).alias("session"), F.first("reg").over(run).alias("regular_close"),
        F.last("end", True).over(run).alias("last"), F.min("lo").over(run).alias("lo"), F.max("hi").over(run).alias("hi"),
        F.last("end_ts", True).over(run).alias("last_time")).filter("regular_close > 0 and last is not null")
    rel = lambda x: ratio(x, "regular_close") - 1
    return g.select("instrument", "session", "regular_close", "last", rel("last").alias("ret"), rel("lo").alias("low_ret"),
                    rel("hi").alias("high_ret"), "last_time")


def cutoff_returns(hourly: DataFrame, cutoffs: DataFrame, sessions_back: int = 1, zone: str = "America/New_York", settle_hour: int = 17):
    """Last bar finished by the cut-off against the k-th previous regular close; a straddling bar is never used.

    ``cutoffs``: instrument, session, cutoff (UTC).
    """
    local = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), c)
    h = hourly.withColumn("bar_end", F.col("ts") + F.expr("interval 1 hour"))
    now = asof_join(cutoffs, h.select("instrument", "bar_end", F.col("close").alias("now_close"), F.col("ts").alias("now_ts")),
                    "cutoff", "bar_end", "instrument", ["now_close", "now_ts"], chunk_days=7)
    reg = (
        h.withColumn("l", local(F.col("ts"))).filter(F.hour("l") < settle_hour)
        .groupBy("instrument", F.col("l").cast("date").alias("reg_day"))
        .agg(F.max_by("close", "ts").alias("reg_close"), F.max("ts").alias("reg_ts"))
    )
    reg = reg.withColumn("ord", F.row_number().over(Window.partitionBy("instrument").orderBy("reg_day")))
    now = now.withColumn("cut_day", local(F.col("cutoff")).cast("date"))
    at = asof_join(now, reg, "cut_day", "reg_day", "instrument", ["ord"], strict=True, chunk_days=90)
    ref = reg.select("instrument", F.col("ord").alias("ref_ord"), "reg_close", "reg_ts")
    j = at.withColumn("ref_ord", F.col("ord") - (sessions_back - 1)).join(ref, ["instrument", "ref_ord"], "left")
    value = F.when(F.col("now_ts") > F.col("reg_ts"), ratio("now_close", "reg_close") - 1)
    return j.select("instrument", "session", "cutoff", value.alias("ret"))


def timeline_points(bars: DataFrame, offset_hours: int = 9) -> DataFrame:
    """Local session path between 09:00 and 15:30: positive prices, last per stamp, as one ordered array per session."""
    local = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(offset_hours))
    f = bars.withColumn("local", local).withColumn("clock", F.date_format("local", "HH:mm"))
    f = f.filter((F.col("close") > 0) & F.col("clock").between("09:00", "15:30"))
    f = f.withColumn("session", F.col("local").cast("date"))
    return f.groupBy(*SPAN).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("clock", "close"))),
                                 lambda p: F.concat(p["clock"], F.lit("="), F.format_string("%.2f", p["close"]))), ";").alias("points"))


def event_rows(bars: DataFrame, move: float, volume: float) -> DataFrame:
    """One bar to as many event rows as rules it meets: a large move, heavy volume, no move."""
    w = Window.partitionBy(*SPAN).orderBy("ts")
    f = bars.withColumn("ret", ratio("close", F.lag("close").over(w)) - 1)
    rules = F.array(
        F.when(F.abs("ret") > move, F.struct(F.lit("move").alias("kind"), F.col("ret").alias("value"))),
        F.when(F.col("volume") > volume, F.struct(F.lit("volume").alias("kind"), F.col("volume").alias("value"))),
        F.when(F.col("ret") == 0, F.struct(F.lit("flat").alias("kind"), F.lit(0.0).alias("value"))))
    return f.select(*SPAN, "ts", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("e")).select(*SPAN, "ts", "e.*")
