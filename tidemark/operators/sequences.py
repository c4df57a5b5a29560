"""Fixed-length windows of bars as model input, with one reason for every day that gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import KEY, TIME, causal_channels
from .calendar import session_reindex
from .frames import prev, ratio, rows, series

CHANNELS = ["close_ret", "open_gap", "high_rel", "low_rel", "volume_rel"]


def build_sequences(bars: DataFrame, calendar: DataFrame, lookback: int = 60, horizon: int = 5, volume_window: int = 20, jump: float = 0.3,
                    publish_hour: int = 16, predict_hour: int = 7) -> DataFrame:
    """``window`` array<array<double>> (lookback x 5) and target close[d+h-1]/close[d-1]-1 per session.

    Reasons in order: insufficient_history, pending_target, missing_bar, corporate_action, unavailable_input,
    zero_volume_mean. A window holds a fixed number of rows of one series.
    """
    g = session_reindex(bars, calendar)
    span = g.groupBy(KEY).agg(F.min("ordinal").alias("_a"), F.max("ordinal").alias("_b"))
    pc = prev("close", KEY, TIME)
    o, c = ratio("open", pc), ratio("close", pc)
    own = bars.withColumn("_act", F.coalesce(((o <= 1 - jump) & (c <= 1 - jump)) | ((o >= 1 / (1 - jump)) & (c >= 1 / (1 - jump))), F.lit(False)))
    g = g.join(own.select(KEY, TIME, "_act"), [KEY, TIME], "left").join(causal_channels(g, volume_window), [KEY, TIME]).join(span, KEY)
    back = lookback + volume_window
    whole = rows(KEY, "ordinal", -back, horizon - 1)
    past = rows(KEY, "ordinal", -lookback, -1)
    vm = F.avg("volume").over(rows(KEY, "ordinal", -volume_window, -1))
    g = g.withColumn("_vm", vm)
    inputs_end = F.max(TIME).over(rows(KEY, "ordinal", -back, -1))
    # The last input is published in the afternoon of its session; the forecast is made in the morning of the row.
    late = inputs_end.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(publish_hour)) >= F.col(TIME).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(predict_hour))
    w = series(KEY, "ordinal")
    target = ratio(F.lead("close", horizon - 1).over(w), F.lag("close").over(w)) - 1
    reason = (
        F.when(F.col("ordinal") - back < F.col("_a"), "insufficient_history")
        .when(F.col("ordinal") + horizon - 1 > F.col("_b"), "pending_target")
        .when(F.count("close").over(whole) < back + horizon, "missing_bar")
        .when(F.max(F.coalesce("_act", F.lit(False))).over(whole), "corporate_action")
        .when(late, "unavailable_input")
        .when(F.min("_vm").over(past) == 0, "zero_volume_mean")
        .otherwise("")
    )
    f = g.select(KEY, F.col(TIME).alias("prediction_date"), reason.alias("reason"), F.collect_list(F.array(*CHANNELS)).over(past).alias("_w"), target.alias("_y"),
                 F.lag("close").over(w).alias("current_close"), F.lead(TIME, horizon - 1).over(w).alias("target_date"))
    keep = F.col("reason") == ""
    return f.select(KEY, "prediction_date", "target_date", "current_close", "reason", F.when(keep, F.col("_w")).alias("window"), F.when(keep, F.col("_y")).alias("y"))


def flat(df: DataFrame) -> DataFrame:
    """Windows as one flat vector per row."""
    return df.withColumn("features", F.flatten("window"))
