"""Features that follow an as-of join, and interval-width paths over matured scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_backward, asof_join
from .frames import names, prev, ratio, rows


def align_before(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by, values, tolerance_days: int = 6):
    """Last right row strictly before each left date, at most ``tolerance_days`` old."""
    return asof_join(left, right, left_time, right_time, by, values, strict=True, tolerance_days=tolerance_days)


def asof_cumulative(grid: DataFrame, levels: DataFrame, by, time: str, value: str, lag_days=1, tolerance_days=7):
    """Change of the as-of level since the previous grid row, whether a new source session arrived, and its age."""
    j = asof_backward(grid, levels, time, time, by, value, lag_days=lag_days, tolerance_days=tolerance_days)
    fresh = ~F.col("source_date").eqNullSafe(prev("source_date", by, time))
    return j.select(
        *names(by), time, (ratio(value, prev(value, by, time)) - 1).alias("cum_ret"),
        F.when(F.col("source_date").isNotNull(), fresh.cast("int")).alias("new_session"),
        F.datediff(time, "source_date").cast("bigint").alias("age_days"))


def evening_frame(features: DataFrame, classes: dict, by="instrument", time="session") -> DataFrame:
    """Features as an evening run sees them: home columns of the row, overseas columns of the row before.

    ``classes``: output -> ("home", column) | ("overseas", column) | ("cross", (overseas column, home column)).
    """
    out = []
    for name, (kind, source) in classes.items():
        if kind == "home":
            out.append(F.col(source).alias(name))
        elif kind == "overseas":
            out.append(prev(source, by, time).alias(name))
        elif kind == "cross":
            out.append((prev(source[0], by, time) - F.col(source[1])).alias(name))
        else:
            raise ValueError(f"unknown session class: {kind}")
    return features.select(*names(by), time, *out)


def matured_scores(scores: DataFrame, by, made="made", matures="matures", score="score") -> DataFrame:
    """Row number of each forecast and how many earlier forecasts had matured before it was made.

    A series holds one row per session, so its score list is bounded by the calendar.
    """
    by = names(by)
    ranked = scores.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(made, matures)))
    known = ranked.select(*by, F.col(matures).alias("_m"), F.col("pos").alias("matured"))
    return asof_join(ranked, known, made, "_m", by, ["matured"], strict=True, chunk_days=365).withColumn(
        "matured", F.coalesce("matured", F.lit(0)))


CHUNK = 1000


def trailing_q(scores: DataFrame, by, windows=(250, 500), coverage=0.8, least=100, made="made", matures="matures", score="score"):
    """Per row, window and rule the width factor from the last matured scores: linear quantile and ranked score."""
    by = names(by)
    ranked = matured_scores(scores, by, made, matures, score)
    ends = ranked.select(*by, "matured").distinct().filter(F.col("matured") >= least)
    # The frame ending at row "matured" holds exactly the scores known then. Frames are short, so a series is cut into
    # chunks that also carry the rows a frame may reach back to, and the chunks run side by side.
    reach = max(windows) - 1
    home = F.floor((F.col("pos") - 1) / CHUNK)
    copies = F.array(F.struct(home.alias("c"), F.lit(True).alias("own")),
                     F.when((home + 1) * CHUNK - F.col("pos") < reach, F.struct((home + 1).alias("c"), F.lit(False).alias("own"))))
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = ranked.select(*by, "pos", score, F.explode(F.filter(copies, lambda x: x.isNotNull())).alias("_k")).select(
        *by, "pos", score, "_k.c", "_k.own").repartition(tasks, *by, "c")
    for n in windows:
        frame = rows([*by, "c"], "pos", -(n - 1), 0)
        stats = stats.withColumn(f"_a{n}", F.array_sort(F.collect_list(score).over(frame)))
    stats = stats.filter("own")
    for n in windows:
        size, cell = F.size(f"_a{n}"), lambda i, n=n: F.get(f"_a{n}", i.cast("int"))
        at = F.lit(coverage) * (size - 1)
        low = F.floor(at)
        linear = cell(low) + (cell(F.ceil(at)) - cell(low)) * (at - low)
        rank = F.least(F.ceil((size + 1) * coverage - 1e-12), size)
        stats = stats.withColumns({f"quantile_{n}": linear, f"conformal_{n}": cell(rank - 1)})
    qs = stats.select(*by, F.col("pos").alias("matured"), *[f"{r}_{n}" for n in windows for r in ("quantile", "conformal")])
    known = qs.join(ends, [*by, "matured"], "left_semi")
    return ranked.join(known, [*by, "matured"], "left")


def _quantile(values, share):
    """Linear quantile of a sorted array at a share that may leave [0, 1]: its greatest value above, 0 below."""
    at = share * (F.size(values) - 1)
    low = F.floor(at).cast("int")
    cell = lambda i: F.get(values, i)
    linear = cell(low) + F.coalesce(cell(low + 1) - cell(low), F.lit(0.0)) * (at - low)
    return F.when(share >= 1, F.element_at(values, -1)).when(share <= 0, F.lit(0.0)).otherwise(linear)


def _next_level(coverage: float, gamma: float):
    """Fold step: the path with the level after one more matured score."""
    def step(path, r):
        width = _quantile(r["known"], 1 - F.get(path, r["matured"].cast("int")))
        moved = F.coalesce((1 - coverage) - (r["x"] > width).cast("double"), F.lit(0.0)) * float(gamma)
        return F.concat(path, F.array(F.element_at(path, -1) + moved))

    return step


def adaptive_q(scores: DataFrame, by, gammas=(0.005, 0.02), windows=(250, 500), coverage=0.8, least=100, made="made",
               matures="matures", score="score") -> DataFrame:
    """Adaptive width: the target level moves by gamma once per matured score, up after a hit and down after a miss.

    Entry k of a path is the level after k matured scores, so a forecast made with k known ones reads entry k, and the
    path grows by one entry a forecast: a fold over the series with nothing but that array as its state. The sorted
    score frames that a level is applied to come from a window beforehand. A series is bounded by the calendar.
    """
    by = names(by)
    ranked = matured_scores(scores, by, made, matures, score)
    out = None
    for n in windows:
        known = ranked.select(*by, F.col("pos").alias("matured"), F.array_sort(F.collect_list(score).over(rows(by, "pos", -(n - 1), 0))).alias("_known"))
        framed = ranked.join(known, [*by, "matured"], "left").select(
            *by, made, "pos", "matured", score, F.when(F.col("matured") >= least, F.col("_known")).alias("_known"))
        lists = framed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "matured", F.col(score).alias("x"), F.col("_known").alias("known")))).alias("steps"))
        for g in gammas:
            start = F.array(F.lit(float(1 - coverage)))
            paths = lists.select(*by, F.posexplode(F.aggregate("steps", start, _next_level(coverage, g))).alias("_at", "_level")).withColumn("matured", F.col("_at").cast("bigint")).drop("_at")
            part = framed.withColumn("matured", F.col("matured").cast("bigint")).join(paths, [*by, "matured"]).select(
                *by, made, F.lit(float(g)).alias("gamma"), F.lit(n).alias("window"), _quantile(F.col("_known"), 1 - F.col("_level")).alias("q"))
            out = part if out is None else out.unionByName(part)
    return out


def candidates(scores: DataFrame, by, current: float = 1.28, made="made") -> DataFrame:
    """All width rules side by side as (rule, made, q): constant, trailing quantile and rank, adaptive."""
    by = names(by)
    trail = trailing_q(scores, by, made=made)
    rules = ["quantile_250", "conformal_250", "quantile_500", "conformal_500"]
    long = trail.withColumn("current", F.lit(current)).unpivot([*by, made], ["current", *rules], "rule", "q")
    adapt = adaptive_q(scores, by, made=made).select(
        *by, made, F.concat_ws("_", F.lit("adaptive"), F.col("gamma").cast("string"), F.col("window").cast("string")).alias("rule"), "q")
    return long.unionByName(adapt)
