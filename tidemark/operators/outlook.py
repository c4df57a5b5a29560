"""Long-range outlooks: flattening result tables, actuals, grading, level reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prob
from .frames import col, names, ratio, rows

KEY, TIME = "instrument", "session"


def outlook_rows(documents: DataFrame, items: list[dict], key: str = "series_id") -> DataFrame:
    """Result documents to long rows with a composed id.

    Each item: series, kind ("value" or "probability"), target (column), and optional point, low, high, baseline,
    probability, baseline_probability expressions. One row per item and document.
    """
    empty = F.lit(None).cast("double")
    structs = []
    for it in items:
        structs.append(F.struct(
            F.concat_ws(":", F.lit(it["series"]), F.col(key)).alias("series"), F.lit(it["kind"]).alias("kind"), col(it["target"]).alias("target_period"),
            *[(col(it[c]).cast("double") if c in it else empty).alias(c) for c in ("point", "low", "high", "baseline", "probability", "baseline_probability")]))
    long = documents.select(F.col("as_of"), F.explode(F.array(*structs)).alias("o")).select("as_of", "o.*")
    return long.withColumn("record_id", F.concat_ws("|", "series", F.col("as_of").cast("string"), F.col("target_period").cast("string")))


def union_actuals(tables: dict[str, DataFrame]) -> DataFrame:
    """One (series, target_period, actual) table from a DataFrame per series; no function per row."""
    out = None
    for name, df in tables.items():
        part = df.select(F.concat_ws(":", F.lit(name), F.col("series_id")).alias("series"), F.col("month").alias("target_period"), F.col("actual").cast("double"))
        out = part if out is None else out.unionByName(part)
    return out


def score_outlook(outlook: DataFrame, actuals: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """Grade value rows by error and band, probability rows by Brier score, both beside their baseline.

    A month counts only once a later one exists (``newest``: series, last_period).
    """
    if newest is not None:
        actuals = actuals.join(newest, "series").filter(F.col("target_period") < F.col("last_period")).drop("last_period")
    j = outlook.join(actuals, ["series", "target_period"], "left")
    got = F.col("actual").isNotNull()
    is_p = F.col("kind") == "probability"
    a = F.col("actual")
    return j.select(
        "record_id", "series", "kind", "target_period", F.when(got, "scored").otherwise("pending").alias("status"), "actual",
        F.when(~is_p, F.col("point") - a).alias("error"), F.when(~is_p, F.abs(F.col("point") - a)).alias("abs_error"),
        F.when(~is_p, F.abs(F.col("baseline") - a)).alias("baseline_abs_error"),
        F.when(~is_p & F.col("low").isNotNull() & F.col("high").isNotNull(), ((F.col("low") <= a) & (a <= F.col("high"))).cast("double")).alias("in_band"),
        F.when(is_p, F.pow(F.col("probability") - a, 2)).alias("brier"), F.when(is_p, F.pow(F.col("baseline_probability") - a, 2)).alias("baseline_brier"))


def first_passage(issues: DataFrame, bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Did a close within the next n sessions reach the level: 1, 0 once n sessions passed, else missing.

    issues: instrument, issued (session), days, level. Future closes meet the issue by session ordinal: the n next
    ordinals are unrolled, so the join is an equality.
    """
    cal = calendar.select(F.col("session").alias("_s"), F.col("ordinal").alias("_o"))
    i = issues.join(cal, F.col("issued") == F.col("_s")).withColumn("_t", F.explode(F.sequence(F.col("_o") + 1, F.col("_o") + F.col("days"))))
    c = bars.join(cal, F.col("session") == F.col("_s")).select("instrument", F.col("_o").alias("_t"), "close")
    j = i.join(c, ["instrument", "_t"], "left").groupBy("instrument", "issued", "days", "level").agg(
        F.count("close").alias("seen"), F.max((F.col("close") >= F.col("level")).cast("int")).alias("_hit"))
    out = F.when(F.col("_hit") == 1, 1.0).when(F.col("seen") >= F.col("days"), 0.0)
    return j.select("instrument", "issued", "days", "level", "seen", out.alias("reached"))


def level_reach_history(bars: DataFrame, levels=(0.02, 0.05, 0.10), horizons=(5, 20, 60)) -> DataFrame:
    """Historical share of sessions after which close * (1 + x) was reached within n sessions."""
    f = bars
    for n in horizons:
        fr = rows(KEY, TIME, 1, n)
        f = f.withColumn(f"_m{n}", F.when(F.count("close").over(fr) == n, ratio(F.max("close").over(fr), "close") - 1))
    grid = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(float(x)).alias("level"), F.col(f"_m{n}").alias("m")) for n in horizons for x in levels])
    long = f.withColumn("_g", grid).select(KEY, F.explode("_g").alias("g")).select(KEY, "g.*").filter("m is not null")
    return long.groupBy(KEY, "horizon", "level").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("m") >= F.col("level")).cast("double")).alias("share"))


def score_daily_document(docs: DataFrame, bars: DataFrame, flat: float = 0.0) -> DataFrame:
    """Direction against the previous close and percent errors of the predicted open and close, to six digits."""
    b = bars.select("instrument", F.col("session").alias("target_date"), F.col("open").alias("_o"), F.col("close").alias("_c"))
    j = docs.join(b, ["instrument", "target_date"])
    move = F.col("_c") - F.col("previous_close")
    actual = F.when(move > flat, "up").when(move < -flat, "down").otherwise("flat")
    ape = lambda p, a: F.bround(F.abs(F.col(p) - F.col(a)) / F.col(a) * 100, 6)
    return j.select("instrument", "target_date", actual.alias("actual_direction"), (actual == F.col("direction")).alias("direction_correct"),
                    ape("predicted_open", "_o").alias("open_ape_pct"), ape("predicted_close", "_c").alias("close_ape_pct"))


def interval_coverage_path(oof: DataFrame, by, order: str, y: str, p: str, gap: int = 1, warmup: int = 8, coverage: float = 0.8, floor: float = 1e-9) -> DataFrame:
    """Each row's interval from residuals known by then, and whether it held.

    Earlier scores are a frame that ends ``gap`` rows before the row; a series holds one row per period.
    """
    f = oof.withColumn("_s", F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(F.col(p)), F.lit(floor)))
    past = rows(by, order, None, -1 - gap)
    f = f.withColumn("_n", F.count("_s").over(past)).withColumn("_a", F.array_sort(F.collect_list("_s").over(past)))
    q = F.when(F.col("_n") >= warmup, F.element_at("_a", F.greatest(prob.conformal_rank(F.col("_n"), coverage), F.lit(1))))
    f = f.withColumn("halfwidth", q)
    hit = F.when(F.col("halfwidth").isNotNull(), (F.col("_s") <= F.col("halfwidth")).cast("double"))
    return f.withColumn("hit", hit).drop("_s", "_a").withColumnRenamed("_n", "known")


def agreement(rebuilt: DataFrame, recorded: DataFrame, by, key, columns=prob.P3, tolerance: float = 0.01) -> DataFrame:
    """How well rebuilt predictions match recorded ones on shared rows."""
    key = names(key)
    r = recorded.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    j = rebuilt.join(r, key)
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"_r_{c}")) for c in columns])
    same = prob.argmax(F.array(*[F.col(c) for c in columns])) == prob.argmax(F.array(*[F.col(f"_r_{c}") for c in columns]))
    return j.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("same_call"), F.avg(far).alias("mean_gap"),
                                     F.avg((far <= tolerance).cast("double")).alias("within"))


def interpolate_grid(rows_: DataFrame, grid: DataFrame, key, x: str, names_=prob.P3, floor: float = 1e-7) -> DataFrame:
    """Linear interpolation of a probability grid at x, clamped at its ends, clipped and renormalised.

    grid: key..., gap, p_down, p_flat, p_up. A grid has a fixed number of points (about two hundred).
    """
    key = names(key)
    g = grid.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("gap", *names_))).alias("_g"))
    j = rows_.join(g, key)
    lo, hi = F.element_at("_g", 1)["gap"], F.element_at("_g", -1)["gap"]
    j = j.withColumn("clamped", (F.col(x) < lo) | (F.col(x) > hi)).withColumn("_x", F.least(F.greatest(F.col(x), lo), hi))
    j = j.withColumn("_k", F.greatest(F.size(F.filter("_g", lambda e: e["gap"] <= F.col("_x"))), F.lit(1)))
    a, b = F.element_at("_g", F.col("_k")), F.element_at("_g", F.least(F.col("_k") + 1, F.size("_g")))
    t = F.coalesce(F.try_divide(F.col("_x") - a["gap"], b["gap"] - a["gap"]), F.lit(0.0))
    p = [F.greatest(F.least(a[n] + t * (b[n] - a[n]), F.lit(1.0)), F.lit(floor)) for n in names_]
    j = j.withColumns({f"_p{i}": e for i, e in enumerate(p)})
    total = F.col("_p0") + F.col("_p1") + F.col("_p2")
    return j.select(*rows_.columns, "clamped", *[(F.col(f"_p{i}") / total).alias(n) for i, n in enumerate(names_)])


def post_open_rows(opens: DataFrame, grid: DataFrame, existing: DataFrame, now) -> DataFrame:
    """One updated forecast per (instrument, date) once its open is known, or the reason there is none.

    opens: instrument, target_date, open, previous_close; existing: instrument, target_date of rows already appended.
    """
    key = ["instrument", "target_date"]
    has = grid.select(*key).distinct().withColumn("_grid", F.lit(1))
    old = existing.select(*key).distinct().withColumn("_old", F.lit(1))
    j = opens.join(has, key, "left").join(old, key, "left")
    late = now >= F.col("target_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(6), F.lit(30))
    why = (F.when(F.col("_old") == 1, "already_there").when(F.col("_grid").isNull(), "no_grid").when(~F.coalesce(F.col("open") > 0, F.lit(False)), "no_open")
           .when(~F.coalesce(F.col("previous_close") > 0, F.lit(False)), "no_previous_close").when(late, "late").otherwise(""))
    j = j.withColumn("skipped", why).withColumn("gap", F.when(why == "", F.col("open") / F.col("previous_close") - 1))
    done = interpolate_grid(j.filter("skipped = ''").select(*key, "skipped", "gap"), grid, key, "gap")
    none = F.lit(None)
    rest = j.filter("skipped <> ''").select(*key, "skipped", "gap", none.cast("boolean").alias("clamped"), *[none.cast("double").alias(n) for n in prob.P3])
    return done.unionByName(rest)

