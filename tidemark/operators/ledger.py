"""Forecast ledger: deadlines, scoring against bars, one forecast per date, summaries and reviews.

Local market time is UTC+9 all year, so deadlines are fixed offsets from the target date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prob
from .frames import names, pick_first, ratio

KEYS = ["instrument", "target_date", "model", "kind", "horizon_days", "target_mode"]
OUTCOMES = ["actual_open", "actual_close", "actual_return", "actual_class", "direction_correct", "log_loss", "brier",
            "price_error", "absolute_price_error", "price_ape", "center_price_error", "return_error", "interval_hit"]


def _day_at(date, minutes: int):
    """UTC time of a local clock time on a date; the zone is nine hours ahead."""
    return F.col(date).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes - 9 * 60))


def prospective(ledger: DataFrame) -> DataFrame:
    """Was the forecast made before its own deadline: 09:00, 09:05 for open-to-close, 15:30 for post-open."""
    post = F.col("information_cutoff") == "post_open"
    deadline = F.when(post, _day_at("target_date", 930)).when(
        F.col("target_mode") == "open_to_close", _day_at("prediction_date", 545)).otherwise(_day_at("prediction_date", 540))
    return ledger.withColumn("is_prospective", F.coalesce(F.col("created_at") < deadline, F.lit(False)))


def scorable(now, kind="kind", target="target_date"):
    """Opens can be scored from 09:05 and closes from 15:40 local time of the target day."""
    return F.when(F.col(kind) == "open", _day_at(target, 545)).otherwise(_day_at(target, 940)) <= now


def score_forecasts(ledger: DataFrame, bars: DataFrame, now) -> DataFrame:
    """Join actual bars to forecasts and grade them; every row gets exactly one status.

    ``bars``: instrument, session, open, close[, adj_close]; ``now``: timestamp column or literal (UTC).
    """
    adj = "adj_close" if "adj_close" in bars.columns else "close"
    prior = F.lag("session").over(Window.partitionBy("instrument").orderBy("session"))
    target = bars.select("instrument", F.col("session").alias("target_date"), F.col("open").alias("_o"), F.col("close").alias("_c"),
                         F.col(adj).alias("_adj"), prior.alias("_prior"))
    base = bars.select("instrument", F.col("session").alias("_base"), F.col(adj).alias("_base_adj"))
    j = prospective(ledger).join(target, ["instrument", "target_date"], "left")
    j = j.withColumn("_base", F.coalesce("as_of_date", "_prior")).join(base, ["instrument", "_base"], "left")

    kind, mode = F.col("kind"), F.col("target_mode")
    is_open, is_price = kind == "open", kind == "price"
    priced = is_open | is_price
    actual = F.when(is_open, F.col("_o")).otherwise(F.col("_c"))
    good = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    status = (
        F.when(F.col("target_date").isNull(), "invalid_target")
        .when(~scorable(now), "pending")
        .when(~F.coalesce(actual > 0, F.lit(False)), "missing_actual")
        .when(priced, F.when(good("current_close"), "scored").otherwise("missing_reference"))
        .when(mode == "open_to_close", F.when(~good("_o"), "missing_actual"))
        .when(mode == "close_to_close", F.when(~good("_adj"), "missing_actual").when(
            ~good("_base_adj") | F.coalesce(F.col("_base") >= F.col("target_date"), F.lit(True)), "missing_reference"))
        .otherwise("invalid_target_mode")
    )
    no_band = F.col("band").isNull() | (F.col("band") < 0)
    j = j.withColumn("status", F.coalesce(status, F.when(no_band, "missing_band").otherwise("scored")))
    ok = F.col("status") == "scored"
    ret = F.when(priced, ratio(actual, "current_close") - 1).when(mode == "open_to_close", ratio("_c", "_o") - 1).otherwise(
        ratio("_adj", "_base_adj") - 1)
    j = j.withColumn("actual_return", F.when(ok, ret))
    has_bar = ok | F.col("status").isin("missing_reference", "missing_band", "invalid_target_mode")
    pick = lambda stem: F.when(is_open, F.col(f"{stem}_open")).otherwise(F.col(f"{stem}_close"))
    graded = ok & priced
    error = pick("predicted") - actual
    j = j.withColumns({
        "actual_open": F.when(has_bar, F.col("_o")), "actual_close": F.when(has_bar, F.col("_c")),
        "price_error": F.when(graded, error), "absolute_price_error": F.when(graded, F.abs(error)),
        "price_ape": F.when(graded, ratio(F.abs(error), actual)),
        "center_price_error": F.when(graded, pick("center") - actual),
        "return_error": F.when(graded, F.col("predicted_return") - F.col("actual_return")),
        "interval_hit": F.when(graded, ((pick("low") <= actual) & (actual <= pick("high"))).cast("double")),
        "actual_class": F.when(ok & ~priced, F.when(F.col("actual_return") < -F.col("band"), 0).when(
            F.col("actual_return") > F.col("band"), 2).otherwise(1)),
    })
    total = F.col("p_down") + F.col("p_flat") + F.col("p_up")
    usable = F.col("actual_class").isNotNull() & (total > 0) & (F.col("p_down") >= 0) & (F.col("p_flat") >= 0) & (F.col("p_up") >= 0)
    p = F.array(*[F.col(c) / total for c in prob.P3])
    y = F.col("actual_class")
    j = j.withColumns({
        "direction_correct": F.when(usable, (prob.argmax(p) == y).cast("double")),
        "log_loss": F.when(usable, prob.log_loss(p, y)), "brier": F.when(usable, prob.brier(p, y)),
    })
    return j.select(*ledger.columns, "is_prospective", "status", *OUTCOMES)


def rescore(scored_before: DataFrame, fresh: DataFrame, stamp) -> DataFrame:
    """Scores never go backwards: a graded row survives a missing bar; the stamp moves only when values change."""
    old = scored_before.select("record_id", *[F.col(c).alias(f"_o_{c}") for c in [*OUTCOMES, "status", "scored_at"]])
    j = fresh.join(old, "record_id", "left")
    keep = (F.col("_o_status") == "scored") & (F.col("status") == "missing_actual")
    j = j.withColumns({c: F.when(keep, F.col(f"_o_{c}")).otherwise(F.col(c)) for c in [*OUTCOMES, "status"]})
    near = lambda c: F.col(c).eqNullSafe(F.col(f"_o_{c}")) | F.coalesce(
        F.abs(F.col(c) - F.col(f"_o_{c}")) <= 1e-12 * F.abs(F.col(f"_o_{c}")), F.lit(False))
    same = F.col("status").eqNullSafe(F.col("_o_status")) & F.col("_o_scored_at").isNotNull()
    for c in OUTCOMES:
        same = same & near(c)
    return j.withColumn("scored_at", F.when(same, F.col("_o_scored_at")).otherwise(stamp)).select(*fresh.columns, "scored_at")


SAME_DAY_FROM = "2026-09-28"


def same_day_rank(since: str = SAME_DAY_FROM, evening: str = "Candidate evening"):
    """0 when made on the prediction day itself (local date), from ``since`` on; 1 otherwise."""
    local = (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(9))).cast("date")
    own = (F.col("prediction_date") >= F.lit(since).cast("date")) & ~F.col("model").startswith(evening)
    return F.when(own & (local == F.col("prediction_date")), 0).otherwise(1)


def daily_comparison(scored: DataFrame, since: str = SAME_DAY_FROM) -> DataFrame:
    """One forecast in advance per date, model, kind, horizon and mode: the day's own first, then the earliest."""
    return pick_first(scored.filter("is_prospective"), KEYS, [same_day_rank(since), F.col("created_at"), F.col("record_id")])


def ledger_summary(daily: DataFrame) -> DataFrame:
    """Accuracy, losses and price errors of scored forecasts per model and kind."""
    return daily.filter("status = 'scored'").groupBy("model", "kind", "horizon_days", "target_mode", "config_hash").agg(
        F.count(F.lit(1)).alias("n"), F.avg("direction_correct").alias("accuracy"), F.avg("log_loss").alias("mean_log_loss"),
        F.avg("brier").alias("mean_brier"), F.count("absolute_price_error").alias("point_forecasts"),
        F.avg("absolute_price_error").alias("price_mae"), F.avg("price_ape").alias("price_mape"),
        F.avg("interval_hit").alias("interval_coverage"))


def headline(model="model"):
    """Models that count for the headline: no candidates, no post-open updates."""
    return ~F.col(model).startswith("Candidate") & ~F.col(model).startswith("Post-open")


def official_runs(ledger: DataFrame, evening="Candidate evening forecast", since: str = SAME_DAY_FROM) -> DataFrame:
    """Rows of the run that is official for each prediction date: its direction rows, headline opens and prices."""
    rows = ledger.filter(F.col("is_prospective") & (F.col("model") != evening))
    first = pick_first(rows.filter("kind = 'direction'"), ["instrument", "prediction_date"],
                       [same_day_rank(since), F.col("created_at"), F.col("record_id")])
    run = rows.join(first.select("instrument", "prediction_date", "run_id"), ["instrument", "prediction_date", "run_id"], "left_semi")
    return run.filter((F.col("kind") == "direction") | headline())


def interval_coverage_by_event(daily: DataFrame, least: int = 10) -> DataFrame:
    """Interval coverage on event days and other days, withheld under ``least`` rows."""
    f = daily.filter("status = 'scored' and interval_hit is not null").withColumn("ev", F.length("event_flags") > 0)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cover = lambda c: F.when(n(c) >= least, F.avg(F.when(c, F.col("interval_hit"))))
    return f.groupBy("model", "kind", "horizon_days").agg(
        n(F.col("ev")).alias("n_event"), n(~F.col("ev")).alias("n_normal"),
        cover(F.col("ev")).alias("coverage_event"), cover(~F.col("ev")).alias("coverage_normal"))


def issuance_rate(ledger: DataFrame, last_n: int = 60) -> DataFrame:
    """Over the newest dates, the first row of each: share with a published value and share verified."""
    first = pick_first(ledger.filter(F.col("is_prospective") & (F.col("kind") == "price") & headline()),
                       ["instrument", "horizon_days", "prediction_date"], [F.col("created_at"), F.col("record_id")])
    w = Window.partitionBy("instrument", "horizon_days").orderBy(F.col("prediction_date").desc())
    recent = first.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= last_n)
    share = lambda c: F.avg(c.cast("double"))
    return recent.groupBy("instrument", "horizon_days").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("signal").isin("yes", "unverified")).alias("issued_share"),
        share(F.col("signal") == "yes").alias("verified_share"))


def rolling_review(daily: DataFrame, windows=(20, 60), ensemble="Mean ensemble", nominal=0.8, least_alert=20) -> DataFrame:
    """Metrics over the newest target dates, beside naive baselines, with alert codes.

    The newest dates come from the distinct dates (bounded by the calendar), not from ranking ledger rows.
    """
    s = daily.filter("status = 'scored'")
    dates = s.select("instrument", "target_date").distinct().withColumn(
        "_k", F.row_number().over(Window.partitionBy("instrument").orderBy(F.col("target_date").desc())))
    sizes = F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: F.col("_k") <= n)
    recent = s.join(dates.filter(F.col("_k") <= max(windows)).withColumn("win", F.explode(sizes)).drop("_k"), ["instrument", "target_date"])

    d = recent.filter((F.col("kind") == "direction") & (F.col("model") == ensemble) & F.col("actual_class").isNotNull())
    share = lambda k: F.avg((F.col("actual_class") == k).cast("double"))
    plogp = lambda k: -share(k) * F.ln(F.greatest(share(k), F.lit(1e-7)))
    none = lambda: F.lit(None).cast("double")
    direction = d.groupBy("instrument", "win").agg(
        F.lit("direction").alias("kind"), F.lit(1).cast("bigint").alias("horizon_days"), F.count(F.lit(1)).alias("n"),
        F.avg("direction_correct").alias("hit_rate"), F.greatest(share(0), share(1), share(2)).alias("prior_hit_rate"),
        F.avg("log_loss").alias("mean_log_loss"), (plogp(0) + plogp(1) + plogp(2)).alias("prior_log_loss"),
        none().alias("interval_coverage"), none().alias("mae_return"), none().alias("zero_mae_return"), none().alias("realized_slope"))
    p = recent.filter(F.col("kind").isin("open", "price") & headline() & F.col("actual_return").isNotNull())
    raw, act = F.col("predicted_return"), F.col("actual_return")
    slope = F.when((F.count(raw) >= 5) & (F.sum(raw * raw) > 0), F.try_divide(F.sum(raw * act), F.sum(raw * raw)))
    price = p.groupBy("instrument", "win", "kind", "horizon_days").agg(
        F.count(F.lit(1)).alias("n"), none().alias("hit_rate"), none().alias("prior_hit_rate"), none().alias("mean_log_loss"),
        none().alias("prior_log_loss"), F.avg("interval_hit").alias("interval_coverage"),
        F.avg(F.abs(act - F.coalesce(raw, F.lit(0.0)))).alias("mae_return"), F.avg(F.abs(act)).alias("zero_mae_return"),
        slope.alias("realized_slope"))
    both = direction.unionByName(price)
    big = (F.col("win") == max(windows)) & (F.col("n") >= least_alert)
    alerts = F.array(F.when(F.col("mean_log_loss") > F.col("prior_log_loss"), "direction_worse_than_prior"),
                     F.when(F.col("interval_coverage") < 0.70, "interval_too_narrow"),
                     F.when(F.col("mae_return") > F.col("zero_mae_return"), "point_worse_than_zero"))
    code = F.array_join(F.filter(alerts, lambda a: a.isNotNull()), ",")
    return both.withColumn("alerts", F.when(big, code).otherwise(""))


def pending_items(daily: DataFrame, ensemble="Mean ensemble") -> DataFrame:
    """Status of each headline item of the newest target date."""
    newest = daily.groupBy("instrument").agg(F.max("target_date").alias("target_date"))
    rows = daily.join(newest, ["instrument", "target_date"], "left_semi").filter(
        (F.col("kind") == "open") | ((F.col("kind") == "direction") & (F.col("model") == ensemble))
        | ((F.col("kind") == "price") & (F.col("horizon_days") == 1)))
    return rows.groupBy("instrument", "target_date", "kind").agg(F.min_by("status", "record_id").alias("status"))


def morning_evening(daily: DataFrame, model: str, evening: str, least: int = 10) -> DataFrame:
    """Scores of two forecast times on the dates both cover, withheld under ``least`` pairs."""
    key = ["instrument", "kind", "target_date"]
    s = daily.filter("status = 'scored' and horizon_days = 1")
    side = lambda name, tag: s.filter(F.col("model") == name).groupBy(*key).agg(
        F.avg("direction_correct").alias(f"hit_{tag}"), F.avg("interval_hit").alias(f"interval_{tag}"),
        F.avg("absolute_price_error").alias(f"error_{tag}"))
    j = side(model, "a").join(side(evening, "b"), key)
    mean = lambda c: F.when(F.count(F.lit(1)) >= least, F.avg(c)).alias(c)
    return j.groupBy("instrument", "kind").agg(F.count(F.lit(1)).alias("n"), *[
        mean(f"{m}_{t}") for m in ("hit", "interval", "error") for t in ("a", "b")])


def merge_ledgers(remote: DataFrame, local: DataFrame, key="record_id") -> DataFrame:
    """Remote rows win by id; ids only the local copy has are added."""
    return remote.unionByName(local.join(remote.select(*names(key)), names(key), "left_anti"))


def health(ledger: DataFrame, calendar: DataFrame, today) -> DataFrame:
    """Newest day with an on-the-day forecast, and the sessions missed since."""
    local = (F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(9))).cast("date")
    last = ledger.filter((local <= F.col("prediction_date")) & (F.col("prediction_date") <= today)).groupBy("instrument").agg(
        F.max("prediction_date").alias("last_forecast"))
    cal = calendar.filter(F.col("session") <= today)
    newest = cal.agg(F.max(F.struct("session", "ordinal"))).scalar()
    j = last.join(cal.select(F.col("session").alias("last_forecast"), F.col("ordinal").alias("_o")), "last_forecast", "left")
    j = j.withColumn("latest_session", newest["session"])
    missed = newest["ordinal"] - F.col("_o")
    return j.select("instrument", "last_forecast", "latest_session", missed.alias("missed_sessions"), (missed == 0).alias("healthy"))
