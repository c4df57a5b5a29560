"""Merges of versions: histories, vintages, archives, flash estimates, duplicate candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .frames import names, numbered
from .joins import combine_first


def flash_yoy(flash: DataFrame) -> DataFrame:
    """Yearly change of each (month, day bucket) against the same bucket a year before."""
    base = flash.select("series_id", F.add_months("month", 12).alias("month"), "days", F.col("value").alias("_b"))
    j = flash.join(base, ["series_id", "month", "days"], "left")
    return j.select("series_id", "month", "days", "value", F.when(F.col("_b") > 0, F.col("value") / F.col("_b") - 1).alias("yoy"))


def flash_fill(monthly: DataFrame, flash: DataFrame) -> DataFrame:
    """Confirmed month, else the full-month flash, else last year's month grown by the longest partial bucket."""
    y = flash_yoy(flash)
    full = y.filter("days = 31").select("series_id", "month", F.col("value").alias("_full"))
    part = y.filter("days < 31 and yoy is not null").groupBy("series_id", "month").agg(F.max_by("yoy", "days").alias("_g"))
    last = monthly.select("series_id", F.add_months("month", 12).alias("month"), F.col("value").alias("_last"))
    j = monthly.select("series_id", "month", F.col("value").alias("_c")).join(full, ["series_id", "month"], "full").join(
        part, ["series_id", "month"], "full").join(last, ["series_id", "month"], "left")
    grown = F.col("_last") * (1 + F.col("_g"))
    basis = F.when(F.col("_c").isNotNull(), "confirmed").when(F.col("_full").isNotNull(), "flash_month").when(grown.isNotNull(), "flash_growth")
    return j.select("series_id", "month", F.coalesce("_c", "_full", grown).alias("value"), basis.alias("basis")).dropna()


def merge_history(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Cell by cell the new version wins, old-only rows stay, new columns are added.

    Another key column means the new version is taken as it is, and so do duplicate keys, which the plan itself finds.
    """
    key = names(key)
    if not set(key) <= set(old.columns) or not set(key) <= set(new.columns):
        return new
    twice = old.groupBy(*key).count().unionByName(new.groupBy(*key).count()).agg(F.max("count") > 1).scalar()
    broken = F.coalesce(twice, F.lit(False))
    return combine_first(new, old, key).filter(~broken).unionByName(new.filter(broken), allowMissingColumns=True)


def vintage_append(existing: DataFrame, fresh: DataFrame, vintage, by="series_id", tolerance: float = 1e-9) -> DataFrame:
    """Rows of a new vintage to append: none if that date exists or nothing differs from the newest vintage.

    existing: vintage_date, series_id, month, value; fresh: series_id, month, value.
    """
    by = names(by)
    newest = existing.groupBy(*by).agg(F.max("vintage_date").alias("_v"))
    last = existing.join(newest, by).filter("vintage_date = _v").select(*by, "month", F.col("value").alias("_old"))
    j = fresh.join(last, [*by, "month"], "left")
    moved = j.groupBy(*by).agg(F.max((F.col("_old").isNull() | (F.abs(F.col("value") - F.col("_old")) > tolerance)).cast("int")).alias("_moved"))
    known = existing.filter(F.col("vintage_date") == vintage).select(*by).distinct()
    return fresh.join(moved.filter("_moved = 1").select(*by), by, "left_semi").join(known, by, "left_anti").select(
        vintage.alias("vintage_date"), *by, "month", "value")


def archive_versions(observations: DataFrame, key, observed: str, value_columns, chunk_days: int = 365) -> DataFrame:
    """Observations that start a new version: the value differs from the one seen before. ``version`` counts from 1.

    The previous observation comes from a strict as-of join of the table with itself, so a key seen very often is
    split by time. One row per (key, observation time) is expected.
    """
    key = names(key)
    h = observations.withColumn("_h", F.xxhash64(*value_columns))
    before = h.select(*key, F.col(observed).alias("_seen"), F.col("_h").alias("_prev"))
    j = asof_join(h, before, observed, "_seen", key, ["_prev"], strict=True, chunk_days=chunk_days)
    fresh = j.filter("_prev is null or _prev <> _h").drop("_h", "_prev")
    return numbered(fresh, key, observed, out="version", chunk_days=chunk_days)


def prepend_history(older: DataFrame, newer: DataFrame, by="series_id") -> DataFrame:
    """Older rows before the newer series starts, scaled so the older series meets the first new value."""
    by = names(by)
    first = newer.groupBy(*by).agg(F.min_by(F.struct("month", "value"), "month").alias("_f"))
    joint = older.join(first, by).filter(F.col("month") == F.col("_f.month")).select(*by, (F.col("_f.value") / F.col("value")).alias("_k"))
    early = older.join(first, by).filter(F.col("month") < F.col("_f.month")).join(joint, by)
    return early.select(*by, "month", (F.col("value") * F.col("_k")).alias("value"), F.lit("older").alias("origin")).unionByName(
        newer.select(*by, "month", "value", F.lit("newer").alias("origin")))


def dedupe_candidates(predictions: DataFrame, order: list[str], by=("instrument",), tolerance: float = 1e-9) -> DataFrame:
    """Models whose probabilities equal those of an earlier model on every shared row.

    Each row holds one array of at most ``len(order)`` models, so pairs are formed inside the row, not by a self join.
    """
    by = names(by)
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    item = F.struct(rank.alias("r"), F.col("model").alias("m"), F.array("p_down", "p_flat", "p_up").alias("p"))
    row = predictions.groupBy(*by, "target_date").agg(F.array_sort(F.collect_list(item)).alias("ms"))
    pair = F.flatten(F.transform("ms", lambda a: F.transform(
        F.filter("ms", lambda b: b["r"] < a["r"]),
        lambda b: F.struct(a["m"].alias("model"), b["m"].alias("same_as"),
                           F.array_max(F.zip_with(a["p"], b["p"], lambda x, y: F.abs(x - y))).alias("d")))))
    gap = row.select(*by, F.explode(pair).alias("e")).select(*by, "e.*").groupBy(*by, "model", "same_as").agg(F.max("d").alias("max_diff"))
    return gap.filter(F.col("max_diff") <= tolerance)


def expected_grid(observations: DataFrame, minutes: int, by=("instrument", "session")) -> DataFrame:
    """Every bar start of an observed day: one row per slot."""
    by = names(by)
    start = F.col(by[-1]).cast("timestamp_ntz")
    slots = F.transform(F.sequence(F.lit(0), F.lit(1440 - minutes), F.lit(minutes)), lambda m: start + F.make_dt_interval(F.lit(0), F.lit(0), m))
    return observations.select(*by).distinct().select(*by, F.explode(slots).alias("ts"))


def quality_report(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Per (instrument, session): received, new versions of a slot, expected, missing, gap since the last session, age of the newest bar."""
    obs = ["instrument", "session"]
    slot = bars.withColumn("slot", F.date_format("ts", "HH:mm"))
    fresh = archive_versions(slot, ["instrument", "slot"], "session", ["close"]).groupBy(*obs).agg(F.count(F.lit(1)).alias("new_versions"))
    got = bars.groupBy(*obs).agg(F.count(F.lit(1)).alias("received"), F.max("ts").alias("latest"))
    missing = expected_grid(bars, minutes).join(bars.select(*obs, "ts"), [*obs, "ts"], "left_anti").groupBy(*obs).agg(F.count(F.lit(1)).alias("missing"))
    w = Window.partitionBy("instrument").orderBy("session")
    j = got.join(fresh, obs, "left").join(missing, obs, "left").na.fill(0, ["new_versions", "missing"])
    end = F.date_add("session", 1).cast("timestamp")
    return j.select(*obs, "received", "new_versions", F.lit(1440 // minutes).alias("expected"), "missing",
                    (F.col("missing") / (1440 // minutes)).alias("missing_ratio"), F.datediff("session", F.lag("session").over(w)).alias("interval_days"),
                    (F.unix_seconds(end) - F.unix_seconds(F.col("latest").cast("timestamp"))).alias("latest_age_seconds"))
