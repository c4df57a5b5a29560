"""Normalising landed rows, contract checks, staleness and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prob
from .frames import change, col, names, prev, ratio

KEY, TIME = "instrument", "session"


def month_of(text):
    """First day of the month written as 202406, 2024-06, 2024.06, 2024/06 or a full date."""
    t = F.trim(col(text))
    y, m = F.regexp_extract(t, r"^(\d{4})\D?(\d{2})", 1), F.regexp_extract(t, r"^(\d{4})\D?(\d{2})", 2)
    return F.concat(y, F.lit("-"), m, F.lit("-01")).try_cast("date")


def number_of(text):
    """Number text without separators, signs and percent marks; unreadable text is missing."""
    return F.regexp_replace(F.trim(col(text)), "[,+%]", "").try_cast("double")


def normalize_monthly(raw: DataFrame, month="month_text", value="value_text", by="series_id") -> DataFrame:
    """Month and positive finite value; ``copies`` above one marks a duplicate month."""
    v = number_of(value)
    f = raw.select(*names(by), month_of(month).alias("month"), F.when((v > 0) & (v < float("inf")), v).alias("value"))
    return f.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*names(by), "month")))


def normalize_daily(raw: DataFrame, date="date_text", value="value_text", by="series_id") -> DataFrame:
    """Digits-only dates and readable values; rows without either are dropped, duplicates flagged."""
    d = F.regexp_replace(col(date), "[^0-9]", "")
    iso = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 2), F.lit("-"), F.substring(d, 7, 2)).try_cast("date")
    f = raw.select(*names(by), iso.alias("date"), number_of(value).alias("value")).dropna()
    return f.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*names(by), "date")))


def positive(*cols):
    """All present and above zero (``least`` alone would skip missing values)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce(F.col(c) > 0, F.lit(False))
    return ok


def inconsistent():
    return (F.col("high") < F.greatest("low", "open", "close")) | (F.col("low") > F.least("open", "close"))


def bar_sanity(bars: DataFrame, most: float = 0.01) -> DataFrame:
    """Share of contradictory bars per instrument; above ``most`` the whole series is rejected, else those bars are missing."""
    bad_value = ~positive("open", "high", "low", "close")
    f = bars.withColumn("bad", inconsistent()).withColumn("invalid", bad_value | (F.col("volume") < 0))
    share = f.groupBy(KEY).agg(F.avg(F.col("bad").cast("double")).alias("bad_share"), F.max("invalid").alias("has_invalid"),
                               F.sum(F.col("bad").cast("bigint")).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("has_invalid"), "invalid_value").when(F.col("bad_share") > most, "too_many_inconsistent").otherwise("usable")
    return share.select(KEY, "n", "n_bad", "bad_share", verdict.alias("verdict"))


def corporate_action_flag(bars: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Open and close both far from the previous close in the same direction."""
    pc = prev("close", KEY, TIME)
    o, c = ratio("open", pc), ratio("close", pc)
    low, high = 1 - threshold, 1 / (1 - threshold)
    flag = ((o <= low) & (c <= low)) | ((o >= high) & (c >= high))
    return bars.select(KEY, TIME, F.coalesce(flag, F.lit(False)).alias("action"))


def boundary_anomalies(bars: DataFrame, jump: float = 0.3, ratio_jump: float = 0.05) -> DataFrame:
    """Counts and maxima of suspicious daily moves per instrument."""
    f = bars.withColumn("r", F.abs(change("close", KEY, TIME))).withColumn("k", ratio("adj_close", "close"))
    f = f.withColumn("j", F.abs(change("k", KEY, TIME)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = f.groupBy(KEY).agg(F.max("r").alias("max_move"), n(F.col("r") > jump).alias("n_moves"), F.max("j").alias("max_ratio_jump"),
                           n(F.col("j") > ratio_jump).alias("n_ratio_jumps"), n(F.col("volume") <= 0).alias("n_zero_volume"))
    return a.withColumn("flag", (F.col("n_moves") > 0) | (F.col("n_ratio_jumps") > 0))


def normalize_completed(raw: DataFrame, minutes: int = 5, opens: str = "09:00", closes: str = "15:30", offset_hours: int = 9):
    """Finished bars inside the local session, with end, local session, provenance and a conflict flag.

    ``raw``: instrument, ts (UTC start), open..volume, observed_at, split, dividend. Same bar with other values
    in one observation is a conflict.
    """
    end = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    local = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(offset_hours))
    local_end = end + F.make_dt_interval(F.lit(0), F.lit(offset_hours))
    f = raw.withColumn("bar_end", end).withColumn("session", local.cast("date"))
    inside = (F.date_format(local, "HH:mm") >= opens) & (F.date_format(local_end, "HH:mm") <= closes)
    sane = positive("open", "high", "low", "close") & (F.col("volume") >= 0) & ~inconsistent()
    f = f.filter((F.col("bar_end") <= F.col("observed_at")) & inside & sane & (F.second("ts") == 0))
    seen = (F.col("observed_at") + F.make_dt_interval(F.lit(0), F.lit(offset_hours))).cast("date")
    f = f.withColumn("needs_adjustment", ~F.col("split").isin(0.0, 1.0) | (F.col("dividend") != 0)).withColumn(
        "provenance", F.when(F.col("session") < seen, "backfill").otherwise("live"))
    h = F.hash("open", "high", "low", "close", "volume")
    key = ["instrument", "ts", "observed_at"]
    g = f.withColumn("_h", h).groupBy(*key).agg(
        F.countDistinct("_h").alias("_n"), *[F.min(c).alias(c) for c in (
            "bar_end", "session", "open", "high", "low", "close", "volume", "needs_adjustment", "provenance")])
    return g.withColumn("conflict", F.col("_n") > 1).drop("_n")


def drop_unclosed(bars: DataFrame, now, zone: str = "America/New_York", cutoff: str = "17:15") -> DataFrame:
    """Without weekend bars and without the local current day before its cut-off; ``now`` is UTC."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), now)
    today, clock = local.cast("date"), F.date_format(local, "HH:mm")
    weekend = F.dayofweek(TIME).isin(1, 7)
    open_day = (F.col(TIME) > today) | ((F.col(TIME) == today) & (clock < cutoff))
    return bars.filter(~weekend & ~open_day)


def eligible_universe(universe: DataFrame, bars: DataFrame, listed_by: str) -> DataFrame:
    """Every instrument of the universe with the reason it is left out, if any."""
    first = bars.groupBy(KEY).agg(F.min(TIME).alias("first_session"))
    cutoff = F.lit(listed_by).cast("date")
    why = F.when(F.col("first_session").isNull(), "no_bars").when(F.col("first_session") > cutoff, "listed_late").otherwise("kept")
    return universe.join(first, KEY, "left").select(KEY, "first_session", why.alias("reason"))


def interpolation_check(panel: DataFrame, bars: DataFrame) -> DataFrame:
    """Panel rows without a raw bar behind them, counted per instrument."""
    bad = panel.join(bars.select(KEY, TIME), [KEY, TIME], "left_anti")
    return bad.groupBy(KEY).agg(F.count(F.lit(1)).alias("invented"))


def leaky_rows(panel: DataFrame, feature="feature_date", label="label_date") -> DataFrame:
    """Rows whose label date lies before the feature date, per instrument: kept and dropped."""
    leak = (F.col(label) < F.col(feature)).cast("bigint")
    return panel.groupBy(KEY).agg(F.sum(leak).alias("dropped"), F.sum(1 - leak).alias("kept"))


def validate_prediction(docs: DataFrame) -> DataFrame:
    """Row contract of a daily prediction; ``problems`` is empty for a valid row.

    docs: target_date, created_local, previous_close, predicted_open, predicted_close, direction, sources array<struct<title,url>>.
    """
    deadline = F.col("target_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(9))
    bad = F.array(
        F.when(F.col("target_date").isNull(), "target_date"),
        F.when(~F.coalesce(F.col("created_local") < deadline, F.lit(False)), "created_late"),
        F.when(~positive("previous_close", "predicted_open", "predicted_close"), "price"),
        F.when(~F.coalesce(F.col("direction").isin("up", "flat", "down"), F.lit(False)), "direction"),
        F.when(F.size("sources") < 1, "no_sources").when(
            ~F.forall("sources", lambda s: s["url"].startswith("https://") & (F.length(s["title"]) > 0)), "source"),
    )
    return docs.withColumn("problems", F.array_join(F.filter(bad, lambda x: x.isNotNull()), ","))


def staleness(series: DataFrame, now, by="series_id", month="month", warn: int = 45, expire: int = 100) -> DataFrame:
    """Days since the newest month became visible (two months after it starts), with its level."""
    last = series.groupBy(*names(by)).agg(F.max(month).alias("last_month"))
    age = F.greatest(F.datediff(now, F.add_months("last_month", 2)), F.lit(0))
    level = F.when(F.col("age_days") >= expire, "expired").when(F.col("age_days") >= warn, "warn").otherwise("fresh")
    return last.withColumn("age_days", age).withColumn("level", level)


def scored_sessions(ledger: DataFrame) -> DataFrame:
    """Per session and kind: rows, rows scored, and whether the day is done."""
    done = F.sum(F.when(F.col("status") == "scored", 1).otherwise(0))
    return ledger.groupBy("target_date", "kind").agg(F.count(F.lit(1)).alias("n"), done.alias("n_scored")).withColumn(
        "done", F.col("n_scored") > 0)


def cross_source_verify(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two vendors' daily bars by (instrument, session): accepted, or exactly one reason.

    ``b`` also carries split and dividend.
    """
    key, px = [KEY, TIME], ["open", "high", "low", "close"]

    def side(df, tag, extra=()):
        aggs = [F.min(c).alias(f"{tag}_{c}") for c in [*px, "volume", *extra]]
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{tag}_n"), *aggs)

    j = side(a, "a").join(side(b, "b", ("split", "dividend")), key, "full")
    sane = lambda t: positive(*[f"{t}_{c}" for c in px]) & (F.col(f"{t}_high") >= F.greatest(
        f"{t}_low", f"{t}_open", f"{t}_close")) & (F.col(f"{t}_low") <= F.least(f"{t}_open", f"{t}_close")) & (F.col(f"{t}_volume") >= 0)
    differ = F.lit(False)
    for c in px:
        differ = differ | (F.col(f"a_{c}") != F.col(f"b_{c}"))
    reason = (
        F.when((F.coalesce("a_n", F.lit(0)) > 1) | (F.coalesce("b_n", F.lit(0)) > 1), "duplicate_session")
        .when(F.col("a_n").isNull() | F.col("b_n").isNull(), "missing_cross_source")
        .when(~F.coalesce(sane("a") & sane("b") & F.col("b_split").isNotNull() & F.col("b_dividend").isNotNull(), F.lit(False)),
              "invalid_or_incomplete_bar")
        .when((F.col("a_volume") <= 0) | (F.col("b_volume") <= 0), "untradeable_session")
        .when(~F.col("b_split").isin(0.0, 1.0) | (F.col("b_dividend") != 0), "corporate_action_unresolved")
        .when(differ, "ohlc_mismatch").otherwise("accepted")
    )
    return j.select(*key, reason.alias("reason"))


def statement_basis(quarters: DataFrame) -> DataFrame:
    """Per instrument: earnings and book value per share from the last four quarters and the implied share count."""
    w = Window.partitionBy(KEY).orderBy(F.col("period").desc())
    f = quarters.withColumn("rn", F.row_number().over(w)).withColumn(
        "implied", F.when(F.col("eps") != 0, F.col("net_income") / F.col("eps")))
    f = f.withColumn("implied", F.when(F.col("implied") > 0, F.col("implied")))
    last4 = F.when(F.col("rn") <= 4, F.col("net_income"))
    g = f.groupBy(KEY).agg(F.count(last4).alias("n4"), F.sum(last4).alias("ttm"), F.percentile("implied", F.lit(0.5)).alias("shares"),
                           F.max_by("equity", "period").alias("equity"), F.max("period").alias("period"))
    return g.filter("n4 = 4 and shares is not null and equity is not null").select(
        KEY, "period", "shares", (F.col("ttm") / F.col("shares")).alias("eps_ttm"), (F.col("equity") / F.col("shares")).alias("bps"))


def valuation_multiples(basis: DataFrame, quotes: DataFrame, per=(10.0, 15.0, 20.0), pbr=(1.0, 1.5, 2.0), max_statement=200, max_quote=10):
    """Price over earnings and book, and the price at each assumed multiple, behind age and sign guards.

    ``quotes``: instrument, price, price_date, observed_on.
    """
    j = basis.join(quotes, KEY)
    fresh = F.datediff("observed_on", "period").between(0, max_statement) & F.datediff("observed_on", "price_date").between(0, max_quote)
    j = j.filter(fresh & (F.col("price") > 0))
    items = [F.struct(F.lit("per").alias("metric"), F.col("eps_ttm").alias("basis"), F.lit(m).alias("multiple")) for m in per]
    items += [F.struct(F.lit("pbr").alias("metric"), F.col("bps").alias("basis"), F.lit(m).alias("multiple")) for m in pbr]
    x = j.withColumn("i", F.explode(F.array(*items))).select(KEY, "price", "i.*").filter("basis > 0")
    return x.select(KEY, "metric", "multiple", (F.col("price") / F.col("basis")).alias("current"),
                    (F.col("basis") * F.col("multiple")).alias("fair"), (F.col("basis") * F.col("multiple") / F.col("price") - 1).alias("upside"))


def availability_fill(df: DataFrame, need, optional) -> DataFrame:
    """Rows count as available when all needed columns exist; then optional gaps become 0, other rows become all 0."""
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    gap = F.lit(False)
    for c in optional:
        gap = gap | F.col(c).isNull()
    f = df.withColumn("available", ok).withColumn("filled", ok & gap)
    zero = lambda c: F.when(F.col("available"), F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    return f.withColumns({c: zero(c) for c in [*need, *optional]}).withColumn("available", F.col("available").cast("int")).withColumn(
        "filled", F.col("filled").cast("int"))


def complete_rows(df: DataFrame, sets: dict, by=KEY) -> DataFrame:
    """Rows where each column set is fully present, counted per group."""
    def full(columns):
        ok = F.lit(True)
        for c in columns:
            ok = ok & F.col(c).isNotNull()
        return F.sum(ok.cast("bigint"))
    return df.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), *[full(c).alias(k) for k, c in sets.items()])


def exposure_limit_check(positions: DataFrame, accounts: DataFrame, symbol_weight=0.2, group_weight=0.5, unit_cost=1.003) -> DataFrame:
    """Room left for each candidate position of an account under cash, symbol and group limits.

    ``positions``: account, symbol, quantity, price (missing = no quote), reserved; ``accounts``: account, cash.
    """
    value = F.coalesce(F.col("quantity") * F.col("price"), F.lit(0.0))
    p = positions.withColumn("value", value)
    total = p.groupBy("account").agg(F.sum("value").alias("exposure"), F.sum("reserved").alias("all_reserved"),
                                     F.max((F.col("price").isNull() & (F.col("quantity") > 0)).cast("int")).alias("blind"))
    j = p.join(total, "account").join(accounts, "account")
    equity = F.col("cash") + F.col("exposure")
    room = F.greatest(F.lit(0.0), F.least(
        F.col("cash") - F.col("all_reserved"), equity * symbol_weight - F.col("value") - F.col("reserved"),
        equity * group_weight - F.col("exposure") - F.col("all_reserved")))
    why = F.array(F.when(F.col("price").isNull(), "missing_quote"), F.when(F.col("quantity") > 0, "already_holding"),
                  F.when(F.col("blind") == 1, "exit_deferred"))
    j = j.withColumn("reasons", F.array_join(F.filter(why, lambda x: x.isNotNull()), ","))
    ok = F.col("reasons") == ""
    j = j.withColumn("budget", F.when(ok, room).otherwise(0.0))
    units = F.when(ok, F.floor(F.col("budget") / (F.col("price") * unit_cost))).otherwise(0)
    return j.withColumn("units", units.cast("bigint")).withColumn(
        "reasons", F.when(ok & (F.col("units") == 0), "cash_or_exposure_limit").otherwise(F.col("reasons"))).select(
        "account", "symbol", "budget", "units", "reasons")


def columns_like(df: DataFrame, keep=(), drop=()) -> list[str]:
    """Feature columns by name prefix, in frame order."""
    chosen = [c for c in df.columns if not keep or c.startswith(tuple(keep))]
    return [c for c in chosen if not (drop and c.startswith(tuple(drop)))]


issue_gate = prob.issue_gate
