"""Daily bars: building them from ticks, returns, features, labels and chart signals.

Every function takes bars (instrument, session, open, high, low, close, volume) and adds columns.
The tick volume is folded to one row per (instrument, session) first; windows run on bars only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import add_streak, change, col, guarded, median, nxt, prev, ratio, rolling, rows, series

KEY, TIME = "instrument", "session"


def bars_from_ticks(ticks: DataFrame, by=(KEY, TIME), price="price", volume="volume", order="tick") -> DataFrame:
    """Open, high, low, close and volume per key; ``order`` must be a total order of the ticks."""
    return ticks.groupBy(*by).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    )


def lagged(x, k=1):
    return prev(x, KEY, TIME, k)


def ahead(x, k=1):
    return nxt(x, KEY, TIME, k)


def roll(agg, x, n, shift=0, least=None):
    return rolling(agg, x, KEY, TIME, n, shift=shift, least=least)


def with_vol20(bars: DataFrame, n: int = 20) -> DataFrame:
    """Close-to-close return and its n-day sample deviation."""
    return bars.withColumn("ret", change("close", KEY, TIME)).withColumn("vol20", roll(F.stddev_samp, "ret", n))


def returns_and_legs(bars: DataFrame) -> DataFrame:
    """Close-to-close return with its overnight and intraday legs; (1+gap)(1+intraday) = 1+ret."""
    return bars.select(
        KEY, TIME,
        change("close", KEY, TIME).alias("ret"),
        (ratio("open", lagged("close")) - 1).alias("gap"),
        (ratio("close", "open") - 1).alias("intraday"),
    )


def class_of(x, band):
    """0 below -band, 2 above +band, else 1; missing if either is missing."""
    x, band = col(x), col(band)
    return F.when(x.isNull() | band.isNull(), F.lit(None).cast("int")).when(x < -band, 0).when(x > band, 2).otherwise(1)


def instrument_features(bars: DataFrame) -> DataFrame:
    """Scale-free inputs known at the close of each session."""
    f = with_vol20(bars)
    turnover = col("close") * col("volume")
    f = f.withColumn("turnover", turnover)
    return f.select(
        KEY, TIME,
        F.col("ret").alias("ret_1"), lagged("ret", 1).alias("ret_2"), lagged("ret", 2).alias("ret_3"),
        *[change("close", KEY, TIME, n).alias(f"mom_{n}") for n in (5, 10, 20, 60)],
        F.col("vol20").alias("vol_20"),
        ratio(roll(F.stddev_samp, "ret", 5), F.col("vol20")).alias("vol_ratio"),
        (ratio("close", roll(F.avg, "close", 50)) - 1).alias("ma50_gap"),
        (ratio("close", roll(F.avg, "close", 200)) - 1).alias("ma200_gap"),
        (ratio("close", roll(F.max, "close", 252)) - 1).alias("high252_gap"),
        ratio("turnover", roll(F.avg, "turnover", 20)).alias("turnover_ratio_20"),
    )


def pair_features(bars: DataFrame, other: DataFrame, n: int = 60) -> DataFrame:
    """Other asset carried forward onto the bars' sessions: its return and 5-session momentum, z of the log ratio.

    ``other`` has (session, other_close). Both series are bounded by the calendar.
    """
    j = bars.join(other, TIME, "left").withColumn(
        "oc", F.last("other_close", ignorenulls=True).over(rows(KEY, TIME, None, 0)))
    j = j.withColumn("lr", F.ln(ratio("oc", "close")))
    z = ratio(F.col("lr") - roll(F.avg, "lr", n), roll(F.stddev_samp, "lr", n))
    return j.select(KEY, TIME, change("oc", KEY, TIME).alias("other_ret_1"),
                    change("oc", KEY, TIME, 5).alias("other_mom_5"), z.alias("ratio_z60"))


def band_label(bars: DataFrame, mult: float = 0.3) -> DataFrame:
    """Next-session return, volatility band and three-way class."""
    f = with_vol20(bars).withColumn("target_ret", ratio(ahead("close"), F.col("close")) - 1)
    f = f.withColumn("band", mult * F.col("vol20"))
    return f.select(KEY, TIME, "target_ret", "band", class_of("target_ret", "band").alias("y"))


def horizon_target(bars: DataFrame, h: int) -> DataFrame:
    """Return over h sessions from the previous close, its scale known the day before, and the maturity date."""
    f = with_vol20(bars)
    return f.select(
        KEY, F.col(TIME).alias("prediction_date"),
        (ratio(ahead("close", h - 1) if h > 1 else F.col("close"), lagged("close")) - 1).alias("future_return"),
        (lagged("vol20") * math.sqrt(h)).alias("sigma"),
        (ahead(TIME, h - 1) if h > 1 else F.col(TIME)).alias("matures"),
    ).dropna()


def with_log_legs(bars: DataFrame) -> DataFrame:
    legs = bars.withColumn("lo", F.ln(ratio("open", lagged("close")))).withColumn("li", F.ln(ratio("close", "open")))
    return legs


def leg_label_sums(bars: DataFrame, h: int) -> DataFrame:
    """Forward h-session sums of the log overnight and log intraday legs."""
    f = with_log_legs(bars)
    fw = rows(KEY, TIME, 0, h - 1)
    return f.select(KEY, TIME, guarded(F.sum, "lo", fw, h).alias("log_overnight"),
                    guarded(F.sum, "li", fw, h).alias("log_intraday"))


def cum_leg_features(bars: DataFrame, windows=(5, 20, 60)) -> DataFrame:
    """Cumulative overnight and intraday returns over each window, and their difference, known the session before."""
    f = with_log_legs(bars)
    for k in windows:
        f = f.withColumn(f"_o{k}", F.expm1(roll(F.sum, "lo", k))).withColumn(f"_i{k}", F.expm1(roll(F.sum, "li", k)))
    out = []
    for k in windows:
        o, i = lagged(f"_o{k}"), lagged(f"_i{k}")
        out += [o.alias(f"ovn_{k}"), i.alias(f"intra_{k}"), (o - i).alias(f"ovn_minus_intra_{k}")]
    return f.select(KEY, TIME, *out)


def gap_group_features(bars: DataFrame, n: int = 60, mult: float = 0.3) -> DataFrame:
    """Opening gap against the band and against its own last n sessions, all statistics ending the day before."""
    f = with_vol20(bars).withColumn("gap_0", ratio("open", lagged("close")) - 1)
    f = f.withColumn("band", F.nullif(mult * lagged("vol20"), F.lit(0.0)))
    mean, dev = roll(F.avg, "gap_0", n, 1), roll(F.stddev_samp, "gap_0", n, 1)
    both = F.col("gap_0").isNotNull() & F.col("band").isNotNull()
    flag = lambda c: F.when(both, c.cast("double"))
    return f.select(
        KEY, TIME, "gap_0", ratio("gap_0", "band").alias("gap_over_band"),
        ratio(F.col("gap_0") - mean, dev).alias("gap_z60"), F.abs("gap_0").alias("gap_abs"),
        flag(F.col("gap_0") > F.col("band")).alias("gap_up_band"),
        flag(F.col("gap_0") < -F.col("band")).alias("gap_down_band"),
    )


def causal_channels(bars: DataFrame, n: int = 20) -> DataFrame:
    """Five scale-free channels per bar, each relative to the previous close or the previous n volumes."""
    pc = lagged("close")
    rel = lambda x: ratio(x, pc) - 1
    return bars.select(KEY, TIME, rel("close").alias("close_ret"), rel("open").alias("open_gap"),
                       rel("high").alias("high_rel"), rel("low").alias("low_rel"),
                       (ratio("volume", roll(F.avg, "volume", n, 1)) - 1).alias("volume_rel"))


SIGNALS = ("down_streak", "drop_5d", "drop_1d", "off_high_20d", "up_streak", "rise_5d", "rise_1d")


def chart_signals(bars: DataFrame) -> DataFrame:
    """Run lengths of falling and rising closes and the seven chart flags of each session."""
    f = bars.withColumn("ret", change("close", KEY, TIME)).withColumn(
        "dir", F.when(F.col("ret") < 0, -1).when(F.col("ret") > 0, 1).otherwise(0))
    f = add_streak(f, "dir", KEY, TIME, "run")
    f = f.withColumn("ret_5d", change("close", KEY, TIME, 5)).withColumn(
        "off_high", ratio("close", roll(F.max, "close", 20)) - 1)
    down = F.when(F.col("dir") == -1, F.col("run")).otherwise(0)
    up = F.when(F.col("dir") == 1, F.col("run")).otherwise(0)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return f.select(
        KEY, TIME, "close", "ret", "ret_5d", "off_high", down.alias("down_run"), up.alias("up_run"),
        (down >= 3).alias("down_streak"), yes(F.col("ret_5d") <= -0.08).alias("drop_5d"),
        yes(F.col("ret") <= -0.04).alias("drop_1d"), yes(F.col("off_high") <= -0.10).alias("off_high_20d"),
        (up >= 3).alias("up_streak"), yes(F.col("ret_5d") >= 0.08).alias("rise_5d"),
        yes(F.col("ret") >= 0.04).alias("rise_1d"),
    )


def rolling_position(bars: DataFrame, windows=(20, 60, 120), peak: int = 756) -> DataFrame:
    """Place inside the trailing range, gap to the moving average, fall from the trailing peak."""
    out = [KEY, TIME]
    for n in windows:
        lo, hi = roll(F.min, "close", n), roll(F.max, "close", n)
        out.append(F.when(hi > lo, ratio(col("close") - lo, hi - lo)).when(hi == lo, 0.5).alias(f"position_{n}"))
        out.append((ratio("close", roll(F.avg, "close", n)) - 1).alias(f"ma_gap_{n}"))
    top = F.max("close").over(rows(KEY, TIME, -(peak - 1), 0))
    return bars.select(*out, (ratio("close", top) - 1).alias("drawdown"))


def moving_average_touch(bars: DataFrame, windows=(5, 20, 60)) -> DataFrame:
    """How the day's range met the averages known before it: support, resistance, reclaim, fail."""
    levels = F.array(*[F.struct(F.lit(n).alias("ma"), roll(F.avg, "close", n, 1).alias("level")) for n in windows])
    f = bars.withColumn("ms", levels).withColumn("m", F.explode("ms")).select(KEY, TIME, "low", "high", "close", "m.*").filter("level is not null")
    lo, hi, c, m = (F.col(x) for x in ("low", "high", "close", "level"))
    kind = (
        F.when(lo.between(m * 0.99, m * 1.005) & (c > m * 1.005), "support")
        .when(hi.between(m * 0.995, m * 1.01) & (c < m * 0.995), "resistance")
        .when((lo < m * 0.99) & (c > m), "reclaim")
        .when((hi > m * 1.01) & (c < m), "fail")
    )
    price = F.when(kind.isin("support", "reclaim"), lo).otherwise(hi)
    return f.withColumn("kind", kind).filter("kind is not null").select(KEY, TIME, "ma", "level", "kind", price.alias("price"))


def price_context(bars: DataFrame, peer: DataFrame) -> DataFrame:
    """Prior highs and breakouts, and returns beside a peer on the same sessions; gaps withhold the value.

    ``peer`` has (session, peer_close).
    """
    j = bars.join(peer, TIME, "left")
    out = [KEY, TIME]
    for n in (20, 60):
        top = roll(F.max, "high", n, 1)
        out += [top.alias(f"prior_high_{n}"), (ratio("close", top) - 1).alias(f"distance_{n}"),
                (col("close") > top).alias(f"close_breakout_{n}"), (col("high") > top).alias(f"intraday_breakout_{n}")]
    for n in (5, 20, 60):
        frame = rows(KEY, TIME, -n, 0)
        full = (F.count("peer_close").over(frame) == n + 1) & (F.count("close").over(frame) == n + 1)
        own, other = change("close", KEY, TIME, n), change("peer_close", KEY, TIME, n)
        out += [F.when(full, own - other).alias(f"excess_{n}")]
    return j.select(*out)


def foreign_pressure(flows: DataFrame) -> DataFrame:
    """Net buying over volume, last 5 sessions against the 5 before, as one of six states."""
    net = "foreign_net"
    ok = (F.count(net).over(rows(KEY, TIME, -9, 0)) == 10) & (F.count("volume").over(rows(KEY, TIME, -9, 0)) == 10)
    old, new = rows(KEY, TIME, -9, -5), rows(KEY, TIME, -4, 0)
    f = flows.select(
        KEY, TIME, ok.alias("ok"), F.sum(net).over(old).alias("before"), F.sum(net).over(new).alias("after"),
        F.sum("volume").over(old).alias("v_old"), F.sum("volume").over(new).alias("v_new"),
    ).filter("ok")
    r0, r1 = ratio("before", "v_old"), ratio("after", "v_new")
    b, a = F.col("before"), F.col("after")
    same = F.abs(r0 - r1) <= 1e-12 + 1e-9 * F.abs(r1)
    state = (
        F.when((b < 0) & (a < 0), F.when(same, "selling_unchanged").when(r1 > r0, "selling_eased").otherwise("selling_intensified"))
        .when((b <= 0) & (a > 0), "turned_buying").when((b >= 0) & (a < 0), "turned_selling").otherwise("other")
    )
    return f.select(KEY, TIME, state.alias("state"), r0.alias("previous_ratio"), r1.alias("recent_ratio"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    """Deepest fall of the close from its running peak, per instrument."""
    peak = F.max("close").over(rows(KEY, TIME, None, 0))
    return bars.withColumn("dd", ratio("close", peak) - 1).groupBy(KEY).agg(F.min("dd").alias("max_drawdown"))


def expanding_z(df: DataFrame, x: str, by=KEY, order=TIME, least: int = 60, out: str = "z") -> DataFrame:
    """Distance from the expanding mean in expanding deviations; zero deviation is missing."""
    w = rows(by, order, None, 0)
    return df.withColumn(out, ratio(col(x) - guarded(F.avg, x, w, least), guarded(F.stddev_samp, x, w, least)))


def flow_features(flows: DataFrame) -> DataFrame:
    """Net buying scaled by 20-day volume, sums with their own minimum counts, and the signed streak."""
    f = flows.withColumn("v20", F.nullif(roll(F.avg, "volume", 20, least=10), F.lit(0.0)))
    f = f.withColumn("frgn", ratio("foreign_net", "v20")).withColumn("inst", ratio("inst_net", "v20"))
    f = f.withColumn("sgn", F.signum(F.coalesce("foreign_net", F.lit(0.0))).cast("int"))
    f = add_streak(f, "sgn", KEY, TIME, "run")
    return f.select(
        KEY, TIME, F.col("frgn").alias("flow_frgn_1"),
        roll(F.sum, "frgn", 5, least=3).alias("flow_frgn_5"), roll(F.sum, "frgn", 20, least=10).alias("flow_frgn_20"),
        (F.col("run") * F.col("sgn")).cast("bigint").alias("flow_frgn_streak"),
        roll(F.sum, "inst", 5, least=3).alias("flow_inst_5"),
        (F.col("foreign_ratio") - lagged("foreign_ratio", 20)).alias("flow_frgn_ratio_chg_20"),
    )


def implied_vol_scale(levels: DataFrame, x: str, n: int = 250) -> DataFrame:
    """Level over the median of the previous n values (at least half of them), kept within [0.5, 3]."""
    frame = rows(KEY, TIME, -n, -1)
    mid = F.when(F.count(x).over(frame) >= n // 2, median(x).over(frame))
    f = levels.withColumn("_r", ratio(x, mid))
    return f.select(KEY, TIME, F.when(F.col("_r").isNotNull(), F.least(F.greatest("_r", F.lit(0.5)), F.lit(3.0))).alias("scale"))


def wave_signal(bars: DataFrame) -> DataFrame:
    """Daily screen for a range rebound and a trend pullback, with the reasons a session fails."""
    n = F.count(F.lit(1)).over(rows(KEY, TIME, None, 0))
    f = bars.select(
        KEY, TIME, "close", n.alias("seen"),
        roll(F.min, "low", 20, 2).alias("lo"), roll(F.max, "high", 20, 2).alias("hi"),
        lagged("close").alias("pc"), lagged("high").alias("ph"),
        roll(F.avg, "close", 20).alias("ma20"), roll(F.avg, "close", 60).alias("ma60"),
        roll(F.avg, "close", 20, 1).alias("ma20_prev"), roll(F.avg, "close", 20, 5).alias("ma20_5"),
        roll(F.min, "low", 5).alias("stop"),
    ).filter("seen >= 65 and hi > lo")
    f = f.withColumn("slope", ratio("ma20", "ma20_5") - 1).withColumn(
        "position", ratio(F.col("pc") - F.col("lo"), F.col("hi") - F.col("lo")))
    sideways = F.abs("slope") <= 0.01
    rising = (F.col("slope") > 0) & (F.col("ma20") > F.col("ma60"))
    late = F.when(F.col("close") <= F.col("ph"), "rebound_unconfirmed")
    reasons = {
        "range_rebound": [F.when(~sideways, "not_sideways"), F.when(~F.col("position").between(0, 0.2), "outside_lower_range"), late],
        "trend_pullback": [F.when(~rising, "not_uptrend"), F.when(F.col("pc") > F.col("ma20_prev"), "no_pullback"),
                           F.when(F.col("close") <= F.col("ma20"), "average_not_recovered"), late],
    }
    regimes = {"range_rebound": F.when(sideways, "range").otherwise("trend"),
               "trend_pullback": F.when(rising, "uptrend").otherwise("other")}
    both = F.array(*[
        F.struct(F.lit(s).alias("strategy"), regimes[s].alias("regime"),
                 F.array_join(F.filter(F.array(*r), lambda x: x.isNotNull()), ",").alias("reasons"))
        for s, r in reasons.items()])
    f = f.withColumn("s", F.explode(both))
    return f.select(
        KEY, TIME, "s.strategy", "s.regime", F.when(F.col("s.reasons") == "", "enter").otherwise("wait").alias("action"),
        F.when(F.col("s.reasons") == "", F.concat("s.strategy", F.lit("_confirmed"))).otherwise(F.col("s.reasons")).alias("reason_codes"),
        "position", F.col("stop").alias("reference_stop"))


def credit_gauge(df: DataFrame, x: str, by=KEY, order=TIME) -> DataFrame:
    """Spread against its 60-row low and the last 10 rows against the 10 before, as three labels."""
    low = rolling(F.min, x, by, order, 60)
    f = df.select(by, order, ((col(x) - low) * 100).alias("off_low_bp"),
                  (rolling(F.avg, x, by, order, 10) - rolling(F.avg, x, by, order, 10, shift=10)).alias("trend")).dropna()
    label = (F.when((F.col("off_low_bp") >= 15) & (F.col("trend") > 0), "rising")
             .when((F.col("off_low_bp") < 5) & (F.col("trend") <= 0), "calm").otherwise("mixed"))
    return f.withColumn("label", label)


def session_index(bars: DataFrame, out="pos") -> DataFrame:
    return bars.withColumn(out, F.row_number().over(series(KEY, TIME)))

