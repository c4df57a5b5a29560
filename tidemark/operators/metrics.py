"""Accuracy, reliability, conditional outcome and growth statistics.

Group keys are models, instruments or series. Quantiles and ranks over all rows of a model use
``ranks`` (histogram and ranges); exact ``percentile`` serves groups bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prob
from ..session import cut_lineage
from . import bars as B
from . import ranks
from .frames import change, col, names, nxt, prev, ratio, rows, series

KEY, TIME = "instrument", "session"


def n_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def mean_if(c: Column, x) -> Column:
    return F.avg(F.when(c, col(x)))


# ---- ledgers -----------------------------------------------------------------------------


def ledger_status_counts(ledger: DataFrame, last_bar, by=("instrument", "model", "horizon_days")) -> DataFrame:
    """Issued, held, matured, scored and pending counts, and how many matured dates can be kept without overlap.

    The greedy pick walks the distinct dates of a group, bounded by the calendar.
    """
    by = names(by)
    p = ledger.filter("kind = 'price'").withColumn("matured", F.col("target_date") <= last_bar)
    c = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), n_if(F.col("is_prospective")).alias("n_prospective"),
        n_if(F.col("signal").isin("yes", "unverified")).alias("n_issued"), n_if(F.col("signal") == "no").alias("n_held"),
        n_if(F.col("matured")).alias("n_matured"), n_if(F.col("status") == "scored").alias("n_scored"),
        n_if(F.col("status") == "pending").alias("n_pending"),
        F.array_sort(F.collect_set(F.when(F.col("matured"), F.col("prediction_date")))).alias("_d"))
    typ = "struct<n:int,last:date>"
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("last")).cast(typ)
    far = lambda acc, d: acc["last"].isNull() | (F.datediff(d, acc["last"]) >= 7 * F.col("horizon_days") / 5)
    walk = F.aggregate("_d", start, lambda acc, d: F.when(
        far(acc, d), F.struct((acc["n"] + 1).alias("n"), d.alias("last")).cast(typ)).otherwise(acc))
    return c.withColumn("n_nonoverlap", walk["n"]).drop("_d")


# ---- classification ----------------------------------------------------------------------


def class_prior(rows_: DataFrame, by, y="actual_class") -> DataFrame:
    """Class shares (clipped, renormalised), the log loss of predicting them, and the share of the commonest class."""
    share = [F.avg((F.col(y) == k).cast("double")) for k in range(3)]
    g = rows_.filter(F.col(y).isNotNull()).groupBy(*names(by)).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"f{k}") for k, s in enumerate(share)])
    clip = [F.greatest(F.col(f"f{k}"), F.lit(1e-7)) for k in range(3)]
    total = clip[0] + clip[1] + clip[2]
    loss = sum((-F.col(f"f{k}") * F.ln(clip[k]) for k in (1, 2)), -F.col("f0") * F.ln(clip[0]))
    return g.select(*names(by), "n", *[(clip[k] / total).alias(f"prior_{k}") for k in range(3)],
                    loss.alias("prior_log_loss"), F.greatest("f0", "f1", "f2").alias("prior_hit_rate"))


def bucket_conditional(train: DataFrame, by, bucket="bucket", y="y", alpha: float = 1.0, least: int = 20) -> DataFrame:
    """Smoothed class shares per rule bucket; a bucket under ``least`` rows takes the shares of all rows."""
    by = names(by)
    counts = [n_if(F.col(y) == k).alias(f"c{k}") for k in range(3)]
    g = train.groupBy(*by, bucket).agg(*counts)
    a = g.groupBy(*by).agg(*[F.sum(f"c{k}").alias(f"a{k}") for k in range(3)])
    j = g.join(a, by)
    n = F.col("c0") + F.col("c1") + F.col("c2")
    na = F.col("a0") + F.col("a1") + F.col("a2")
    p = [F.when(n < least, (F.col(f"a{k}") + alpha) / (na + 3 * alpha)).otherwise((F.col(f"c{k}") + alpha) / (n + 3 * alpha)) for k in range(3)]
    return j.select(*by, bucket, n.alias("n"), *[p[k].alias(f"p{k}") for k in range(3)])


def _confidence(df: DataFrame, y="actual_class") -> DataFrame:
    p = prob.vector()
    return df.filter(F.col(y).isNotNull()).withColumn("conf", F.array_max(p)).withColumn("hit", (prob.argmax(p) == F.col(y)).cast("double"))


def reliability_bins(df: DataFrame, by, bins: int = 5) -> DataFrame:
    """Rows, mean confidence and hit rate per equal bin of the maximum probability on [1/3, 1]."""
    width = (1 - 1 / 3) / bins
    b = F.least(F.floor((F.col("conf") - 1 / 3) / width), F.lit(bins - 1)).cast("int")
    return _confidence(df).withColumn("bin", b).groupBy(*names(by), "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_confidence"), F.avg("hit").alias("hit_rate"))


def abstention_table(df: DataFrame, by, thresholds=(0.0, 0.5, 0.6, 0.7)) -> DataFrame:
    """Coverage and accuracy when only rows above a confidence threshold count."""
    sums = []
    for t in thresholds:
        chosen = F.col("conf") >= t
        sums.append(F.struct(F.lit(float(t)).alias("threshold"), n_if(chosen).alias("selected"), F.count(F.lit(1)).alias("total"),
                             mean_if(chosen, "hit").alias("selected_accuracy"), F.avg("hit").alias("overall_accuracy")))
    g = _confidence(df).groupBy(*names(by)).agg(F.array(*sums).alias("t"))
    return g.select(*names(by), F.explode("t").alias("t")).select(*names(by), "t.*").withColumn("coverage", F.col("selected") / F.col("total"))


def balanced_accuracy(df: DataFrame, by) -> DataFrame:
    """Mean recall over the classes that occur."""
    r = _confidence(df).groupBy(*names(by), "actual_class").agg(F.avg("hit").alias("recall"))
    return r.groupBy(*names(by)).agg(F.count(F.lit(1)).alias("classes"), F.avg("recall").alias("balanced_accuracy"))


def sign_auc(df: DataFrame, by, score: str, leg: str, least: int = 30) -> DataFrame:
    """AUC of a score against the sign of a return leg; zero legs are left out."""
    f = df.filter((F.col(leg) != 0) & F.col(score).isNotNull()).withColumn("_up", F.col(leg) > 0)
    return ranks.auc(f, by, score, "_up", least)


def session_pnl(df: DataFrame, by, ret: str, predicted: str, cost_bp: float = 20.0) -> DataFrame:
    """Mean basis points of trading the predicted direction open to close, before and after cost; flat is not traded."""
    side = F.when(F.col(predicted) == 2, 1.0).when(F.col(predicted) == 0, -1.0)
    g = F.avg(side * F.col(ret)) * 1e4
    return df.groupBy(*names(by)).agg(F.count(side * F.col(ret)).alias("traded"), g.alias("gross_bp"), (g - cost_bp).alias("net_bp"))


# ---- prices and intervals ----------------------------------------------------------------


def with_season(df: DataFrame, of, date: str, y: str, days: int = 364, reach: int = 7) -> DataFrame:
    """Adds ``season``: what the same series ``of`` came to ``days`` earlier, or on the last of ``reach`` days before that.

    The lookup runs on one row per series and date (the largest outcome, where rows disagree), bounded by the calendar.
    """
    of = names(of)
    known = df.filter(F.col(y).isNotNull()).groupBy(*of, date).agg(F.max(y).alias("_y")).withColumn("_d", F.unix_date(date))
    past = F.max(F.struct("_d", "_y")).over(series(of, "_d").rangeBetween(-days - reach, -days))
    return df.join(known.select(*of, date, past["_y"].alias("season")), [*of, date], "left")


def score_errors(df: DataFrame, by, y: str, p: str, of=KEY, date: str = "target_date") -> DataFrame:
    """MAE, RMSE, hit where the prediction is not zero, guarded MAPE, correlation, residual deciles, naive comparison.

    The naive forecasts are zero (no change) and what the series ``of`` came to 52 weeks earlier. ``beats_zero`` takes all
    rows; ``beats_both`` compares the three errors over the ``n_both`` rows whose series has an outcome that far back.
    """
    by, of = names(by), names(of)
    e = F.col(y) - F.col(p)
    keys = list(dict.fromkeys([*by, *of, date]))
    rows_ = cut_lineage(with_season(cut_lineage(df.select(*keys, y, p).filter(F.col(y).isNotNull())), of, date, y))
    f = rows_.filter(F.col(p).isNotNull()).withColumn("_e", e)
    both = lambda x: mean_if(F.col("season").isNotNull(), x)
    base = f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.col(p) != 0, (F.signum(p) == F.signum(y)).cast("double"))).alias("hit"), n_if(F.col(p) != 0).alias("direction_n"),
        F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))).alias("mape"), F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p)).alias("corr"),
        F.avg(F.abs(y)).alias("mae_zero"), F.count("season").alias("n_both"), both(F.abs(e)).alias("mae_both"),
        both(F.abs(y)).alias("mae_zero_both"), F.avg(F.abs(F.col(y) - F.col("season"))).alias("mae_seasonal"))
    q = ranks.quantiles(f, by, "_e", {"resid_q10": 0.1, "resid_q90": 0.9})
    return base.join(q, by).withColumn("beats_zero", F.col("mae") < F.col("mae_zero")).withColumn(
        "beats_both", F.col("mae_both") < F.least("mae_zero_both", "mae_seasonal"))


def interval_scores(df: DataFrame, by, y: str, lo: str, hi: str, coverage: float = 0.8) -> DataFrame:
    f = df.filter(F.col(y).isNotNull() & F.col(lo).isNotNull())
    hit = ((F.col(lo) <= F.col(y)) & (F.col(y) <= F.col(hi))).cast("double")
    return f.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(prob.interval_score(F.col(y), F.col(lo), F.col(hi), coverage)).alias("score"),
        F.avg(hit).alias("coverage"), F.avg(F.col(hi) - F.col(lo)).alias("width"))


def regime_table(df: DataFrame, by, sigma: str, calibration: Column, y: str, raw: str, slope: float, hit: str) -> DataFrame:
    """Errors and coverage of evaluation rows in low, mid and high volatility; cuts come from calibration rows only."""
    by = names(by)
    cuts = ranks.quantiles(df.filter(calibration), by, sigma, {"q1": 1 / 3, "q2": 2 / 3})
    e = df.filter(~calibration).join(cuts, by)
    regime = F.when(F.col(sigma) <= F.col("q1"), "low").when(F.col(sigma) <= F.col("q2"), "mid").otherwise("high")
    return e.withColumn("regime", regime).groupBy(*by, "regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(y)).alias("zero_mae"), F.avg(F.abs(F.col(y) - F.col(raw))).alias("raw_mae"),
        F.avg(F.abs(F.col(y) - slope * F.col(raw))).alias("shrunk_mae"), F.avg(hit).alias("interval_coverage"))


def nonoverlap_offsets(df: DataFrame, by, order: str, h: int, y: str, raw: str, slope: float) -> DataFrame:
    """Every h-th row from each starting offset: mean gain in absolute error over predicting zero."""
    f = df.withColumn("_i", F.row_number().over(series(by, order))).withColumn("offset", ((F.col("_i") - 1) % h).cast("int"))
    gain = lambda s: F.avg(F.abs(F.col(y) - s * F.col(raw)) - F.abs(y))
    return f.groupBy(*names(by), "offset").agg(F.count(F.lit(1)).alias("n"), gain(1.0).alias("raw_minus_zero"), gain(slope).alias("shrunk_minus_zero"))


def describe(x) -> list[Column]:
    """n, median, quartiles and share above zero of a bounded group."""
    q = lambda p: F.percentile(col(x), F.lit(p))
    return [F.count(col(x)).alias("n"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"),
            F.avg((col(x) > 0).cast("double")).alias("up_share")]


def describe_conditional(bars: DataFrame, n: int = 60, ahead: int = 20, band: float = 0.1, least: int = 20) -> DataFrame:
    """Forward returns of past sessions at today's place in the range, beside all sessions; too few stay empty."""
    lo, hi = B.roll(F.min, "close", n), B.roll(F.max, "close", n)
    f = bars.select(KEY, TIME, ratio(col("close") - lo, hi - lo).alias("place"), (ratio(nxt("close", KEY, TIME, ahead), "close") - 1).alias("fwd"))
    now = f.groupBy(KEY).agg(F.max_by("place", TIME).alias("now"))
    v = f.filter("place is not null and fwd is not null").join(now, KEY)
    tagged = v.withColumn("sample", F.explode(F.array(F.lit("all"), F.when(F.abs(F.col("place") - F.col("now")) <= band, "similar")))).filter("sample is not null")
    g = tagged.groupBy(KEY, "sample").agg(*describe("fwd"))
    return g.select(KEY, "sample", "n", *[F.when((F.col("sample") == "all") | (F.col("n") >= least), F.col(c)).alias(c)
                                          for c in ("median", "q25", "q75", "up_share")])


def chart_situation_stats(bars: DataFrame, since: str, least: int = 20, mult: float = 0.3, wide: float = 2.0) -> DataFrame:
    """What followed each chart signal: recent sample, widened to all history when small, against the base shares."""
    s = B.chart_signals(bars).join(B.with_vol20(bars).select(KEY, TIME, "vol20"), [KEY, TIME])
    s = s.withColumn("cls", B.class_of("ret", mult * prev("vol20", KEY, TIME)))
    s = s.withColumn("nc", nxt("cls", KEY, TIME)).withColumn("nr", nxt("ret", KEY, TIME)).withColumn(
        "n5", ratio(nxt("close", KEY, TIME, 5), "close") - 1).filter("nc is not null")
    s = s.withColumn("recent", F.col(TIME) >= F.lit(since).cast("date"))
    flags = F.array(F.lit("base"), *[F.when(F.col(x), x) for x in B.SIGNALS])
    long = s.withColumn("signal", F.explode(F.filter(flags, lambda x: x.isNotNull())))
    r = F.col("recent")
    pick = lambda a, b: F.when(F.col("_nr") >= least, a).otherwise(b)
    parts = {"down": F.col("nc") == 0, "flat": F.col("nc") == 1, "up": F.col("nc") == 2}
    g = long.groupBy(KEY, "signal").agg(
        n_if(r).alias("_nr"), F.count(F.lit(1)).alias("_na"),
        *[mean_if(r, c.cast("double")).alias(f"_r_{k}") for k, c in parts.items()], *[F.avg(c.cast("double")).alias(f"_a_{k}") for k, c in parts.items()],
        mean_if(r, "nr").alias("_r_next"), F.avg("nr").alias("_a_next"), mean_if(r, "n5").alias("_r_5"), F.avg("n5").alias("_a_5"))
    g = g.select(KEY, "signal", pick(F.lit("recent"), F.lit("all")).alias("scope"), pick(F.col("_nr"), F.col("_na")).alias("n"),
                 *[pick(F.col(f"_r_{k}"), F.col(f"_a_{k}")).alias(k) for k in parts],
                 pick(F.col("_r_next"), F.col("_a_next")).alias("mean_next"), pick(F.col("_r_5"), F.col("_a_5")).alias("mean_5d"),
                 F.col("_r_up"), F.col("_a_up"))
    base = g.filter("signal = 'base'").select(KEY, F.col("_r_up").alias("_bu_r"), F.col("_a_up").alias("_bu_a"))
    j = g.join(base, KEY).withColumn("_bu", F.when(F.col("scope") == "recent", F.col("_bu_r")).otherwise(F.col("_bu_a")))
    far = F.abs(F.col("up") - F.col("_bu")) > wide * F.sqrt(F.col("_bu") * (1 - F.col("_bu")) / F.col("n"))
    return j.filter("signal <> 'base'").select(KEY, "signal", "scope", "n", *parts, "mean_next", "mean_5d", far.alias("up_differs"))


# ---- series ------------------------------------------------------------------------------


def monthly_resample(daily: DataFrame, by, date: str, value: str, least: int = 10) -> DataFrame:
    """Monthly mean and last value; a month counts only when its days are many and reach both ends."""
    m = F.trunc(date, "MM").alias("month")
    g = daily.groupBy(*names(by), m).agg(F.avg(value).alias("mean_value"), F.max_by(value, date).alias("last_value"),
                                         F.count(value).alias("n"), F.min(date).alias("_a"), F.max(date).alias("_b"))
    whole = (F.col("n") >= least) & (F.day("_a") <= 7) & (F.col("_b") >= F.date_sub(F.last_day("month"), 7))
    return g.filter(whole).drop("_a", "_b")


def trailing_returns(bars: DataFrame, benchmark: DataFrame, years=(1, 3, 5)) -> DataFrame:
    """Returns since N years ago and this year, growth rate, drawdown, volatility, and excess over a benchmark.

    ``benchmark``: (session, bench_close); the excess uses the dates both have.
    """
    f = bars.withColumn("ret", change("close", KEY, TIME)).withColumn(
        "dd", ratio("close", F.max("close").over(rows(KEY, TIME, None, 0))) - 1)
    f = f.withColumn("today", F.max(TIME).over(Window.partitionBy(KEY)))
    f = f.join(benchmark, TIME, "left")
    base = lambda c: F.max_by("close", F.when(c, F.col(TIME)))
    has = lambda c: F.max(c.cast("int")) == 1
    aggs = [F.min(TIME).alias("first"), F.max(TIME).alias("last"), F.min_by("close", TIME).alias("c0"), F.max_by("close", TIME).alias("c1"),
            F.min("dd").alias("max_drawdown"), (F.stddev_samp("ret") * math.sqrt(252)).alias("volatility"), F.max("close").alias("peak")]
    for y in years:
        old = F.col(TIME) <= F.date_sub("today", 365 * y)
        aggs.append(F.when(has(old), base(old)).alias(f"b{y}"))
    ytd = F.col(TIME) < F.trunc("today", "year")
    aggs.append(F.when(has(ytd), base(ytd)).alias("b_ytd"))
    both = F.when(F.col("bench_close").isNotNull(), F.col(TIME))
    for tag, pick in (("0", F.min_by), ("1", F.max_by)):
        aggs += [pick("close", both).alias(f"o{tag}"), pick("bench_close", both).alias(f"m{tag}")]
    g = f.groupBy(KEY).agg(*aggs)
    since = lambda b: ratio("c1", b) - 1
    yrs = F.datediff("last", "first") / 365.25
    total = since("c0")
    return g.select(KEY, total.alias("total"), *[since(f"b{y}").alias(f"ret_{y}y") for y in years], since("b_ytd").alias("ytd"),
                    F.when(yrs > 0.5, F.pow(1 + total, 1 / yrs) - 1).alias("cagr"), "max_drawdown", "volatility",
                    (ratio("c1", "peak") - 1).alias("from_peak"), (ratio("o1", "o0") - ratio("m1", "m0")).alias("excess"))


def excess_summary(table: DataFrame) -> DataFrame:
    """How many instruments beat the benchmark, the median excess, and the equal-weight basket."""
    return table.withColumn("all_rows", F.lit("all")).groupBy("all_rows").agg(
        F.count("excess").alias("n"), n_if(F.col("excess") > 0).alias("n_beat"), F.percentile("excess", F.lit(0.5)).alias("median_excess"),
        F.avg("total").alias("basket"))


def calendar_years(bars: DataFrame) -> DataFrame:
    """Return of each calendar year; the first year starts at the first close."""
    y = bars.groupBy(KEY, F.year(TIME).alias("year")).agg(F.max_by("close", TIME).alias("end"), F.min_by("close", TIME).alias("start"))
    base = F.coalesce(prev("end", KEY, "year"), F.col("start"))
    return y.select(KEY, "year", (ratio("end", base) - 1).alias("ret"), prev("end", KEY, "year").isNull().alias("partial"))


def two_regressor_fit(df: DataFrame, by, y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on a and b in closed form from covariances; one partial aggregation pass."""
    v = lambda p, q: F.covar_pop(p, q)
    g = df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), v(a, a).alias("aa"), v(b, b).alias("bb"),
        v(a, b).alias("ab"), v(a, y).alias("ay"), v(b, y).alias("by"), v(y, y).alias("yy"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    ca = F.try_divide(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det)
    cb = F.try_divide(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det)
    g = g.withColumn("coef_a", ca).withColumn("coef_b", cb)
    return g.select(*names(by), "n", (F.col("my") - F.col("coef_a") * F.col("ma") - F.col("coef_b") * F.col("mb")).alias("const"), "coef_a", "coef_b",
                    F.try_divide(F.col("coef_a") * F.col("ay") + F.col("coef_b") * F.col("by"), F.col("yy")).alias("r2"))


def fair_value(df: DataFrame, by, order: str, y: str, a: str, b: str, fixed=(0.0, 1.0, 0.0)) -> DataFrame:
    """Fit of a log level on two log inputs: fixed-coefficient gap, refit, and the first half's fit on the second half."""
    by = names(by)
    f = df.dropna(subset=[y, a, b]).withColumn("_i", F.row_number().over(series(by, order)))
    n = f.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    f = f.join(n, by).withColumn("early", F.col("_i") <= F.floor(F.col("_n") / 2))
    fit = two_regressor_fit(f, by, y, a, b)
    half = two_regressor_fit(f.filter("early"), by, y, a, b).select(*by, F.col("const").alias("h0"), F.col("coef_a").alias("h1"), F.col("coef_b").alias("h2"))
    late = f.filter("not early").join(half, by)
    resid = F.col(y) - (F.col("h0") + F.col("h1") * F.col(a) + F.col("h2") * F.col(b))
    oos = late.groupBy(*by).agg((1 - F.try_divide(F.sum(resid * resid), F.var_pop(y) * F.count(F.lit(1)))).alias("oos_r2"))
    gap = F.exp(F.col(y) - (fixed[0] + fixed[1] * F.col(a) + fixed[2] * F.col(b))) - 1
    last = f.groupBy(*by).agg(F.max_by(gap, order).alias("last_gap"))
    return fit.join(oos, by).join(last, by).withColumn("stable", F.col("oos_r2") > 0)


def pair_regression(pairs: DataFrame, by, order: str, a: str, b: str, recent: int = 36, cross: int = 60) -> DataFrame:
    """Co-movement of two monthly series: correlation (all, recent), beta, volatility ratio, cross-rate z, yearly changes, implied level."""
    by = names(by)
    f = pairs.filter((F.col(a) > 0) & (F.col(b) > 0))
    f = f.withColumn("da", F.ln(a) - prev(F.ln(a), by, order)).withColumn("db", F.ln(b) - prev(F.ln(b), by, order))
    f = f.withColumn("x", F.col(a) / F.col(b)).withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc())))
    late = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    pa, pb = (ratio(c, prev(c, by, order, 12)) - 1 for c in (a, b))
    f = f.withColumn("a12", pa).withColumn("b12", pb)
    g = f.groupBy(*by).agg(
        F.count("da").alias("n"), F.corr("da", "db").alias("corr_all"), F.corr(late(recent, "da"), late(recent, "db")).alias("corr_recent"),
        F.try_divide(F.covar_samp("da", "db"), F.var_samp(F.when(F.col("da").isNotNull(), F.col("db")))).alias("beta"),
        F.try_divide(F.stddev_samp("da"), F.stddev_samp("db")).alias("vol_ratio"),
        F.max_by("x", order).alias("_x"), F.avg(late(cross, "x")).alias("_mx"), F.stddev_samp(late(cross, "x")).alias("_sx"),
        F.max_by("a12", order).alias("change_a"), F.max_by("b12", order).alias("change_b"),
        F.regr_slope(late(120, a), late(120, b)).alias("_s"), F.regr_intercept(late(120, a), late(120, b)).alias("_c"), F.max_by(b, order).alias("_b"))
    return g.filter(F.col("n") >= recent).select(
        *by, "n", "corr_all", "corr_recent", "beta", "vol_ratio", ratio(F.col("_x") - F.col("_mx"), "_sx").alias("cross_z"), "change_a", "change_b",
        (F.col("_s") * F.col("_b") + F.col("_c")).alias("implied"))


def log_trend_growth(monthly: DataFrame, by, order: str, value: str, start, least: int = 30, base_min: float = 1.0) -> DataFrame:
    """Yearly growth by the slope of ln(v+1), the first and last year means, a spike flag, or the reason there is none."""
    by = names(by)
    f = monthly.withColumn("_i", F.row_number().over(series(by, order)) - 1)
    f = f.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("_t", F.col("_i") / 12).withColumn("_l", F.ln(F.col(value) + 1))
    g = f.groupBy(*by).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.regr_slope("_l", "_t").alias("slope"), F.regr_intercept("_l", "_t").alias("icpt"),
        mean_if(F.col("_i") < 12, value).alias("base"), mean_if(F.col("_i") >= F.col("_n") - 12, value).alias("recent"))
    tail = f.filter(F.col("_i") >= F.col("_n") - 12).join(g.select(*by, "slope", "icpt"), by).groupBy(*by).agg(
        F.avg(F.exp(F.col("icpt") + F.col("slope") * F.col("_t")) - 1).alias("predicted"))
    why = F.when(F.col("first") > start, "starts_late").when(F.col("n") < least, "too_short").when(F.col("base") < base_min, "base_too_small")
    j = g.join(tail, by).withColumn("reason", why)
    ok = F.col("reason").isNull()
    return j.select(*by, "n", "base", "recent", "reason", F.when(ok, F.expm1("slope")).alias("growth"),
                    F.when(ok, (F.col("predicted") > 0) & (F.try_divide(F.col("recent"), F.col("predicted")) >= 2.0)).alias("spike"))


def anchor_rescale(batches: DataFrame, anchor: Column) -> DataFrame:
    """Every batch on the scale of batch 0: value times the ratio of the anchor means; small anchors leave values as they are."""
    m = batches.filter(anchor).groupBy("batch").agg(F.avg("value").alias("_m"))
    zero = batches.filter(anchor & (F.col("batch") == 0)).agg(F.avg("value")).scalar()
    j = batches.join(m, "batch", "left")
    k = F.when(F.col("_m") > 1, zero / F.col("_m")).otherwise(1.0)
    return j.withColumn("value", F.col("value") * k).drop("_m")


def variance_ratio(df: DataFrame, by, order: str, x: str, qs=(2, 3, 6, 12)) -> DataFrame:
    """Variance ratio at each q with the heteroscedastic and homoscedastic z; too short series give nothing."""
    by = names(by)
    d = df.withColumn("d", F.col(x) - prev(x, by, order)).filter("d is not null")
    mean = d.groupBy(*by).agg(F.avg("d").alias("mu"), F.count(F.lit(1)).alias("m"))
    d = d.join(mean, by).withColumn("e", F.pow(F.col("d") - F.col("mu"), 2))
    top = max(qs)
    for q in qs:
        fr = rows(by, order, -(q - 1), 0)
        d = d.withColumn(f"s{q}", F.when(F.count("d").over(fr) == q, F.pow(F.sum("d").over(fr) - q * F.col("mu"), 2)))
    for j in range(1, top):
        d = d.withColumn(f"p{j}", F.col("e") * prev("e", by, order, j))
    g = d.groupBy(*by).agg(F.max("m").alias("m"), F.sum("e").alias("ee"), *[F.sum(f"s{q}").alias(f"s{q}") for q in qs],
                           *[F.count(f"s{q}").alias(f"n{q}") for q in qs], *[F.sum(f"p{j}").alias(f"p{j}") for j in range(1, top)])
    out = []
    for q in qs:
        var1 = F.col("ee") / (F.col("m") - 1)
        varq = F.col(f"s{q}") / (F.col(f"n{q}") * q * (1 - q / F.col("m")))
        vr = F.try_divide(varq, var1)
        theta = sum(((2 * (q - j) / q) ** 2 * F.col(f"p{j}") for j in range(2, q)), (2 * (q - 1) / q) ** 2 * F.col("p1")) / (F.col("ee") * F.col("ee"))
        homo = math.sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q))
        ok = F.col("m") + 1 >= 3 * q
        out.append(F.struct(F.lit(q).alias("q"), F.when(ok, vr).alias("vr"), F.when(ok, (vr - 1) / F.sqrt(theta)).alias("z"),
                            F.when(ok, (vr - 1) * F.sqrt("m") / homo).alias("z_homoskedastic")))
    return g.select(*by, F.explode(F.array(*out)).alias("r")).select(*by, "r.*")


def lead_lag(target: DataFrame, candidate: DataFrame, by, month: str, lags, least: int = 36) -> DataFrame:
    """Correlation at each shift of the candidate (level and change), with the best shift marked.

    Candidate rows are copied once per shift and meet the target by month, so the work is rows times shifts.
    """
    by = names(by)
    t = target.select(*by, month, "a", (F.col("a") - prev("a", by, month)).alias("da"))
    c = candidate.select(*by, month, "b", (F.col("b") - prev("b", by, month)).alias("db"))
    c = c.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn(month, F.expr(f"add_months({month}, lag)"))
    g = t.join(c, [*by, month]).groupBy(*by, "lag").agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("level"), F.corr("da", "db").alias("change"))
    g = g.filter(F.col("n") >= least)
    best = g.groupBy(*by).agg(F.max_by("lag", "level").alias("_bl"), F.max_by("lag", "change").alias("_bc"))
    return g.join(best, by).select(*by, "lag", "n", "level", "change", (F.col("lag") == F.col("_bl")).alias("best_level"), (F.col("lag") == F.col("_bc")).alias("best_change"))


def spearman(df: DataFrame, by, pairs: dict[str, tuple[str, str]], least: int = 24) -> DataFrame:
    """Rank correlation with shared ranks for ties, per named column pair."""
    by = names(by)
    items = [F.struct(F.lit(k).alias("feature"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in pairs.items()]
    long = df.select(*by, F.explode(F.array(*items)).alias("i")).select(*by, "i.*").dropna()
    g = [*by, "feature"]
    rx = ranks.value_ranks(long, g, "x").select(*g, "x", F.col("avg_rank").alias("rx"))
    ry = ranks.value_ranks(long, g, "y").select(*g, "y", F.col("avg_rank").alias("ry"))
    r = long.join(rx, [*g, "x"]).join(ry, [*g, "y"]).groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("_c"))
    return r.select(*g, "n", F.when(F.col("n") >= least, F.col("_c")).alias("ic"))


def flash_scale(confirmed: DataFrame, other: DataFrame, by, window: int = 6, tolerance: float = 0.10, whole: float = 0.15) -> DataFrame:
    """Ratio of two sources on common months: recent median and spread, usable or not, and whether the sizes agree overall."""
    by = names(by)
    j = confirmed.join(other.withColumnRenamed("value", "_b"), [*by, "month"]).withColumn("r", ratio("value", "_b")).filter("r > 0")
    j = j.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("month").desc())))
    med = j.groupBy(*by).agg(F.count(F.lit(1)).alias("overlap"), F.percentile(F.when(F.col("_k") <= window, F.col("r")), F.lit(0.5)).alias("scale"),
                             F.percentile(1 / F.col("r"), F.lit(0.5)).alias("overall"))
    spread = j.join(med, by).filter(F.col("_k") <= window).groupBy(*by).agg(F.max(F.abs(F.col("r") / F.col("scale") - 1)).alias("spread"))
    m = med.join(spread, by)
    return m.select(*by, "overlap", "scale", "spread", "overall", ((F.col("overlap") >= window) & (F.col("spread") <= tolerance)).alias("usable"),
                    F.col("overall").between(1 - whole, 1 + whole).alias("same_size"))


def trailing_change(df: DataFrame, by, date: str, value: str, days=(7, 30)) -> DataFrame:
    """Change of the newest value against the last one at least N days older; missing when history is short."""
    w = Window.partitionBy(*names(by))
    f = df.withColumn("_now", F.max(date).over(w))
    aggs = [F.count(F.lit(1)).alias("n"), F.max(date).alias("as_of"), F.max_by(value, date).alias("last")]
    for d in days:
        old = F.col(date) <= F.date_sub("_now", d)
        aggs.append(F.max_by(F.when(old, F.col(value)), F.when(old, F.col(date))).alias(f"_b{d}"))
    g = f.groupBy(*names(by)).agg(*aggs)
    return g.select(*names(by), "n", "as_of", "last", *[(ratio("last", f"_b{d}") - 1).alias(f"change_{d}d") for d in days])


def reason_counts(df: DataFrame, by, reason: Column) -> DataFrame:
    return df.groupBy(*names(by), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def ai_index_summary(scored: DataFrame) -> DataFrame:
    """Scored days, direction accuracy and price errors per stock and over all (rollup), in percent."""
    g = scored.rollup("stock").agg(
        F.count(F.lit(1)).alias("scored_days"), F.bround(F.avg(F.col("hit").cast("double")) * 100, 2).alias("direction_accuracy_pct"),
        F.bround(F.avg("open_ape_pct"), 2).alias("open_mape_pct"), F.bround(F.avg("close_ape_pct"), 2).alias("close_mape_pct"))
    return g.withColumn("stock", F.coalesce("stock", F.lit("all")))


def run_summary(fills: DataFrame, equity: DataFrame, by=KEY) -> DataFrame:
    """Share of sessions exposed, mean holding time, mean net result and unfilled share of a trading record.

    fills: instrument, entry, exit (session ordinals, exit missing while open), pnl, filled; equity: instrument, ordinal.
    """
    by = names(by)
    days = equity.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"), F.max("ordinal").alias("_last"))
    done = F.col("filled") & F.col("exit").isNotNull()
    span = F.coalesce("exit", "_last") - F.col("entry") + 1
    f = fills.join(days, by).groupBy(*by).agg(
        F.max("sessions").alias("sessions"), F.sum(F.when(F.col("filled"), span)).alias("_held"), F.avg(F.when(done, span)).alias("mean_holding"),
        F.avg(F.when(done, F.col("pnl"))).alias("mean_net"), F.avg((~F.col("filled")).cast("double")).alias("unfilled_rate"))
    return f.select(*by, "sessions", ratio(F.col("_held").cast("double"), F.col("sessions")).alias("exposure"), "mean_holding", "mean_net", "unfilled_rate")
