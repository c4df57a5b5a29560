"""Folds, bootstrap, gates, panels, sequences and models."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import prob
from ..operators import bars as B
from ..operators import classify as C
from ..operators import evaluate as E
from ..operators import gram as H
from ..operators import macro as M
from ..operators import metrics as X
from ..operators import models as G
from ..operators import ranks
from ..operators import sequences as Q
from ..session import cut_lineage
from .aggregates import PRICE, gap_buckets, leg_rows, price_rows, sigma_rows
from .registry import query
from .rounding import rd, rounded
from .topk import _rivals, rival_errors
from .windows import W, full, lag, lead

FIRST = "1997-01-01"


def design(v, h: int = 5):
    """Rows with a 5-session target, its maturity, scale, and features known the session before."""
    f = B.instrument_features(v.bars)
    names = ["ret_1", "ret_2", "mom_5", "mom_20", "vol_20", "vol_ratio", "ma50_gap", "turnover_ratio_20"]
    known = f.select("instrument", F.col("session").alias("prediction_date"), *[B.lagged(c).alias(c) for c in names])
    t = B.horizon_target(v.bars, h)
    return t.join(known, ["instrument", "prediction_date"]), names


_rows_sql = f"""wr AS (SELECT * FROM (SELECT instrument, session AS prediction_date, lag(session) OVER ({W}) AS origin, {lead('close', 4)} / {lag('close')} - 1 AS y, {lag('vol20')} * sqrt(5) AS sigma, {lead('session', 4)} AS matures FROM v_vol) WHERE y IS NOT NULL AND sigma IS NOT NULL AND matures IS NOT NULL),
 fl0 AS (SELECT instrument, max(prediction_date) AS last, CAST(max(prediction_date) - INTERVAL 12 MONTH AS DATE) + 1 AS lock FROM wr GROUP BY 1),
 fd AS (SELECT instrument, printf('dev_%02d', row_number() OVER (PARTITION BY instrument ORDER BY t0)) AS fold, t0, least(CAST(t0 + INTERVAL 6 MONTH AS DATE), lock) AS t1 FROM (SELECT instrument, lock, CAST(unnest(generate_series(TIMESTAMP '{FIRST}', CAST(lock AS TIMESTAMP), INTERVAL 6 MONTH)) AS DATE) AS t0 FROM fl0) WHERE t0 < lock
  UNION ALL SELECT instrument, 'lock', lock, last + 1 FROM fl0)"""


def targets(v):
    t = B.horizon_target(v.bars, 5)
    o = v.bars.select("instrument", F.col("session").alias("prediction_date"), B.lagged("session").alias("origin"))
    return t.join(o, ["instrument", "prediction_date"])


@query("walk_forward_folds", f"""WITH {_rows_sql}, r AS (SELECT f.*, CASE WHEN prediction_date >= t0 AND prediction_date < t1 THEN 'test' WHEN matures < t0 THEN 'train' END AS role, prediction_date FROM fd f JOIN wr USING (instrument)),
 c AS (SELECT instrument, fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows, min(prediction_date) FILTER (role = 'train') AS train_start, max(prediction_date) FILTER (role = 'train') AS train_end FROM r WHERE role IS NOT NULL GROUP BY ALL)
 SELECT instrument, fold, t0, t1, train_rows, test_rows, train_start, train_end, CASE WHEN test_rows = 0 THEN 'no_test_rows' WHEN test_rows < 60 AND starts_with(fold, 'dev') THEN 'few_test_rows' WHEN train_rows < 500 THEN 'few_train_rows' ELSE '' END AS excluded FROM fd JOIN c USING (instrument, fold)""")
def walk_forward_folds(v):
    t = targets(v)
    return E.fold_summary(t, E.fold_table(t, "instrument", "prediction_date", FIRST), "instrument", "prediction_date", "matures")


@query("inner_split", f"""WITH {_rows_sql}, b AS (SELECT instrument, fold, k, CAST(t0 - to_months(CAST(6 * k AS INT)) AS DATE) AS v0, CAST(t0 - to_months(CAST(6 * (k - 1) AS INT)) AS DATE) AS v1 FROM fd CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE fold <> 'lock')
 SELECT instrument, fold, k, v0, v1, count(*) FILTER (prediction_date >= v0 AND prediction_date < v1) AS validate_rows, count(*) FILTER (matures < v0) AS train_rows FROM b JOIN wr USING (instrument) GROUP BY ALL""")
def inner_split(v):
    t = targets(v)
    b = E.inner_blocks(E.fold_table(t, "instrument", "prediction_date", FIRST), "instrument")
    j = t.select("instrument", "prediction_date", "matures").join(b, "instrument")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.groupBy("instrument", "fold", "k", "v0", "v1").agg(
        n((F.col("prediction_date") >= F.col("v0")) & (F.col("prediction_date") < F.col("v1"))).alias("validate_rows"), n(F.col("matures") < F.col("v0")).alias("train_rows"))


@query("purge_check", f"""WITH {_rows_sql} SELECT instrument, fold, max(matures) FILTER (prediction_date < t0) AS train_matures, min(origin) FILTER (prediction_date >= t0 AND prediction_date < t1) AS test_origin FROM fd JOIN wr USING (instrument)
 GROUP BY ALL HAVING max(matures) FILTER (prediction_date < t0) > min(origin) FILTER (prediction_date >= t0 AND prediction_date < t1)""")
def purge_check(v):
    # Trained by prediction date alone, every fold holds labels that mature inside the test block; the check lists them.
    t = targets(v)
    folds = E.fold_table(t, "instrument", "prediction_date", FIRST)
    return E.purge_check(t, folds, "instrument", "prediction_date", "matures", "origin", trained_by="prediction_date")


@query("panel_folds", f"""WITH p AS (SELECT instrument, session, {lead('session')} AS label_date FROM v_thin), d AS (SELECT session, row_number() OVER (ORDER BY session DESC) - 1 AS back FROM (SELECT DISTINCT session FROM p)), n AS (SELECT greatest(least(126, floor(count(*) / 5)), 1) AS size FROM d),
 k AS (SELECT session, CAST(floor(back / size) AS INT) AS k FROM d, n), s AS (SELECT session, 3 - s AS split, CASE WHEN k = s THEN 'validate' ELSE 'train' END AS side FROM k CROSS JOIN (SELECT unnest([0, 1, 2]) AS s) WHERE k >= s),
 r AS (SELECT *, CASE WHEN label_date < DATE '2001-07-01' AND session >= DATE '1996-07-01' THEN 'train' WHEN instrument = 'Brand#1' AND session BETWEEN DATE '2001-07-01' AND DATE '2001-11-30' THEN 'test' END AS role FROM p)
 SELECT split, side, role, CAST(instrument = 'Brand#1' AS INT) AS "is_Brand#1", count(*) AS n FROM r JOIN s USING (session) WHERE role IS NOT NULL GROUP BY ALL""")
def panel_folds(v):
    p = v.thin.select("instrument", "session", B.ahead("session").alias("label_date"))
    r = E.panel_roles(p, "session", "label_date", "2001-07-01", "2001-11-30", F.col("instrument") == "Brand#1")
    s = E.date_blocks(v.thin.select("instrument", "session"), "session")
    j = r.join(s, ["instrument", "session"])
    return E.one_hot(j, "instrument", ["Brand#1"]).groupBy("split", "side", "role", "is_Brand#1").agg(F.count(F.lit(1)).alias("n"))


@query("train_window", f"""WITH {_rows_sql}, t AS (SELECT * FROM fd JOIN wr USING (instrument) WHERE matures < t0), q AS (SELECT instrument, fold, row_number() OVER (PARTITION BY instrument, fold ORDER BY prediction_date) - 1 AS i FROM fd JOIN wr USING (instrument) WHERE prediction_date >= t0 AND prediction_date < t1)
 SELECT instrument, fold, rows_2y, rows_3y, rows_5y, rows_expanding, refits_1, refits_5, refits_21 FROM (SELECT instrument, fold, {', '.join(f"CAST(sum(CAST(prediction_date >= t0 - INTERVAL {12 * y} MONTH AS INT)) AS BIGINT) AS rows_{y}y" for y in (2, 3, 5))}, count(*) AS rows_expanding FROM t GROUP BY ALL)
 JOIN (SELECT instrument, fold, {', '.join(f"count(*) FILTER (i % {k} = 0) AS refits_{k}" for k in (1, 5, 21))} FROM q GROUP BY ALL) USING (instrument, fold)""")
def train_window(v):
    t = targets(v)
    folds = E.fold_table(t, "instrument", "prediction_date", FIRST)
    n = E.train_windows(t, folds, "instrument", "prediction_date", "matures")
    test = E.with_roles(t, folds, "instrument", "prediction_date", "matures").filter("role = 'test'")
    r = E.retrain_positions(test, ["instrument", "fold"], "prediction_date")
    c = r.groupBy("instrument", "fold").agg(*[F.sum(F.col(f"refit_{k}").cast("bigint")).alias(f"refits_{k}") for k in (1, 5, 21)])
    return n.join(c, ["instrument", "fold"])


@query("build_panel", f"""WITH v AS (SELECT *, CASE WHEN count(ret) OVER (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING) = 20 THEN stddev_samp(ret) OVER (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING) END AS vol20 FROM (SELECT *, close / {lag('close')} - 1 AS ret FROM v_thin)),
 f AS (SELECT instrument, session AS date, ret AS ret_1, close / {lag('close', 5)} - 1 AS mom_5, close / {lag('close', 20)} - 1 AS mom_20, vol20 AS vol_20, close / ({full('avg', 'close', 50)}) - 1 AS ma50_gap, {lead('close')} / close - 1 AS target_ret, 0.3 * vol20 AS band FROM v)
 SELECT instrument, date, {rd('ret_1 mom_5 mom_20 vol_20 ma50_gap target_ret band')}, CASE WHEN target_ret IS NULL OR band IS NULL THEN NULL WHEN target_ret < -band THEN 0 WHEN target_ret > band THEN 2 ELSE 1 END AS y FROM f""")
def build_panel(v):
    f = B.instrument_features(v.thin).select("instrument", "session", "ret_1", "mom_5", "mom_20", "vol_20", "ma50_gap")
    return rounded(f.join(B.band_label(v.thin), ["instrument", "session"]).withColumnRenamed("session", "date"))


def _seq(table, back):
    """Sessions of each instrument with what a window of ``back`` sessions before and four after them holds."""
    return f"""c AS (SELECT ordinal, session FROM v_cal), sp AS (SELECT instrument, min(ordinal) AS a, max(ordinal) AS b FROM {table} JOIN c USING (session) GROUP BY 1),
 g AS (SELECT sp.instrument, c.session, c.ordinal, sp.a, sp.b FROM sp JOIN c ON c.ordinal BETWEEN sp.a AND sp.b),
 x AS (SELECT g.*, open, high, low, close, volume FROM g LEFT JOIN {table} t ON t.instrument = g.instrument AND t.session = g.session),
 ac AS (SELECT instrument, session, coalesce((open / pc <= 0.05 AND close / pc <= 0.05) OR (open / pc >= 20 AND close / pc >= 20), false) AS act FROM (SELECT *, {lag('close')} AS pc FROM {table})),
 y AS (SELECT x.*, coalesce(act, false) AS act FROM x LEFT JOIN ac USING (instrument, session)),
 w AS (SELECT *, count(close) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN {back} PRECEDING AND 4 FOLLOWING) AS present, bool_or(act) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN {back} PRECEDING AND 4 FOLLOWING) AS acted,
   lead(close, 4) OVER (PARTITION BY instrument ORDER BY ordinal) / lag(close) OVER (PARTITION BY instrument ORDER BY ordinal) - 1 AS yy FROM y)"""


def _windows_sql(table, lookback, back):
    return f"""SELECT instrument, session AS prediction_date, CASE WHEN ordinal - {back} < a THEN 'insufficient_history' WHEN ordinal + 4 > b THEN 'pending_target' WHEN present < {back + 5} THEN 'missing_bar' WHEN acted THEN 'corporate_action' ELSE '' END AS reason,
 CASE WHEN reason = '' THEN {lookback} END AS length, round(CASE WHEN reason = '' THEN yy END, 6) AS y FROM (WITH {_seq(table, back)} SELECT * FROM w)"""


@query("build_sequences", f"{_windows_sql('v_bars', 60, 80)} UNION ALL {_windows_sql('v_thin', 10, 30)}")
def build_sequences(v):
    """The default windows on the dense instruments, and shorter ones on brands that often lack a bar."""
    s = Q.build_sequences(v.bars, v.calendar, lookback=60, horizon=5, volume_window=20, jump=0.95).unionByName(
        Q.build_sequences(v.thin, v.calendar, lookback=10, horizon=5, volume_window=20, jump=0.95), allowMissingColumns=True)
    return rounded(s.select("instrument", "prediction_date", "reason", F.when(F.col("reason") == "", F.size("window")).alias("length"), "y"))


@query("ridge_fold")
def ridge_fold(v):
    d, x = design(v)
    folds = E.fold_table(d, "instrument", "prediction_date", FIRST)
    r = G.ridge_folds(d, folds, "instrument", "prediction_date", "matures", x, "future_return", "sigma", alpha=1e2)
    return r.select("instrument", "fold", "prediction_date", "n_train", "sigma", "future_return", "prediction")


@query("expanding_ridge")
def expanding_ridge(v):
    f = M.longterm_frame(v.series2, v.series)
    known = F.add_months("month", 6)
    r = G.expanding_ridge(f, "series_id", "month", known, ["mom_12m", "drawdown_36m"], "fwd_6m", alpha=10.0, least=24)
    return r.filter("prediction is not null").select("series_id", "month", "n_train", "prediction", "fwd_6m")


@query("har_sigma")
def har_sigma(v):
    return G.har_sigma(v.bars, 5)


@query("ar_var_forecast")
def ar_var_forecast(v):
    """Both models at every horizon, each with a band from its own errors known by then."""
    ar = G.ar_forecasts(v.series, "series_id", "month", "value", horizons=(1, 3, 6))
    both = v.series.join(v.series2.withColumnRenamed("value", "other"), ["series_id", "month"])
    var = G.var_paths(both, "series_id", "month", ["value", "other"], (1, 3, 6))
    banded = lambda f, name: G.error_bands(f, "series_id", "month", name, "actual", (1, 3, 6), least=10).withColumnsRenamed(
        {"low": f"{name}_low", "high": f"{name}_high", "n_errors": f"{name}_errors"})
    return banded(ar, "ar").join(banded(var, "var").drop("actual"), ["series_id", "month", "horizon"], "left")


@query("ar1_bands", f"""WITH d AS (SELECT *, value - {lag('value', 1, 'PARTITION BY series_id ORDER BY month')} AS d, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM v_series), l AS (SELECT *, {lag('d', 1, 'PARTITION BY series_id ORDER BY month')} AS l FROM d),
 c AS (SELECT *, regr_slope(d, l) OVER w AS b, regr_intercept(d, l) OVER w AS a, regr_count(d, l) OVER w AS n FROM l WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT c.series_id, c.month, h AS horizon, c.value, c.value + h * a / (1 - b) + (c.d - a / (1 - b)) * b * (1 - pow(b, h)) / (1 - b) AS ar, t.value AS actual, year(c.month) * 12 + month(c.month) AS m FROM c CROSS JOIN (SELECT unnest([1, 3, 6]) AS h) LEFT JOIN d t ON t.series_id = c.series_id AND t.i = c.i + h WHERE n >= 48 AND c.l IS NOT NULL),
 q AS (SELECT f.series_id, f.month, f.horizon, count(e.ar - e.actual) AS n_errors, quantile_cont(e.ar - e.actual, 0.1) AS lo, quantile_cont(e.ar - e.actual, 0.9) AS hi FROM f LEFT JOIN f e ON e.series_id = f.series_id AND e.horizon = f.horizon AND e.m + e.horizon <= f.m GROUP BY ALL)
 SELECT series_id, month, horizon, n_errors, round(ar / value - 1, 6) + 0.0::DOUBLE AS ar, round(CASE WHEN n_errors >= 10 THEN (ar - hi) / value - 1 END, 6) + 0.0::DOUBLE AS low, round(CASE WHEN n_errors >= 10 THEN (ar - lo) / value - 1 END, 6) + 0.0::DOUBLE AS high FROM f JOIN q USING (series_id, month, horizon)""")
def ar1_bands(v):
    """One lag has a closed form, which the check uses; points and bands as changes from the last value."""
    ar = G.ar_forecasts(v.series, "series_id", "month", "value", horizons=(1, 3, 6), lags=1)
    f = G.error_bands(ar, "series_id", "month", "ar", "actual", (1, 3, 6), least=10)
    rel = lambda c: (F.col(c) / F.col("rw") - 1).alias(c)
    return rounded(f.select("series_id", "month", "horizon", "n_errors", rel("ar"), rel("low"), rel("high")))


@query("overlay_outlook")
def overlay_outlook(v):
    ends = v.series2.filter("not (series_id = '5-LOW' and month > date'2001-01-01')").groupBy("series_id").agg(F.max("month").alias("last_month"))
    last = v.series.agg(F.max("month")).scalar()
    h = G.overlay_horizon(ends, last, 6)
    f = G.ar_forecasts(v.series2.filter("not (series_id = '5-LOW' and month > date'2001-01-01')"), "series_id", "month", "value", horizons=tuple(range(1, 19)), difference=False)
    return f.join(h, ["series_id", "horizon"]).filter("month = last_month").select("series_id", "month", "horizon", "ar", "rw")


@query("fx_decomposition")
def fx_decomposition(v):
    f = v.series.join(v.series2.withColumnRenamed("value", "other"), ["series_id", "month"]).select(
        "series_id", "month", F.ln("value").alias("a"), F.ln("other").alias("b"), (F.col("other") / F.col("value")).alias("c"))
    return G.variance_shares(f, "series_id", "month", ["a", "b", "c"])


def labelled(v):
    d, x = design(v, 1)
    y = B.class_of("future_return", 0.3 * F.col("sigma"))
    return d.withColumn("y", y), x


@query("direction_classifier")
def direction_classifier(v):
    d, x = labelled(v)
    t = C.assembled(d, x, "y", ["instrument", "prediction_date", "matures"])
    cut = F.lit("2000-06-01").cast("date")
    train, test = t.filter(F.col("matures") < cut), t.filter(F.col("prediction_date") >= cut)
    best = C.choose(train, "prediction_date")
    linear = C.probabilities(C.fit(train, "linear", best["c"], best["balanced"]), test)
    soft = prob_columns(linear, best["temperature"])
    boosted = C.fit_boosted(train, "prediction_date")
    raised = boosted.probabilities(test).select("instrument", "prediction_date", *[F.col(n).alias(f"boosted_{n}") for n in prob.P3])
    return soft.join(raised, ["instrument", "prediction_date"]).withColumns({
        "c": F.lit(best["c"]), "temperature": F.lit(best["temperature"]), "inner_loss": F.lit(best["inner_loss"]), "boosted_inner_loss": F.lit(boosted.inner_loss)})


def prob_columns(df, temperature):
    p = prob.softened(temperature=temperature)
    return df.withColumns({f"_s{i}": e for i, e in enumerate(p)}).drop("p_down", "p_flat", "p_up").withColumnsRenamed({"_s0": "p_down", "_s1": "p_flat", "_s2": "p_up"})


@query("feature_contribution")
def feature_contribution(v):
    d, x = labelled(v)
    t = C.assembled(d, x, "y", ["instrument", "prediction_date", "matures"])
    model = C.fit(t.filter(F.col("matures") < F.lit("2000-01-01").cast("date")), "linear")
    return C.contributions(model, t, x, ["instrument", "prediction_date"])


@query("direction_walk_forward")
def direction_walk_forward(v):
    d, x = labelled(v)
    t = C.assembled(d, x, "y", ["instrument", "prediction_date", "matures"])
    spans = [(f"{y}-01-01", f"{y + 1}-01-01") for y in (1998, 1999, 2000, 2001)]
    return C.walk_forward_report(C.walk_forward(t, spans, "prediction_date", "matures", years=3), "instrument", "prediction_date")


@query("live_direction")
def live_direction(v):
    """The session after the newest: features are there, the label is not."""
    f = B.instrument_features(v.bars)
    d, x = labelled(v)
    newest = f.select("instrument", F.date_add(F.col("session"), 1).alias("prediction_date"), *x, F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("session"))).alias("_i")).filter("_i = 1").drop("_i")
    return C.live_direction(d.select("instrument", "prediction_date", "matures", "y", *x).unionByName(newest, allowMissingColumns=True), x, "y", "instrument", "prediction_date", "matures")


@query("auc_bootstrap", f"""WITH a AS (SELECT model, strftime(target_date, '%Y-%m') AS block, least(greatest(CAST(floor((predicted_return + 0.5) * 1000) AS BIGINT), 0), 999) AS x, actual_return > 0 AS up FROM ({PRICE}) WHERE actual_return <> 0 AND predicted_return IS NOT NULL AND horizon_days = 1),
 h AS (SELECT model, block, x, count(*) FILTER (up) AS p, count(*) FILTER (NOT up) AS q FROM a GROUP BY ALL), bk AS (SELECT model, block, row_number() OVER (PARTITION BY model ORDER BY block) - 1 AS bid, count(*) OVER (PARTITION BY model) AS nb FROM (SELECT DISTINCT model, block FROM h)),
 dr AS (SELECT model, d, (('0x' || substr(md5(d || '-' || s), 1, 8))::BIGINT) % nb AS bid FROM (SELECT model, max(nb) AS nb FROM bk GROUP BY 1) CROSS JOIN (SELECT unnest(range(200)) AS d) JOIN (SELECT unnest(range(400)) AS s) ON s < nb),
 wt AS (SELECT model, d, bid, count(*) AS w FROM dr GROUP BY ALL), dh AS (SELECT model, d, x, sum(w * p) AS p, sum(w * q) AS q FROM wt JOIN bk USING (model, bid) JOIN h USING (model, block) GROUP BY ALL UNION ALL SELECT model, -1, x, sum(p), sum(q) FROM h GROUP BY ALL),
 ar AS (SELECT model, d, sum(p * (b + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) AS auc FROM (SELECT *, sum(q) OVER (PARTITION BY model, d ORDER BY x) - q AS b FROM dh) GROUP BY ALL)
 SELECT model, round(max(auc) FILTER (d = -1), 6) AS point, any_value(nb) AS blocks, round(quantile_cont(auc, 0.025) FILTER (d >= 0), 6) AS lo, round(quantile_cont(auc, 0.975) FILTER (d >= 0), 6) AS hi FROM ar JOIN (SELECT model, max(nb) AS nb FROM bk GROUP BY 1) USING (model) GROUP BY model""")
def auc_bootstrap(v):
    p = price_rows(v).filter("horizon_days = 1 and actual_return <> 0 and predicted_return is not null").withColumn("block", E.month("target_date")).withColumn("up", F.col("actual_return") > 0)
    return rounded(E.auc_bootstrap(p, "model", "block", "predicted_return", "up", -0.5, 0.5, draws=200))


def oof_rows(v):
    return sigma_rows(v).groupBy("instrument", "model", F.col("target_date").alias("date")).agg(F.min("actual_return").alias("y"), F.min("predicted_return").alias("p"), F.min("sigma").alias("sigma"))


_draws = lambda src, by: f"""blk AS (SELECT {by}, block, row_number() OVER (PARTITION BY {by} ORDER BY block) - 1 AS bid, count(*) OVER (PARTITION BY {by}) AS nb, x, n FROM (SELECT {by}, block, sum(x) AS x, CAST(sum(n) AS DOUBLE) AS n FROM {src} GROUP BY ALL)),
 sz AS (SELECT {by}, max(nb) AS nb, sum(x) / sum(n) AS point FROM blk GROUP BY ALL),
 dr AS (SELECT {by}, d, (('0x' || substr(md5(d || '-' || s), 1, 8))::BIGINT) % nb AS bid FROM sz CROSS JOIN (SELECT unnest(range(2000)) AS d) JOIN (SELECT unnest(range(400)) AS s) ON s < nb),
 st AS (SELECT {by}, d, sum(x) / sum(n) AS s FROM dr JOIN blk USING ({by}, bid) GROUP BY ALL),
 ci AS (SELECT {by}, point, max(nb) AS blocks, quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi, least(1.0, 2 * least(avg(CAST(s >= 0 AS INT)), avg(CAST(s <= 0 AS INT)))) AS p_value FROM st JOIN sz USING ({by}) GROUP BY ALL)"""

_gain = f"""gn AS (SELECT model, strftime(target_date, '%Y-%m') AS block, abs(actual_return - predicted_return) - abs(actual_return) AS x, 1.0 AS n FROM ({PRICE}) WHERE actual_return IS NOT NULL AND predicted_return IS NOT NULL AND horizon_days = 1)"""


def gains(v):
    p = price_rows(v).filter("horizon_days = 1 and actual_return is not null and predicted_return is not null")
    return p.withColumn("block", E.month("target_date")).withColumn("gain", F.abs(F.col("actual_return") - F.col("predicted_return")) - F.abs("actual_return"))


@query("block_bootstrap", f"WITH {_gain}, {_draws('gn', 'model')} SELECT model, blocks, {rd('point lo hi p_value')} FROM ci")
def block_bootstrap(v):
    return rounded(E.block_bootstrap(gains(v), "model", "block", {"x": F.col("gain"), "n": F.lit(1.0)}, E.STATISTICS["mean"]))


@query("statistic_hook", f"WITH {_gain.replace('- abs(actual_return) AS x, 1.0 AS n', 'AS x, abs(actual_return) AS n')}, {_draws('gn', 'model')} SELECT model, blocks, {rd('point lo hi')} FROM ci")
def statistic_hook(v):
    g = gains(v)
    sums = {"x": F.abs(F.col("actual_return") - F.col("predicted_return")), "z": F.abs("actual_return")}
    return rounded(E.block_bootstrap(g, "model", "block", sums, E.STATISTICS["ratio"]).drop("p_value"))


_pairs_sql = f"""pr AS (SELECT instrument, strftime(session, '%Y-%m') AS block, abs(ar - y) - abs(rw - y) AS x, 1.0 AS n FROM rr)"""


@query("paired_ci", f"WITH {_rivals}, {_pairs_sql}, {_draws('pr', 'instrument')} SELECT instrument, rows, {rd('point lo hi p_value')} FROM ci JOIN (SELECT instrument, count(*) AS rows FROM rr GROUP BY 1) USING (instrument)")
def paired_ci(v):
    f = rival_errors(v).withColumn("block", E.month("session"))
    f = f.withColumn("a", F.col("ar") - F.col("y")).withColumn("b", F.col("rw") - F.col("y"))
    return rounded(E.paired_ci(f, "instrument", "block", "a", "b"))


@query("bootstrap_p_holm", f"""WITH {_gain}, {_draws('gn', 'model')}, h AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER () AS m FROM ci WINDOW w AS (ORDER BY p_value, model))
 SELECT model, round(p_value, 6) AS p_value, round(least(1.0, max((m - k) * p_value) OVER (ORDER BY p_value, model)), 6) AS p_holm FROM h""")
def bootstrap_p_holm(v):
    r = E.block_bootstrap(gains(v), "model", "block", {"x": F.col("gain"), "n": F.lit(1.0)}, E.STATISTICS["mean"]).withColumn("family", F.lit("price"))
    return rounded(E.holm(r, "family", tie="model").select("model", "p_value", "p_holm"))


@query("verdict", f"""WITH {_gain}, {_draws('gn', 'model')}, c AS (SELECT model, avg(interval_hit) AS cov FROM v_daily WHERE kind = 'price' AND status = 'scored' AND horizon_days = 1 GROUP BY 1)
 SELECT model, CASE WHEN lo <= 0 AND hi >= 0 THEN 'tie' WHEN hi < 0 THEN 'better' ELSE 'worse' END AS verdict, CASE WHEN hi < 0 AND near THEN 'adopt' WHEN hi < 0 THEN 'coverage_failed' WHEN lo > 0 THEN 'worse' WHEN near THEN 'tie' ELSE 'tie_coverage_failed' END AS interval_verdict
 FROM (SELECT *, abs(cov - 0.8) <= 0.04 + 1e-12 OR (0.3 > 0.04 + 1e-12 AND abs(cov - 0.8) < 0.3) AS near FROM ci JOIN c USING (model))""")
def verdict(v):
    r = E.block_bootstrap(gains(v), "model", "block", {"x": F.col("gain"), "n": F.lit(1.0)}, E.STATISTICS["mean"])
    c = price_rows(v).filter("horizon_days = 1").groupBy("model").agg(F.avg("interval_hit").alias("cov"))
    j = r.join(c, "model")
    return j.select("model", LB.verdict(F.lit("mae"), F.col("lo"), F.col("hi")).alias("verdict"),
                    LB.interval_verdict(F.col("hi"), F.col("lo"), F.col("hi"), F.lit(1), F.col("cov"), F.lit(0.5)).alias("interval_verdict"))


_oof = f"""sgx AS (SELECT p.instrument || ':' || model AS instrument, p.target_date AS date, min(actual_return) AS y, min(predicted_return) AS p, min(s.sigma) AS sigma FROM ({PRICE}) p JOIN (SELECT instrument, session AS target_date, {lag('vol20')} AS sigma FROM v_vol) s ON s.instrument = p.instrument AND s.target_date = p.target_date
  WHERE horizon_days = 1 AND actual_return IS NOT NULL AND s.sigma IS NOT NULL GROUP BY ALL),
 pt AS (SELECT *, CASE WHEN i < floor(n / 2) THEN 'calibrate' WHEN i < floor(n * 3 / 4) THEN 'gate' ELSE 'evaluate' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n FROM sgx)),
 s0 AS (SELECT instrument, least(greatest(coalesce(sum(p * y) / nullif(sum(p * p), 0), 0), 0), 1) AS slope0 FROM pt WHERE part = 'calibrate' GROUP BY 1),
 gt AS (SELECT instrument, strftime(date, '%Y-%m') AS block, abs(y - slope0 * p) - abs(y) AS x, 1.0 AS n FROM pt JOIN s0 USING (instrument) WHERE part = 'gate')"""


@query("slope_gate", f"""WITH {_oof}, {_draws('gt', 'instrument')}, k AS (SELECT instrument, slope0, hi AS gate_hi, hi < 0 AS published, CASE WHEN hi < 0 THEN slope0 ELSE 0.0 END AS slope FROM ci JOIN s0 USING (instrument)),
 z AS (SELECT pt.*, k.* EXCLUDE (instrument), abs(y - slope * p) / greatest(sigma, 1e-6) AS s FROM pt JOIN k USING (instrument)), q AS (SELECT instrument, quantile_cont(s, 0.8) AS band_q FROM z WHERE part = 'calibrate' GROUP BY 1)
 SELECT split_part(instrument, ':', 1) AS instrument, split_part(instrument, ':', 2) AS model, n_evaluation, published, {rd('calibration_slope slope gate_hi band_q zero_mae raw_mae shrunk_mae coverage')} FROM (SELECT instrument, count(*) AS n_evaluation, first(slope0) AS calibration_slope, first(slope) AS slope, first(gate_hi) AS gate_hi, first(published) AS published,
  first(band_q) AS band_q, avg(abs(y)) AS zero_mae, avg(abs(y - p)) AS raw_mae, avg(abs(y - slope * p)) AS shrunk_mae, avg(CAST(s <= band_q AS INT)) AS coverage FROM z JOIN q USING (instrument) WHERE part = 'evaluate' GROUP BY 1)""")
def slope_gate(v):
    return rounded(E.slope_gate(oof_rows(v), ["instrument", "model"], "date", 1))


@query("feature_set_ablation")
def feature_set_ablation(v):
    d, x = design(v)
    sets = {"all": x, "no_momentum": [c for c in x if not c.startswith("mom_")], "returns_only": ["ret_1", "ret_2"]}
    folds = E.fold_table(d, "instrument", "prediction_date", FIRST)
    return rounded(H.feature_sets(d, folds, "instrument", "prediction_date", "matures", sets, "future_return", "sigma"), 9)


Z41 = [NormalDist().inv_cdf((i + 0.5) / 41) for i in range(41)]


@query("gap_mixture")
def gap_mixture(v):
    table = X.bucket_conditional(gap_buckets(v), "instrument").groupBy("instrument").agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.array("p0", "p1", "p2")))).alias("m"))
    f = B.gap_group_features(v.bars).select("instrument", "session", "gap_0")
    f = f.select("instrument", "session", B.roll(F.avg, "gap_0", 60, 1).alias("center"), B.roll(F.stddev_samp, "gap_0", 60, 1).alias("scale"))
    vol = B.with_vol20(v.bars).select("instrument", "session", (0.3 * B.lagged("vol20")).alias("band"))
    rows = f.join(vol, ["instrument", "session"]).dropna().join(table, "instrument")
    pick = lambda gap: [F.get(F.try_element_at("m", B.class_of(gap, "band")), F.lit(i)) for i in range(3)]
    return G.gap_mixture(rows, "center", "scale", Z41, pick, ["instrument", "session"])


@query("nowcast_policy", f"""WITH {_rivals}, i AS (SELECT instrument, y, ar, var, rw, drift, row_number() OVER (PARTITION BY instrument ORDER BY session) <= floor(count(*) OVER (PARTITION BY instrument) / 2) AS first FROM rr),
 g AS (SELECT instrument, count(*) AS n, max(y) AS past_max, {', '.join(f"avg(abs({m} - y)) FILTER (first) AS a_{m}" for m in ('ar', 'var'))}, {', '.join(f"avg(abs({m} - y)) FILTER (NOT first) AS b_{m}" for m in ('ar', 'var', 'rw', 'drift'))} FROM i GROUP BY 1)
 SELECT instrument, n, chosen, {rd('mae mae_rw mae_drift past_max')}, mae < mae_rw AND mae < mae_drift AS published FROM (SELECT *, CASE WHEN a_ar <= a_var THEN 'ar' ELSE 'var' END AS chosen, CASE WHEN a_ar <= a_var THEN b_ar ELSE b_var END AS mae, b_rw AS mae_rw, b_drift AS mae_drift FROM g)""")
def nowcast_policy(v):
    return rounded(E.nowcast_policy(rival_errors(v), "instrument", "session", "y", ("ar", "var"), ("rw", "drift")))


@query("export_scenario")
def export_scenario(v):
    base = v.series.select("series_id", "month", "value")
    newest = base.groupBy("series_id").agg(F.max("month").alias("m"), F.max_by("value", "month").alias("value"))
    extra = newest.select("series_id", F.add_months("m", 1).alias("month"), (F.col("value") * 1.05).alias("value"))
    f = base.unionByName(extra).withColumn("scenario", F.lit(0))
    mf = M.monthly_features(f.drop("scenario")).select("series_id", "month", "mom", "yoy", "value")
    mf = mf.withColumn("target", F.lead("value").over(M.series("series_id", "month")) / F.col("value") - 1)
    r = G.expanding_ridge(mf, "series_id", "month", F.add_months("month", 1), ["mom", "yoy"], "target", alpha=1.0, least=24)
    slope = r.filter("target is not null and prediction is not null").groupBy("series_id").agg(
        F.least(F.greatest(F.try_divide(F.sum(F.col("prediction") * F.col("target")), F.sum(F.pow("prediction", 2))), F.lit(0.0)), F.lit(1.0)).alias("shrink"))
    last = r.join(extra.select("series_id", "month"), ["series_id", "month"], "left_semi")
    return last.join(slope, "series_id").select("series_id", "month", "value", "n_train", "shrink", (F.col("value") * (1 + F.col("shrink") * F.col("prediction"))).alias("scenario"), F.lit(False).alias("validated"))


@query("model_comparison", """WITH t AS (SELECT d.instrument, d.model, d.target_date, intraday * CASE WHEN p_down >= p_flat AND p_down >= p_up THEN -1 WHEN p_flat >= p_up THEN NULL ELSE 1 END AS pnl FROM v_daily d JOIN (SELECT instrument, session AS target_date, close / open - 1 AS intraday FROM v_bars) b USING (instrument, target_date)
   WHERE kind = 'direction' AND status = 'scored' AND target_mode = 'close_to_close'),
 m AS (SELECT instrument, count(DISTINCT model) AS m FROM t GROUP BY 1), k AS (SELECT instrument, target_date FROM (SELECT instrument, target_date, count(DISTINCT model) AS c FROM t GROUP BY 1, 2) JOIN m USING (instrument) WHERE c = m),
 s AS (SELECT instrument, model, target_date >= DATE '1999-01-01' AS late, count(*) AS days, count(pnl) AS trades, avg(pnl) AS mean FROM t SEMI JOIN k USING (instrument, target_date) GROUP BY ALL),
 b AS (SELECT instrument, arg_max(model, {'a': mean, 'b': model}) AS model, max(mean) AS sm FROM s WHERE NOT late AND days >= 60 AND trades >= 20 GROUP BY 1)
 SELECT instrument, model, round(sm, 6) AS selection_mean, days AS evaluation_days, trades AS evaluation_trades, round(mean, 6) AS evaluation_mean FROM b JOIN s USING (instrument, model) WHERE late""")
def model_comparison(v):
    f = leg_rows(v).filter("target_mode = 'close_to_close'").withColumn("c", prob.argmax(prob.vector()))
    side = F.when(F.col("c") == 2, 1.0).when(F.col("c") == 0, -1.0)
    pnl = f.select("instrument", "model", "target_date", (side * F.col("intraday")).alias("pnl"))
    return rounded(E.model_comparison(pnl, "instrument", "model", "target_date", "pnl", F.lit("1999-01-01").cast("date")))


_nested = """WITH r0 AS (SELECT instrument, session, open, ret, vol20, lag(vol20) OVER w AS lv, lag(close) OVER w AS lc FROM v_vol WINDOW w AS (PARTITION BY instrument ORDER BY session)),
 cls AS (SELECT instrument, session AS d, CASE WHEN g < -b THEN 0 WHEN g > b THEN 2 ELSE 1 END AS bucket, CASE WHEN ret < -b THEN 0 WHEN ret > b THEN 2 ELSE 1 END AS y FROM (SELECT instrument, session, open / lc - 1 AS g, ret, 0.3 * lv AS b FROM r0) WHERE g IS NOT NULL AND ret IS NOT NULL AND b IS NOT NULL),
 lk AS (SELECT instrument, max(d) AS last, CAST(max(d) - INTERVAL 12 MONTH AS DATE) + 1 AS lock FROM cls GROUP BY 1),
 fo AS (SELECT instrument, printf('dev_%02d', row_number() OVER (PARTITION BY instrument ORDER BY t0)) AS fold, t0 FROM (SELECT instrument, lock, CAST(unnest(generate_series(TIMESTAMP '1997-01-01', CAST(lock AS TIMESTAMP), INTERVAL 6 MONTH)) AS DATE) AS t0 FROM lk) WHERE t0 < lock UNION ALL SELECT instrument, 'lock', lock FROM lk),
 fc AS (SELECT *, CAST(t0 - INTERVAL 6 MONTH AS DATE) AS cut FROM fo),
 tr AS (SELECT fc.*, d, bucket, y FROM fc JOIN cls USING (instrument) WHERE d < t0),
 cand AS (SELECT unnest([2, 3, 5, 0]) AS w), hls AS (SELECT unnest([0, 126, 252, 504]) AS h),
 cnt AS (SELECT instrument, fold, w, h, bucket, count(*) AS n, sum(CASE WHEN y = 0 THEN q ELSE 0 END) + 1 AS c0, sum(CASE WHEN y = 1 THEN q ELSE 0 END) + 1 AS c1, sum(CASE WHEN y = 2 THEN q ELSE 0 END) + 1 AS c2
   FROM (SELECT *, CASE WHEN h = 0 THEN 1.0 ELSE pow(2.0::DOUBLE, -(cut - d) / h::DOUBLE) END AS q FROM tr CROSS JOIN cand CROSS JOIN hls WHERE d < cut AND (w = 0 OR d >= CAST(cut - to_months(CAST(12 * w AS INT)) AS DATE))) GROUP BY ALL),
 own AS (SELECT instrument, fold, w, h, sum(n) AS n FROM cnt GROUP BY ALL),
 inn AS (SELECT instrument, fold, bucket, y, count(*) AS k FROM tr WHERE d >= cut GROUP BY ALL),
 ls AS (SELECT o.instrument, o.fold, o.w, o.h, o.n, sum(k * -ln(greatest(coalesce([c0, c1, c2][y + 1] / (c0 + c1 + c2), 1.0 / 3), 1e-7))) / sum(k) AS loss
   FROM own o JOIN inn USING (instrument, fold) LEFT JOIN cnt c ON c.instrument = o.instrument AND c.fold = o.fold AND c.w = o.w AND c.h = o.h AND c.bucket = inn.bucket GROUP BY ALL),
 bst AS (SELECT instrument, fold, first({'w': w, 'h': h, 'loss': round(loss, 12)} ORDER BY round(loss, 12), CASE w WHEN 0 THEN 9 ELSE w END, h) AS b FROM ls WHERE n >= 500 GROUP BY ALL),
 sz AS (SELECT instrument, fold, count(*) AS n_train, count(*) FILTER (d >= cut) AS n_inner FROM tr GROUP BY ALL)
 SELECT instrument, fold, n_train, n_inner, CASE WHEN u THEN b.w ELSE 5 END AS window_years, CASE WHEN u THEN b.h ELSE 0 END AS half_life, round(CASE WHEN u THEN b.loss END, 6) AS inner_loss
 FROM (SELECT *, n_inner >= 20 AND n_train >= 500 AND b IS NOT NULL AS u FROM sz LEFT JOIN bst USING (instrument, fold))"""


@query("nested_choice", _nested)
def nested_choice(v):
    f = B.with_vol20(v.bars)
    band = 0.3 * B.lagged("vol20")
    rows = f.select("instrument", F.col("session").alias("prediction_date"), F.col("session").alias("matures"), B.class_of(B.ratio("open", B.lagged("close")) - 1, band).alias("bucket"),
                    B.class_of("ret", band).alias("y")).dropna()
    folds = E.fold_table(rows, "instrument", "prediction_date", FIRST)
    return rounded(H.nested_choice(rows, folds, "instrument", "prediction_date", "matures", "bucket", "y"))


@query("scheduled_refit")
def scheduled_refit(v):
    """Each instrument by itself, and all of them as one panel with a shared model."""
    d, x = design(v)
    d = cut_lineage(d)  # both forms read the rows from one table
    own = ["form", "instrument", "fold", "prediction_date", "alpha", "inner_blocks", "trained_at", "model_version", "n_train", "sigma", "future_return", "prediction"]
    alone = H.scheduled_refits(d, E.fold_table(d, "instrument", "prediction_date", FIRST), "instrument", "prediction_date", "matures", x, "future_return", "sigma")
    panel = d.withColumn("panel", F.lit("all"))
    pooled = H.scheduled_refits(panel, E.fold_table(panel, "panel", "prediction_date", FIRST), "panel", "prediction_date", "matures", x, "future_return", "sigma")
    return rounded(alone.withColumn("form", F.lit("own")).select(*own).unionByName(pooled.withColumn("form", F.lit("pooled")).select(*own)), 9)
