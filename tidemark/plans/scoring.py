"""Ledger scoring, official forecasts, reviews and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import ledger as L
from ..operators import macro as M
from ..operators import outlook as O
from .bindings import SAME_DAY
from .registry import query
from .rounding import rd, rounded

OUT = "record_id status is_prospective actual_class"
NUM = "actual_open actual_close actual_return direction_correct log_loss brier price_error absolute_price_error price_ape center_price_error return_error interval_hit"


@query("score_forecasts", f"SELECT record_id, status, is_prospective, actual_class, {rd(NUM)} FROM v_scored")
def score_forecasts(v):
    return rounded(v.scored.select(*OUT.split(), *NUM.split()))


@query("daily_comparison", "SELECT record_id, instrument, target_date, model, kind, horizon_days, target_mode, config_hash, created_at, status FROM v_daily")
def daily_comparison(v):
    return v.daily.select("record_id", *L.KEYS, "config_hash", "created_at", "status")


@query("ledger_summary", f"""SELECT model, kind, horizon_days, target_mode, config_hash, n, point_forecasts, {rd('accuracy mean_log_loss mean_brier price_mae price_mape interval_coverage')} FROM (
 SELECT model, kind, horizon_days, target_mode, config_hash, count(*) AS n, avg(direction_correct) AS accuracy, avg(log_loss) AS mean_log_loss, avg(brier) AS mean_brier,
 count(absolute_price_error) AS point_forecasts, avg(absolute_price_error) AS price_mae, avg(price_ape) AS price_mape, avg(interval_hit) AS interval_coverage
 FROM v_daily WHERE status = 'scored' GROUP BY ALL)""")
def ledger_summary(v):
    return rounded(L.ledger_summary(v.daily))


@query("official_forecast", """WITH r AS (SELECT * FROM v_ranked WHERE is_prospective AND model <> 'Candidate evening forecast'),
 f AS (SELECT instrument, prediction_date, run_id FROM r WHERE kind = 'direction' QUALIFY row_number() OVER (PARTITION BY instrument, prediction_date ORDER BY same_day, created_at, record_id) = 1)
 SELECT r.instrument, r.prediction_date, r.run_id, r.kind, r.model, r.horizon_days, r.record_id FROM r JOIN f USING (instrument, prediction_date, run_id)
 WHERE kind = 'direction' OR NOT (starts_with(model, 'Candidate') OR starts_with(model, 'Post-open'))""")
def official_forecast(v):
    return L.official_runs(v.scored, since=SAME_DAY).select(
        "instrument", "prediction_date", "run_id", "kind", "model", "horizon_days", "record_id")


@query("prospective_deadline", "SELECT record_id, created_at, information_cutoff, target_mode, is_prospective, CAST(target_date AS TIMESTAMP) + CASE WHEN kind = 'open' THEN INTERVAL 5 MINUTE ELSE INTERVAL 400 MINUTE END <= (SELECT now FROM v_now) AS scorable FROM v_pro")
def prospective_deadline(v):
    return L.prospective(v.ledger).select("record_id", "created_at", "information_cutoff", "target_mode", "is_prospective",
                                          L.scorable(v.now).alias("scorable"))


@query("interval_coverage_by_event", f"""SELECT model, kind, horizon_days, CAST(ne AS BIGINT) AS n_event, CAST(nn AS BIGINT) AS n_normal, {rd('coverage_event coverage_normal')} FROM (
 SELECT *, CASE WHEN ne >= 10 THEN ce END AS coverage_event, CASE WHEN nn >= 10 THEN cn END AS coverage_normal FROM (
 SELECT model, kind, horizon_days, count(*) FILTER (event_flags <> '') AS ne, count(*) FILTER (event_flags = '') AS nn, avg(interval_hit) FILTER (event_flags <> '') AS ce, avg(interval_hit) FILTER (event_flags = '') AS cn
 FROM v_daily WHERE status = 'scored' AND interval_hit IS NOT NULL GROUP BY ALL))""")
def interval_coverage_by_event(v):
    return rounded(L.interval_coverage_by_event(v.daily))


@query("issuance_rate", f"""WITH f AS (SELECT * FROM v_scored WHERE is_prospective AND kind = 'price' AND NOT starts_with(model, 'Candidate') AND NOT starts_with(model, 'Post-open')
  QUALIFY row_number() OVER (PARTITION BY instrument, horizon_days, prediction_date ORDER BY created_at, record_id) = 1),
 k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY instrument, horizon_days ORDER BY prediction_date DESC) <= 60)
 SELECT instrument, horizon_days, count(*) AS n, round(avg(CAST(signal IN ('yes', 'unverified') AS INT)), 6) AS issued_share, round(avg(CAST(signal = 'yes' AS INT)), 6) AS verified_share FROM k GROUP BY ALL""")
def issuance_rate(v):
    return rounded(L.issuance_rate(v.scored))


_review = """d AS (SELECT * FROM v_daily WHERE status = 'scored'),
 days AS (SELECT instrument, target_date, row_number() OVER (PARTITION BY instrument ORDER BY target_date DESC) AS k FROM (SELECT DISTINCT instrument, target_date FROM d)),
 r AS (SELECT d.*, win FROM d JOIN (SELECT instrument, target_date, win FROM days JOIN (SELECT unnest([20, 60]) AS win) ON k <= win) USING (instrument, target_date)),
 dir AS (SELECT instrument, win, count(*) AS n, avg(direction_correct) AS hit_rate, avg(log_loss) AS mean_log_loss, avg(CAST(actual_class = 0 AS INT)) AS f0, avg(CAST(actual_class = 1 AS INT)) AS f1, avg(CAST(actual_class = 2 AS INT)) AS f2
  FROM r WHERE kind = 'direction' AND model = 'Mean ensemble' AND actual_class IS NOT NULL GROUP BY ALL),
 a AS (SELECT instrument, win, 'direction' AS kind, CAST(1 AS BIGINT) AS horizon_days, n, hit_rate, greatest(f0, f1, f2) AS prior_hit_rate, mean_log_loss,
   -(f0 * ln(greatest(f0, 1e-7)) + f1 * ln(greatest(f1, 1e-7)) + f2 * ln(greatest(f2, 1e-7))) AS prior_log_loss, CAST(NULL AS DOUBLE) AS interval_coverage, CAST(NULL AS DOUBLE) AS mae_return, CAST(NULL AS DOUBLE) AS zero_mae_return, CAST(NULL AS DOUBLE) AS realized_slope FROM dir
  UNION ALL SELECT instrument, win, kind, horizon_days, count(*), NULL, NULL, NULL, NULL, avg(interval_hit), avg(abs(actual_return - coalesce(predicted_return, 0))), avg(abs(actual_return)),
   CASE WHEN count(predicted_return) >= 5 AND sum(predicted_return * predicted_return) > 0 THEN sum(predicted_return * actual_return) / sum(predicted_return * predicted_return) END
  FROM r WHERE kind IN ('open', 'price') AND NOT starts_with(model, 'Candidate') AND NOT starts_with(model, 'Post-open') AND actual_return IS NOT NULL GROUP BY ALL)"""


@query("rolling_review", f"""WITH {_review} SELECT instrument, win, kind, horizon_days, n, {rd('hit_rate prior_hit_rate mean_log_loss prior_log_loss interval_coverage mae_return zero_mae_return realized_slope')},
 CASE WHEN win = 60 AND n >= 20 THEN concat_ws(',', CASE WHEN mean_log_loss > prior_log_loss THEN 'direction_worse_than_prior' END, CASE WHEN interval_coverage < 0.70 THEN 'interval_too_narrow' END,
  CASE WHEN mae_return > zero_mae_return THEN 'point_worse_than_zero' END) ELSE '' END AS alerts FROM a""")
def rolling_review(v):
    return rounded(L.rolling_review(v.daily))


@query("pair_morning_evening", f"""WITH s AS (SELECT instrument, kind, target_date, model, avg(direction_correct) AS hit, avg(interval_hit) AS itv, avg(absolute_price_error) AS err FROM v_daily WHERE status = 'scored' AND horizon_days = 1 GROUP BY ALL)
 SELECT instrument, kind, n, {', '.join(f'round(CASE WHEN n >= 10 THEN {c} END, 6) AS {c}' for c in ('hit_a', 'hit_b', 'interval_a', 'interval_b', 'error_a', 'error_b'))} FROM (
 SELECT a.instrument, a.kind, count(*) AS n, avg(a.hit) AS hit_a, avg(b.hit) AS hit_b, avg(a.itv) AS interval_a, avg(b.itv) AS interval_b, avg(a.err) AS error_a, avg(b.err) AS error_b
 FROM s a JOIN s b USING (instrument, kind, target_date) WHERE a.model = 'Mean ensemble' AND b.model = 'Candidate evening forecast' GROUP BY ALL)""")
def pair_morning_evening(v):
    return rounded(L.morning_evening(v.daily, "Mean ensemble", "Candidate evening forecast"))


@query("ledger_health", """WITH l AS (SELECT instrument, max(prediction_date) AS last_forecast FROM v_ledger WHERE CAST(created_at + INTERVAL 9 HOUR AS DATE) <= prediction_date AND prediction_date <= (SELECT CAST(now AS DATE) FROM v_now) GROUP BY 1),
 t AS (SELECT max(session) AS latest_session, max(ordinal) AS top FROM v_cal WHERE session <= (SELECT CAST(now AS DATE) FROM v_now))
 SELECT instrument, last_forecast, latest_session, top - ordinal AS missed_sessions, top = ordinal AS healthy FROM l JOIN v_cal ON session = last_forecast CROSS JOIN t""")
def ledger_health(v):
    return L.health(v.ledger, v.calendar, v.now.cast("date"))


@query("pending_items", """WITH m AS (SELECT instrument, max(target_date) AS target_date FROM v_daily GROUP BY 1)
 SELECT instrument, target_date, kind, arg_min(status, record_id) AS status FROM v_daily JOIN m USING (instrument, target_date)
 WHERE kind = 'open' OR (kind = 'direction' AND model = 'Mean ensemble') OR (kind = 'price' AND horizon_days = 1) GROUP BY ALL""")
def pending_items(v):
    return L.pending_items(v.daily)


def outlook_documents(v):
    """Per series and month: a drift forecast three months out, a band and a probability of growth."""
    f = v.series.withColumn("p", M.lag("value")).withColumn("sd", M.roll(F.stddev_samp, "value", 12)).dropna()
    point = F.col("value") + (F.col("value") - F.col("p")) * 0.1
    return f.select("series_id", F.col("month").alias("as_of"), F.add_months("month", 3).alias("target"), "value", point.alias("point"),
                    (point - F.col("sd")).alias("low"), (point + F.col("sd")).alias("high"),
                    F.when(F.col("value") < F.col("p"), 0.6).otherwise(0.4).alias("p_up"))


ITEMS = [
    {"series": "level", "kind": "value", "target": "target", "point": "point", "low": "low", "high": "high", "baseline": "value"},
    {"series": "growth", "kind": "probability", "target": "target", "probability": "p_up", "baseline_probability": "half"},
]

_docs = """od AS (SELECT series_id, month AS as_of, CAST(month + INTERVAL 3 MONTH AS DATE) AS target, value, value + (value - p) * 0.1 AS point, value + (value - p) * 0.1 - sd AS low, value + (value - p) * 0.1 + sd AS high, CASE WHEN value < p THEN 0.6 ELSE 0.4 END AS p_up FROM (
  SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY month) AS p, CASE WHEN count(value) OVER w = 12 THEN stddev_samp(value) OVER w END AS sd FROM v_series WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS 11 PRECEDING)) WHERE p IS NOT NULL AND sd IS NOT NULL),
 orw AS (SELECT 'level:' || series_id AS series, 'value' AS kind, as_of, target AS target_period, point, low, high, value AS baseline, NULL::DOUBLE AS probability, NULL::DOUBLE AS baseline_probability FROM od
  UNION ALL SELECT 'growth:' || series_id, 'probability', as_of, target, NULL, NULL, NULL, NULL, p_up, 0.5 FROM od),
 oi AS (SELECT *, series || '|' || as_of || '|' || target_period AS record_id FROM orw)"""


def outlook(v):
    return O.outlook_rows(outlook_documents(v).withColumn("half", F.lit(0.5)), ITEMS)


@query("outlook_rows", f"WITH {_docs} SELECT record_id, series, kind, as_of, target_period, {rd('point low high baseline', 4)}, probability::DOUBLE AS probability, baseline_probability FROM oi")
def outlook_rows(v):
    f = outlook(v)
    return f.select(*[F.round(c, 4).alias(c) if c in ("point", "low", "high", "baseline") else F.col(c) for c in f.columns])


def outlook_actuals(v):
    level = v.series.select("series_id", "month", F.col("value").alias("actual"))
    growth = v.series.withColumn("actual", (F.col("value") > M.lag("value", 3)).cast("double")).filter("actual is not null")
    return O.union_actuals({"level": level, "growth": growth.select("series_id", "month", "actual")})


_acts = """oa AS (SELECT 'level:' || series_id AS series, month AS target_period, value AS actual FROM v_series UNION ALL SELECT 'growth:' || series_id, month, CAST(value > p AS DOUBLE) FROM (SELECT *, lag(value, 3) OVER (PARTITION BY series_id ORDER BY month) AS p FROM v_series) WHERE p IS NOT NULL),
 onw AS (SELECT series, max(target_period) AS last FROM oa GROUP BY 1)"""


@query("actuals_hook", f"WITH {_acts} SELECT series, target_period, actual FROM oa")
def actuals_hook(v):
    return outlook_actuals(v)


@query("score_outlook", f"""WITH {_docs}, {_acts}, j AS (SELECT oi.*, a.actual FROM oi LEFT JOIN (SELECT oa.* FROM oa JOIN onw USING (series) WHERE target_period < last) a USING (series, target_period))
 SELECT record_id, series, kind, target_period, CASE WHEN actual IS NOT NULL THEN 'scored' ELSE 'pending' END AS status, round(actual, 4) AS actual, round(point - actual, 4) AS error, round(abs(point - actual), 4) AS abs_error,
 round(abs(baseline - actual), 4) AS baseline_abs_error, CASE WHEN kind = 'value' THEN CAST(low <= actual AND actual <= high AS DOUBLE) END AS in_band, round(pow(probability - actual, 2), 4) AS brier, round(pow(baseline_probability - actual, 2), 4) AS baseline_brier FROM j""")
def score_outlook(v):
    acts = outlook_actuals(v)
    newest = acts.groupBy("series").agg(F.max("target_period").alias("last_period"))
    return rounded(O.score_outlook(outlook(v), acts, newest), 4)


@query("first_passage", """WITH i AS (SELECT instrument, session AS issued, ordinal, d AS days, close * (1 + d / 100.0) AS level FROM v_bars JOIN v_cal USING (session) CROSS JOIN (SELECT unnest([5, 20]) AS d)),
 f AS (SELECT instrument, ordinal, close FROM v_bars JOIN v_cal USING (session))
 SELECT instrument, issued, days, round(level, 9) AS level, count(close) AS seen, CASE WHEN max(close) >= level THEN 1.0::DOUBLE WHEN count(close) >= days THEN 0.0 END AS reached
 FROM i LEFT JOIN f ON f.instrument = i.instrument AND f.ordinal BETWEEN i.ordinal + 1 AND i.ordinal + days GROUP BY i.instrument, issued, days, level""".replace("SELECT instrument, issued, days, round", "SELECT i.instrument, issued, days, round"))
def first_passage(v):
    cal = v.calendar
    i = v.bars.join(cal.select("session", "ordinal"), "session").withColumn("days", F.explode(F.array(F.lit(5), F.lit(20))))
    i = i.select("instrument", F.col("session").alias("issued"), "days", (F.col("close") * (1 + F.col("days") / 100)).alias("level"))
    return rounded(O.first_passage(i, v.bars, cal), 9)


@query("level_reach_history", " UNION ALL ".join(f"""SELECT instrument, {n} AS horizon, {x}::DOUBLE AS level, count(*) AS n, round(avg(CAST(m >= {x} AS INT)), 6) AS share FROM (SELECT instrument, CASE WHEN count(close) OVER w = {n} THEN max(close) OVER w / close - 1 END AS m
 FROM v_bars WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)) WHERE m IS NOT NULL GROUP BY 1""" for n in (5, 20, 60) for x in (0.02, 0.05, 0.1)))
def level_reach_history(v):
    return rounded(O.level_reach_history(v.bars))


@query("score_ai_daily", """WITH d AS (SELECT instrument, session AS target_date, close, open, high, ret, CASE WHEN pr > 0 THEN 'up' WHEN pr < 0 THEN 'down' WHEN pr = 0 THEN 'flat' ELSE 'none' END AS direction, pc FROM (SELECT *, lag(ret) OVER w AS pr, lag(close) OVER w AS pc FROM v_vol WINDOW w AS (PARTITION BY instrument ORDER BY session)))
 SELECT instrument, target_date, CASE WHEN close - pc > 0 THEN 'up' WHEN close - pc < 0 THEN 'down' ELSE 'flat' END AS actual_direction, CASE WHEN close - pc > 0 THEN 'up' WHEN close - pc < 0 THEN 'down' ELSE 'flat' END = direction AS direction_correct,
 round(abs(high - open) / open * 100, 6) AS open_ape_pct, round(abs(open - close) / close * 100, 6) AS close_ape_pct FROM d""")
def score_ai_daily(v):
    f = B.with_vol20(v.bars)
    f = f.withColumns({"_before": B.lagged("close", 1), "_last": B.lagged("ret", 1)})
    way = F.when(F.col("_last") > 0, "up").when(F.col("_last") < 0, "down").when(F.col("_last") == 0, "flat").otherwise("none")
    docs = f.select("instrument", F.col("session").alias("target_date"), F.col("_before").alias("previous_close"), F.col("high").alias("predicted_open"),
                    F.col("open").alias("predicted_close"), way.alias("direction"))
    return rounded(O.score_daily_document(docs, v.bars))


@query("interval_coverage_path", """WITH f AS (SELECT series_id, month, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY month) AS p FROM v_series), s AS (SELECT *, abs(y - p) / greatest(abs(p), 1e-9) AS s FROM f WHERE p IS NOT NULL),
 n AS (SELECT *, count(s) OVER w AS known, list_sort(list(s) OVER w) AS a FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
 SELECT series_id, month, known, round(h, 6) AS halfwidth, CASE WHEN h IS NOT NULL THEN CAST(s <= h AS DOUBLE) END AS hit FROM (SELECT *, CASE WHEN known >= 8 THEN a[CAST(least(ceil((known + 1) * 0.8 - 1e-12), known) AS INT)] END AS h FROM n)""")
def interval_coverage_path(v):
    f = v.series.select("series_id", "month", F.col("value").alias("y"), M.lag("value").alias("p")).filter("p is not null")
    return rounded(O.interval_coverage_path(f, "series_id", "month", "y", "p").select("series_id", "month", "known", "halfwidth", "hit"))


@query("p18_check", f"""WITH d AS (SELECT * FROM v_daily WHERE kind = 'direction'), r AS (SELECT instrument, target_date, target_mode, p_down, p_flat, p_up FROM d WHERE model = 'Mean ensemble'), b AS (SELECT instrument, target_date, target_mode, p_down, p_flat, p_up FROM d WHERE model = 'Candidate evening forecast')
 SELECT instrument, count(*) AS n, round(avg(CAST(ca = cb AS INT)), 6) AS same_call, round(avg(far), 6) AS mean_gap, round(avg(CAST(far <= 0.2 AS INT)), 6) AS within FROM (SELECT r.instrument, greatest(abs(r.p_down - b.p_down), abs(r.p_flat - b.p_flat), abs(r.p_up - b.p_up)) AS far,
  CASE WHEN r.p_down >= r.p_flat AND r.p_down >= r.p_up THEN 0 WHEN r.p_flat >= r.p_up THEN 1 ELSE 2 END AS ca, CASE WHEN b.p_down >= b.p_flat AND b.p_down >= b.p_up THEN 0 WHEN b.p_flat >= b.p_up THEN 1 ELSE 2 END AS cb FROM r JOIN b USING (instrument, target_date, target_mode)) GROUP BY 1""")
def p18_check(v):
    d = v.daily.filter("kind = 'direction'").select("model", "instrument", "target_date", "target_mode", "p_down", "p_flat", "p_up")
    return rounded(O.agreement(d.filter("model = 'Mean ensemble'"), d.filter("model = 'Candidate evening forecast'"), "instrument",
                               ["instrument", "target_date", "target_mode"], tolerance=0.2))
