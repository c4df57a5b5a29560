"""Grouped statistics: ledgers, probabilities, prices, series, traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import events as E
from ..operators import macro as M
from ..operators import metrics as X
from ..operators import sets as S
from ..operators import traffic as T
from .bindings import sql_unit, unit
from .joins import _history, mailing
from .registry import query
from .rounding import rd, rounded
from .windows import SW, _fk, _long, _runs, full, lag, lead

PRICE = "SELECT * FROM v_daily WHERE kind = 'price' AND status = 'scored'"
DIRECTION = "SELECT *, greatest(p_down, p_flat, p_up) AS conf, direction_correct AS hit FROM v_daily WHERE kind = 'direction' AND actual_class IS NOT NULL"


def price_rows(v):
    return v.daily.filter("kind = 'price' and status = 'scored'")


def direction_rows(v):
    return v.daily.filter("kind = 'direction' and actual_class is not null")


@query("ledger_status_counts", """WITH p AS (SELECT *, target_date <= (SELECT CAST(now AS DATE) FROM v_now) AS matured FROM v_scored WHERE kind = 'price'),
 c AS (SELECT instrument, model, horizon_days, count(*) AS n, count(*) FILTER (is_prospective) AS n_prospective, count(*) FILTER (signal IN ('yes', 'unverified')) AS n_issued, count(*) FILTER (signal = 'no') AS n_held,
  count(*) FILTER (matured) AS n_matured, count(*) FILTER (status = 'scored') AS n_scored, count(*) FILTER (status = 'pending') AS n_pending, list_sort(list(DISTINCT prediction_date) FILTER (matured)) AS d FROM p GROUP BY ALL)
 SELECT * EXCLUDE (d), len(list_reduce(d, lambda acc, x: CASE WHEN date_diff('day', acc[-1], x) >= 7 * horizon_days / 5 THEN list_append(acc, x) ELSE acc END, d[1:1])) AS n_nonoverlap FROM c""")
def ledger_status_counts(v):
    return X.ledger_status_counts(v.scored, v.now.cast("date"))


@query("class_prior", f"""SELECT model, n, {', '.join(f'round(greatest(f{k}, 1e-7) / (greatest(f0, 1e-7) + greatest(f1, 1e-7) + greatest(f2, 1e-7)), 6) AS prior_{k}' for k in range(3))},
 round(-({' + '.join(f'f{k} * ln(greatest(f{k}, 1e-7))' for k in range(3))}), 6) AS prior_log_loss, round(greatest(f0, f1, f2), 6) AS prior_hit_rate
 FROM (SELECT model, count(*) AS n, {', '.join(f'avg(CAST(actual_class = {k} AS INT)) AS f{k}' for k in range(3))} FROM ({DIRECTION}) GROUP BY 1)""")
def class_prior(v):
    return rounded(X.class_prior(direction_rows(v), "model"))


def gap_buckets(v):
    f = B.with_vol20(v.bars)
    g = B.ratio("open", B.lagged("close")) - 1
    band = 0.3 * B.lagged("vol20")
    return f.select("instrument", B.class_of(g, band).alias("bucket"), B.class_of("ret", band).alias("y")).dropna()


_bucketed = f"""bk AS (SELECT instrument, CASE WHEN g < -band THEN 0 WHEN g > band THEN 2 ELSE 1 END AS bucket, CASE WHEN ret < -band THEN 0 WHEN ret > band THEN 2 ELSE 1 END AS y
 FROM (SELECT instrument, ret, open / {lag('close')} - 1 AS g, 0.3 * {lag('vol20')} AS band FROM v_vol) WHERE g IS NOT NULL AND band IS NOT NULL AND ret IS NOT NULL)"""


@query("bucket_conditional", f"""WITH {_bucketed}, g AS (SELECT instrument, bucket, count(*) AS n, {', '.join(f'count(*) FILTER (y = {k}) AS c{k}' for k in range(3))} FROM bk GROUP BY ALL),
 a AS (SELECT instrument, sum(n) AS na, {', '.join(f'sum(c{k}) AS a{k}' for k in range(3))} FROM g GROUP BY 1)
 SELECT instrument, bucket, n, {', '.join(f'round(CASE WHEN n < 20 THEN (a{k} + 1) / (na + 3) ELSE (c{k} + 1) / (n + 3) END, 6) AS p{k}' for k in range(3))} FROM g JOIN a USING (instrument)""")
def bucket_conditional(v):
    return rounded(X.bucket_conditional(gap_buckets(v), "instrument"))


@query("reliability_bins", f"SELECT model, CAST(least(floor((conf - 1.0::DOUBLE / 3) / ((1 - 1.0::DOUBLE / 3) / 5)), 4) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(hit), 6) AS hit_rate FROM ({DIRECTION}) GROUP BY ALL")
def reliability_bins(v):
    return rounded(X.reliability_bins(direction_rows(v), "model"))


@query("abstention_table", f"""SELECT model, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (conf >= threshold) AS selected, count(*) AS total, round(avg(hit) FILTER (conf >= threshold), 6) AS selected_accuracy, round(avg(hit), 6) AS overall_accuracy,
 round(count(*) FILTER (conf >= threshold) / count(*), 6) AS coverage FROM ({DIRECTION}) CROSS JOIN (SELECT unnest([0.0, 0.5, 0.6, 0.7]) AS threshold) GROUP BY ALL""")
def abstention_table(v):
    return rounded(X.abstention_table(direction_rows(v), "model"))


@query("balanced_accuracy", f"SELECT model, count(*) AS classes, round(avg(r), 6) AS balanced_accuracy FROM (SELECT model, actual_class, avg(hit) AS r FROM ({DIRECTION}) GROUP BY ALL) GROUP BY 1")
def balanced_accuracy(v):
    return rounded(X.balanced_accuracy(direction_rows(v), "model"))


@query("score_mae_rmse_hit", f"""WITH pr AS (SELECT *, actual_return AS y, predicted_return AS p FROM ({PRICE}) WHERE actual_return IS NOT NULL),
 kn AS (SELECT *, max({{'d': target_date, 'y': y}}) OVER (PARTITION BY instrument, horizon_days ORDER BY target_date RANGE BETWEEN INTERVAL 371 DAYS PRECEDING AND INTERVAL 364 DAYS PRECEDING).y AS season FROM (SELECT instrument, horizon_days, target_date, max(y) AS y FROM pr GROUP BY ALL)),
 sn AS (SELECT pr.*, kn.season FROM pr LEFT JOIN kn USING (instrument, horizon_days, target_date))
 SELECT model, horizon_days, n, {rd('mae rmse hit')}, direction_n, {rd('mape corr mae_zero')}, n_both, {rd('mae_both mae_zero_both mae_seasonal resid_q10 resid_q90')}, mae < mae_zero AS beats_zero, mae_both < least(mae_zero_both, mae_seasonal) AS beats_both
 FROM (SELECT model, horizon_days, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(CAST(sign(p) = sign(y) AS DOUBLE)) FILTER (p <> 0) AS hit, count(*) FILTER (p <> 0) AS direction_n, avg(abs((y - p) / nullif(y, 0))) AS mape, corr(y, p) AS corr, avg(abs(y)) AS mae_zero,
 count(season) AS n_both, avg(abs(y - p)) FILTER (season IS NOT NULL) AS mae_both, avg(abs(y)) FILTER (season IS NOT NULL) AS mae_zero_both, avg(abs(y - season)) AS mae_seasonal, quantile_cont(y - p, 0.1) AS resid_q10, quantile_cont(y - p, 0.9) AS resid_q90 FROM sn WHERE p IS NOT NULL GROUP BY ALL)""")
def score_mae_rmse_hit(v):
    return rounded(X.score_errors(price_rows(v), ["model", "horizon_days"], "actual_return", "predicted_return", ["instrument", "horizon_days"]))


@query("interval_score", f"""SELECT model, horizon_days, n, {rd('score coverage width')} FROM (SELECT model, horizon_days, count(*) AS n, avg((high_close - low_close) + 10 * greatest(low_close - actual_close, 0) + 10 * greatest(actual_close - high_close, 0)) AS score,
 avg(CAST(low_close <= actual_close AND actual_close <= high_close AS DOUBLE)) AS coverage, avg(high_close - low_close) AS width FROM ({PRICE}) WHERE actual_close IS NOT NULL AND low_close IS NOT NULL GROUP BY ALL)""")
def interval_score(v):
    return rounded(X.interval_scores(price_rows(v), ["model", "horizon_days"], "actual_close", "low_close", "high_close"))


def sigma_rows(v):
    s = B.with_vol20(v.bars).select("instrument", F.col("session").alias("target_date"), F.lag("vol20").over(B.series("instrument", "session")).alias("sigma"))
    return price_rows(v).join(s, ["instrument", "target_date"]).filter("horizon_days = 1 and actual_return is not null and sigma is not null")


_sigma = f"""sg AS (SELECT p.*, s.sigma FROM ({PRICE}) p JOIN (SELECT instrument, session AS target_date, {lag('vol20')} AS sigma FROM v_vol) s USING (instrument, target_date) WHERE horizon_days = 1 AND actual_return IS NOT NULL AND sigma IS NOT NULL)"""


@query("regime_table", f"""WITH {_sigma}, q AS (SELECT model, quantile_cont(sigma, 1.0::DOUBLE / 3) AS q1, quantile_cont(sigma, 2.0::DOUBLE / 3) AS q2 FROM sg WHERE target_date < DATE '1998-01-01' GROUP BY 1)
 SELECT model, regime, n, {rd('zero_mae raw_mae shrunk_mae interval_coverage')} FROM (SELECT model, CASE WHEN sigma <= q1 THEN 'low' WHEN sigma <= q2 THEN 'mid' ELSE 'high' END AS regime, count(*) AS n, avg(abs(actual_return)) AS zero_mae,
 avg(abs(actual_return - predicted_return)) AS raw_mae, avg(abs(actual_return - 0.5 * predicted_return)) AS shrunk_mae, avg(interval_hit) AS interval_coverage FROM sg JOIN q USING (model) WHERE target_date >= DATE '1998-01-01' GROUP BY ALL)""")
def regime_table(v):
    return rounded(X.regime_table(sigma_rows(v), "model", "sigma", F.col("target_date") < F.lit("1998-01-01").cast("date"), "actual_return", "predicted_return", 0.5, "interval_hit"))


@query("nonoverlap_offsets", f"""WITH p AS (SELECT model, instrument, actual_return AS y, predicted_return AS r, CAST((row_number() OVER (PARTITION BY instrument, model ORDER BY target_date, record_id) - 1) % 5 AS INT) AS "offset" FROM ({PRICE}) WHERE horizon_days = 5)
 SELECT instrument, model, "offset", count(*) AS n, round(avg(abs(y - r) - abs(y)), 6) AS raw_minus_zero, round(avg(abs(y - 0.5 * r) - abs(y)), 6) AS shrunk_minus_zero FROM p GROUP BY ALL""")
def nonoverlap_offsets(v):
    return rounded(X.nonoverlap_offsets(price_rows(v).filter("horizon_days = 5"), ["instrument", "model"], ["target_date", "record_id"], 5, "actual_return", "predicted_return", 0.5))


_leg = """lg AS (SELECT d.*, gap, intraday FROM (SELECT *, p_up - p_down AS score FROM v_daily WHERE kind = 'direction' AND status = 'scored') d JOIN
 (SELECT instrument, session AS target_date, open / lag(close) OVER (PARTITION BY instrument ORDER BY session) - 1 AS gap, close / open - 1 AS intraday FROM v_bars) l USING (instrument, target_date))"""


def leg_rows(v):
    legs = B.returns_and_legs(v.bars).withColumnRenamed("session", "target_date")
    d = v.daily.filter("kind = 'direction' and status = 'scored'").withColumn("score", F.col("p_up") - F.col("p_down"))
    return d.join(legs, ["instrument", "target_date"])


def _auc_sql(leg: str) -> str:
    return f"""SELECT model, '{leg}' AS leg, n, n1 AS n_pos, round(CASE WHEN n >= 30 AND n1 > 0 AND n > n1 THEN (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * (n - n1)) END, 6) AS auc FROM (
 SELECT model, count(*) AS n, CAST(sum(CAST(up AS INT)) AS BIGINT) AS n1, sum(r) FILTER (up) AS s FROM (SELECT model, {leg} > 0 AS up, rank() OVER w + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0::DOUBLE AS r
 FROM lg WHERE {leg} <> 0 AND score IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY score)) GROUP BY 1)"""


@query("sign_auc", f"WITH {_leg} {_auc_sql('gap')} UNION ALL {_auc_sql('intraday')}")
def sign_auc(v):
    f = leg_rows(v)
    legs = F.explode(F.array(*[F.struct(F.lit(x).alias("leg"), F.col(x).alias("r")) for x in ("gap", "intraday")]))
    long = f.select("model", "score", legs.alias("l")).select("model", "score", "l.*")
    return rounded(X.sign_auc(long, ["model", "leg"], "score", "r"))


@query("session_pnl", f"""WITH {_leg}, t AS (SELECT model, intraday * CASE WHEN p_down >= p_flat AND p_down >= p_up THEN -1 WHEN p_flat >= p_up THEN NULL ELSE 1 END AS r FROM lg)
 SELECT model, count(r) AS traded, round(avg(r) * 1e4, 6) AS gross_bp, round(avg(r) * 1e4 - 20, 6) AS net_bp FROM t GROUP BY 1""")
def session_pnl(v):
    from ..functions.prob import argmax, vector

    return rounded(X.session_pnl(leg_rows(v).withColumn("cls", argmax(vector())), "model", "intraday", "cls"))


@query("describe_conditional", f"""WITH f AS (SELECT instrument, session, (close - lo) / nullif(hi - lo, 0) AS place, fwd FROM (SELECT *, {full('min', 'close', 60)} AS lo, {full('max', 'close', 60)} AS hi, {lead('close', 20)} / close - 1 AS fwd FROM v_bars)),
 n AS (SELECT instrument, arg_max(place, session) AS now FROM f GROUP BY 1), x AS (SELECT f.*, now FROM f JOIN n USING (instrument) WHERE place IS NOT NULL AND fwd IS NOT NULL),
 t AS (SELECT instrument, 'all' AS sample, fwd FROM x UNION ALL SELECT instrument, 'similar', fwd FROM x WHERE abs(place - now) <= 0.1),
 g AS (SELECT instrument, sample, count(*) AS n, quantile_cont(fwd, 0.5) AS median, quantile_cont(fwd, 0.25) AS q25, quantile_cont(fwd, 0.75) AS q75, avg(CAST(fwd > 0 AS INT)) AS up_share FROM t GROUP BY ALL)
 SELECT instrument, sample, n, {', '.join(f"round(CASE WHEN sample = 'all' OR n >= 20 THEN {c} END, 6) AS {c}" for c in ('median', 'q25', 'q75', 'up_share'))} FROM g""")
def describe_conditional(v):
    return rounded(X.describe_conditional(v.bars))


_chart = f"""WITH {_runs}, c AS (SELECT *, 0.3 * {lag('vol20')} AS band FROM runs),
 k AS (SELECT *, CASE WHEN ret IS NULL OR band IS NULL THEN NULL WHEN ret < -band THEN 0 WHEN ret > band THEN 2 ELSE 1 END AS cls FROM c),
 s AS (SELECT *, {lead('cls')} AS nc, {lead('ret')} AS nr, {lead('close', 5)} / close - 1 AS n5, session >= DATE '1999-01-01' AS recent FROM k),
 l AS (SELECT instrument, recent, nc, nr, n5, unnest(list_filter(['base', CASE WHEN dir = -1 AND run >= 3 THEN 'down_streak' END, CASE WHEN ret_5d <= -0.08 THEN 'drop_5d' END, CASE WHEN ret <= -0.04 THEN 'drop_1d' END, CASE WHEN off_high <= -0.10 THEN 'off_high_20d' END,
   CASE WHEN dir = 1 AND run >= 3 THEN 'up_streak' END, CASE WHEN ret_5d >= 0.08 THEN 'rise_5d' END, CASE WHEN ret >= 0.04 THEN 'rise_1d' END], lambda x: x IS NOT NULL)) AS signal FROM s WHERE nc IS NOT NULL),
 w AS (SELECT l.*, scope FROM l JOIN (SELECT instrument, signal, CASE WHEN count(*) FILTER (recent) >= 20 THEN 'recent' ELSE 'all' END AS scope FROM l GROUP BY ALL) USING (instrument, signal)),
 g AS (SELECT instrument, signal, scope, count(*) AS n, avg(CAST(nc = 0 AS INT)) AS down, avg(CAST(nc = 1 AS INT)) AS flat, avg(CAST(nc = 2 AS INT)) AS up, avg(nr) AS mean_next, avg(n5) AS mean_5d FROM w WHERE recent OR scope = 'all' GROUP BY ALL),
 b AS (SELECT instrument, avg(CAST(nc = 2 AS INT)) FILTER (recent) AS br, avg(CAST(nc = 2 AS INT)) AS ba FROM l WHERE signal = 'base' GROUP BY 1)
 SELECT instrument, signal, scope, n, {rd('down flat up mean_next mean_5d')}, abs(up - bu) > 2 * sqrt(bu * (1 - bu) / n) AS up_differs FROM (SELECT g.*, CASE WHEN scope = 'recent' THEN br ELSE ba END AS bu FROM g JOIN b USING (instrument)) WHERE signal <> 'base'"""


@query("chart_situation_stats", _chart)
def chart_situation_stats(v):
    return rounded(X.chart_situation_stats(v.bars, "1999-01-01"))


@query("earnings_reactions", f"""WITH f AS (SELECT instrument, session, ret, {lag('close', 1)} / {lag('close', 21)} - 1 AS prior20, {lead('close', 5)} / close - 1 AS next5 FROM v_vol),
 e AS (SELECT * FROM f SEMI JOIN (SELECT date AS session FROM v_evdays) USING (session) WHERE prior20 IS NOT NULL)
 SELECT instrument, count(*) AS n, count(*) FILTER (ret < 0) AS down, round(avg(ret), 6) AS mean_ret, count(*) FILTER (prior20 > 0) AS prior_up_n, count(*) FILTER (prior20 > 0 AND ret < 0) AS prior_up_down, count(*) FILTER (prior20 <= 0) AS prior_down_n,
 count(*) FILTER (prior20 <= 0 AND ret < 0) AS prior_down_down, count(*) FILTER (prior20 <= 0 AND next5 IS NOT NULL) AS prior_down_next5_n, count(*) FILTER (prior20 <= 0 AND next5 > 0) AS prior_down_next5_up FROM e GROUP BY 1 HAVING count(*) >= 8""")
def earnings_reactions(v):
    return rounded(E.event_reactions(v.bars, v.event_days))


def event_marks(v):
    after = E.next_calendar_date(v.event_days.select("date").distinct(), "date", v.calendar).select(F.lit("next").alias("definition"), F.col("next_session").alias("session"))
    near = E.events_before(v.calendar.select("session"), v.event_days).filter("labels <> ''").select(F.lit("flagged").alias("definition"), "session")
    return after.unionByName(near).filter("session is not null").distinct()


@query("group_gap_stats", f"""WITH m AS (SELECT DISTINCT 'next' AS definition, (SELECT min(session) FROM v_cal c WHERE c.session > date) AS session FROM v_evdays UNION SELECT 'flagged', session FROM v_cal JOIN v_evdays ON date BETWEEN session - 4 AND session - 1),
 f AS (SELECT instrument, session, abs(open / {lag('close')} - 1) AS abs_gap, abs(close / {lag('close')} - 1) AS abs_move, abs(close / open - 1) AS abs_intraday FROM v_bars),
 x AS (SELECT f.*, d.definition, m.session IS NOT NULL AS is_event FROM f CROSS JOIN (SELECT unnest(['next', 'flagged']) AS definition) d LEFT JOIN m ON m.definition = d.definition AND m.session = f.session WHERE abs_gap IS NOT NULL)
 SELECT instrument, definition, is_event, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.5), 6) AS {c}_median' for c in ('abs_gap', 'abs_move', 'abs_intraday'))} FROM x GROUP BY ALL""")
def group_gap_stats(v):
    return rounded(E.group_gap_stats(v.bars, event_marks(v)))


@query("first_k_months", f"SELECT series_id, quarter_ord, round(value, 3) AS value FROM ({_fk('v_series', 'value')})")
def first_k_months(v):
    return rounded(M.first_k_months(v.series, 2), 3)


@query("monthly_resample", """SELECT instrument, month, n, round(mean_value, 6) AS mean_value, round(last_value, 6) AS last_value FROM (SELECT instrument, CAST(date_trunc('month', session) AS DATE) AS month, count(close) AS n, avg(close) AS mean_value,
 arg_max(close, session) AS last_value, min(session) AS a, max(session) AS b FROM v_thin GROUP BY ALL) WHERE n >= 10 AND day(a) <= 7 AND b >= last_day(month) - 7""")
def monthly_resample(v):
    return rounded(X.monthly_resample(v.thin, "instrument", "session", "close"))


_trail = f"""tr AS (SELECT t.*, b.close AS bench, max(t.session) OVER (PARTITION BY t.instrument) AS today, t.close / max(t.close) OVER (PARTITION BY t.instrument ORDER BY t.session) - 1 AS dd, t.close / lag(t.close) OVER (PARTITION BY t.instrument ORDER BY t.session) - 1 AS ret
 FROM v_thin t LEFT JOIN (SELECT session, close FROM v_bars WHERE instrument = 'A') b USING (session)),
 tg AS (SELECT instrument, arg_min(close, session) AS c0, arg_max(close, session) AS c1, min(dd) AS max_drawdown, stddev_samp(ret) * sqrt(252) AS volatility, max(close) AS peak, date_diff('day', min(session), max(session)) / 365.25::DOUBLE AS yrs,
  {', '.join(f"arg_max(close, session) FILTER (session <= today - {365 * y}) AS b{y}" for y in (1, 3, 5))}, arg_max(close, session) FILTER (session < CAST(date_trunc('year', today) AS DATE)) AS b_ytd,
  arg_min(close, session) FILTER (bench IS NOT NULL) AS o0, arg_max(close, session) FILTER (bench IS NOT NULL) AS o1, arg_min(bench, session) FILTER (bench IS NOT NULL) AS m0, arg_max(bench, session) FILTER (bench IS NOT NULL) AS m1 FROM tr GROUP BY 1),
 th AS (SELECT instrument, c1 / c0 - 1 AS total, c1 / b1 - 1 AS ret_1y, c1 / b3 - 1 AS ret_3y, c1 / b5 - 1 AS ret_5y, c1 / b_ytd - 1 AS ytd, CASE WHEN yrs > 0.5 THEN pow(c1 / c0, 1 / yrs) - 1 END AS cagr, max_drawdown, volatility, c1 / peak - 1 AS from_peak, o1 / o0 - m1 / m0 AS excess FROM tg)"""


def bench(v):
    return v.bars.filter("instrument = 'A'").select("session", F.col("close").alias("bench_close"))


@query("trailing_returns", f"WITH {_trail} SELECT instrument, {rd('total ret_1y ret_3y ret_5y ytd cagr max_drawdown volatility from_peak excess')} FROM th")
def trailing_returns(v):
    return rounded(X.trailing_returns(v.thin, bench(v)))


@query("excess_summary", f"WITH {_trail} SELECT 'all' AS all_rows, count(excess) AS n, count(*) FILTER (excess > 0) AS n_beat, round(quantile_cont(excess, 0.5), 6) AS median_excess, round(avg(total), 6) AS basket FROM th")
def excess_summary(v):
    return rounded(X.excess_summary(X.trailing_returns(v.thin, bench(v))))


@query("calendar_years", """WITH y AS (SELECT instrument, CAST(year(session) AS INT) AS year, arg_max(close, session) AS e, arg_min(close, session) AS s FROM v_thin GROUP BY ALL), p AS (SELECT *, lag(e) OVER (PARTITION BY instrument ORDER BY year) AS pe FROM y)
 SELECT instrument, year, round(e / coalesce(pe, s) - 1, 6) AS ret, pe IS NULL AS partial FROM p""")
def calendar_years(v):
    return rounded(X.calendar_years(v.thin))


_dims = ("country", "region", "city", "referrer")


@query("daily_traffic", f"""WITH h AS (SELECT *, CAST(ts AS DATE) AS day FROM v_hits), d AS ({' UNION ALL '.join(f"SELECT '{x}' AS dimension, day, {x} AS value, count(*) AS views, count(DISTINCT visitor) AS visitors FROM h GROUP BY ALL" for x in ('page', 'region', 'city'))}),
 t AS ({' UNION ALL '.join(f"SELECT '{x}' AS dimension, {x} AS value, count(*) AS views, count(DISTINCT visitor) AS visitors FROM h WHERE {x} <> '' GROUP BY ALL" for x in _dims)})
 SELECT dimension, day, value, views, visitors, NULL::INT AS rank FROM d WHERE value <> '' UNION ALL SELECT dimension, NULL, value, views, visitors, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY views DESC, value) AS rank FROM t) WHERE rank <= 30""")
def daily_traffic(v):
    return T.daily_traffic(v.hits)


_device = """CASE WHEN lower(ua) LIKE '%ipad%' OR lower(ua) LIKE '%tablet%' OR (lower(ua) LIKE '%android%' AND lower(ua) NOT LIKE '%mobile%') THEN 'tablet' WHEN lower(ua) LIKE '%mobile%' OR lower(ua) LIKE '%iphone%' THEN 'mobile'
 WHEN lower(ua) LIKE '%windows nt%' OR lower(ua) LIKE '%macintosh%' OR lower(ua) LIKE '%x11%' THEN 'desktop' ELSE 'unknown' END"""


@query("email_traffic", f"""WITH e AS (SELECT * FROM v_hits WHERE source = 'email') SELECT 'day_page' AS report, CAST(CAST(ts AS DATE) AS VARCHAR) AS a, page AS b, count(*) AS views FROM e GROUP BY ALL
 UNION ALL SELECT 'country', CASE WHEN regexp_full_match(country, '[A-Z][A-Z]') THEN country ELSE 'unknown' END, '', count(*) FROM e GROUP BY ALL UNION ALL SELECT 'device', {_device}, '', count(*) FROM e GROUP BY ALL""")
def email_traffic(v):
    return T.email_traffic(v.hits)


@query("delivery_rollup", f"""WITH {_history} SELECT edition, count(*) AS eligible, count(*) FILTER (attempts > 0) AS attempted, {', '.join(f"count(*) FILTER (status = '{s}') AS {a}" for s, a in (('sent', 'accepted'), ('failed', 'failed'), ('cancelled', 'cancelled'), ('sending', 'sending'), ('pending', 'remaining')))},
 max(sent_at) AS last_sent FROM hist GROUP BY 1""")
def delivery_rollup(v):
    editions, subs, deliveries, stopped, _ = mailing(v)
    return T.delivery_counts(editions, subs, deliveries, stopped)


@query("quality_report", """WITH s AS (SELECT *, strftime(ts, '%H:%M') AS slot FROM v_intraday), nv AS (SELECT instrument, session, count(*) AS nv FROM (SELECT *, lag(close) OVER (PARTITION BY instrument, slot ORDER BY session) AS pv FROM s) WHERE pv IS NULL OR pv <> close GROUP BY ALL),
 g AS (SELECT instrument, session, count(*) AS received, max(ts) AS latest FROM s GROUP BY ALL)
 SELECT instrument, session, received, coalesce(nv, 0) AS new_versions, 288 AS expected, 288 - received AS missing, round((288 - received) / 288.0::DOUBLE, 6) AS missing_ratio, date_diff('day', lag(session) OVER (PARTITION BY instrument ORDER BY session), session) AS interval_days,
 date_diff('second', latest, CAST(session + 1 AS TIMESTAMP)) AS latest_age_seconds FROM g LEFT JOIN nv USING (instrument, session)""")
def quality_report(v):
    return rounded(S.quality_report(v.intraday))


@query("ai_index_summary", f"""WITH d AS (SELECT instrument AS stock, sign(close - pc) = sign(high - pc) AS hit, abs(open - pc) / open * 100 AS o, abs(high - close) / close * 100 AS c FROM (SELECT *, {lag('close')} AS pc FROM v_bars) WHERE pc IS NOT NULL)
 SELECT coalesce(stock, 'all') AS stock, count(*) AS scored_days, round(avg(CAST(hit AS INT)) * 100, 2) AS direction_accuracy_pct, round(avg(o), 2) AS open_mape_pct, round(avg(c), 2) AS close_mape_pct FROM d GROUP BY ROLLUP (stock)""")
def ai_index_summary(v):
    pc = B.lagged("close")
    f = v.bars.select(F.col("instrument").alias("stock"), (F.signum(F.col("close") - pc) == F.signum(F.col("high") - pc)).alias("hit"),
                      (F.abs(F.col("open") - pc) / F.col("open") * 100).alias("open_ape_pct"), (F.abs(F.col("high") - F.col("close")) / F.col("close") * 100).alias("close_ape_pct"))
    return X.ai_index_summary(f.filter("open_ape_pct is not null"))


@query("reason_counts", "SELECT kind, CASE WHEN NOT is_prospective THEN 'late' WHEN status <> 'scored' THEN status WHEN starts_with(model, 'Candidate') THEN 'candidate' ELSE 'used' END AS reason, count(*) AS n FROM v_scored GROUP BY ALL")
def reason_counts(v):
    why = F.when(~F.col("is_prospective"), "late").when(F.col("status") != "scored", F.col("status")).when(F.col("model").startswith("Candidate"), "candidate").otherwise("used")
    return X.reason_counts(v.scored, "kind", why)


def log_pairs(v):
    exp12 = M.roll(F.sum, "value", 12)
    a = v.series.withColumn("e12", exp12).select("series_id", "month", F.ln("e12").alias("a"))
    b = v.series2.select("series_id", "month", F.ln("value").alias("y"))
    lagged = v.series.select("series_id", F.add_months("month", 1).alias("month"), F.ln("value").alias("b"))
    return b.join(a, ["series_id", "month"]).join(lagged, ["series_id", "month"])


_fit = lambda src, w="": f"""SELECT series_id, n, my - ca * ma - cb * mb AS const, ca AS coef_a, cb AS coef_b, (ca * ay + cb * byy) / yy AS r2 FROM (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM (
 SELECT series_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(y) AS yy FROM {src} {w} GROUP BY 1))"""


@query("simple_fair_value", f"""WITH lp AS (SELECT s2.series_id, s2.month, ln(s2.value) AS y, ln(e12) AS a, ln(pv) AS b FROM v_series2 s2 JOIN (SELECT series_id, month, {full('sum', 'value', 12, part=SW)} AS e12 FROM v_series) s USING (series_id, month)
   JOIN (SELECT series_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, value AS pv FROM v_series) p USING (series_id, month) WHERE e12 IS NOT NULL),
 x AS (SELECT *, row_number() OVER ({SW}) <= floor(count(*) OVER (PARTITION BY series_id) / 2) AS early FROM lp), f AS ({_fit('x')}), h AS ({_fit('x', 'WHERE early')}),
 o AS (SELECT x.series_id, 1 - sum(pow(y - (const + coef_a * a + coef_b * b), 2)) / (var_pop(y) * count(*)) AS oos_r2 FROM x JOIN h USING (series_id) WHERE NOT early GROUP BY 1), g AS (SELECT series_id, arg_max(exp(y - (0.5 + 0.8 * a + 0.1 * b)) - 1, month) AS last_gap FROM x GROUP BY 1)
 SELECT series_id, n, {rd('const coef_a coef_b r2 oos_r2 last_gap', 5)}, oos_r2 > 0 AS stable FROM f JOIN o USING (series_id) JOIN g USING (series_id)""")
def simple_fair_value(v):
    return rounded(X.fair_value(log_pairs(v), "series_id", "month", "y", "a", "b", (0.5, 0.8, 0.1)), 5)


def fx_pair(v):
    return v.series.join(v.series2.withColumnRenamed("value", "b"), ["series_id", "month"]).withColumnRenamed("value", "a")


@query("pair_regression", f"""WITH p AS (SELECT series_id, month, s.value AS a, t.value AS b FROM v_series s JOIN v_series2 t USING (series_id, month)),
 d AS (SELECT *, ln(a) - lag(ln(a)) OVER ({SW}) AS da, ln(b) - lag(ln(b)) OVER ({SW}) AS db, a / b AS x, a / lag(a, 12) OVER ({SW}) - 1 AS a12, b / lag(b, 12) OVER ({SW}) - 1 AS b12, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS back FROM p)
 SELECT series_id, count(da) AS n, {', '.join(f'round({e}, 5) AS {n}' for n, e in {
    'corr_all': 'corr(da, db)', 'corr_recent': 'corr(da, db) FILTER (back <= 36)', 'beta': 'covar_samp(da, db) / var_samp(db)', 'vol_ratio': 'stddev_samp(da) / stddev_samp(db)',
    'cross_z': '(arg_max(x, month) - avg(x) FILTER (back <= 60)) / stddev_samp(x) FILTER (back <= 60)', 'change_a': 'arg_max(a12, month)', 'change_b': 'arg_max(b12, month)'}.items())},
 round(regr_slope(a, b) FILTER (back <= 120) * arg_max(b, month) + regr_intercept(a, b) FILTER (back <= 120), 2) AS implied FROM d GROUP BY 1""")
def pair_regression(v):
    f = X.pair_regression(fx_pair(v), "series_id", "month", "a", "b")
    return f.select(*[F.round(c, 2 if c == "implied" else 5).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query("log_trend_growth", f"""WITH i AS (SELECT *, row_number() OVER ({SW}) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM v_series),
 g AS (SELECT series_id, min(month) AS first, count(*) AS n, regr_slope(ln(value + 1), i / 12.0::DOUBLE) AS slope, regr_intercept(ln(value + 1), i / 12.0::DOUBLE) AS icpt, avg(value) FILTER (i < 12) AS base, avg(value) FILTER (i >= n - 12) AS recent FROM i GROUP BY 1),
 t AS (SELECT series_id, avg(exp(icpt + slope * i / 12.0::DOUBLE) - 1) AS predicted FROM i JOIN g USING (series_id) WHERE i >= i.n - 12 GROUP BY 1)
 SELECT series_id, n, round(base, 2) AS base, round(recent, 2) AS recent, reason, round(CASE WHEN reason IS NULL THEN exp(slope) - 1 END, 6) AS growth, CASE WHEN reason IS NULL THEN predicted > 0 AND recent / predicted >= 2 END AS spike
 FROM (SELECT *, CASE WHEN first > DATE '1995-01-01' THEN 'starts_late' WHEN n < 30 THEN 'too_short' WHEN base < 7600000 THEN 'base_too_small' END AS reason FROM g JOIN t USING (series_id))""")
def log_trend_growth(v):
    f = X.log_trend_growth(v.series, "series_id", "month", "value", F.lit("1995-01-01").cast("date"), base_min=7600000.0)
    return f.select(*[F.round(c, 6 if c == "growth" else 2).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query("anchor_rescale", """WITH b AS (SELECT series_id, month, value / (1 + batch) AS value, batch FROM v_series CROSS JOIN (SELECT unnest([0, 1, 2]) AS batch) WHERE series_id = '1-URGENT' OR CAST(left(series_id, 1) AS INT) % 3 = batch),
 m AS (SELECT batch, avg(value) AS m FROM b WHERE series_id = '1-URGENT' GROUP BY 1) SELECT series_id, month, batch, round(value * CASE WHEN m > 1 THEN (SELECT m FROM m WHERE batch = 0) / m ELSE 1 END, 2) AS value FROM b LEFT JOIN m USING (batch)""")
def anchor_rescale(v):
    b = v.series.withColumn("batch", F.explode(F.array(*[F.lit(i) for i in range(3)]))).filter(
        (F.col("series_id") == "1-URGENT") | (F.left("series_id", F.lit(1)).cast("int") % 3 == F.col("batch")))
    b = b.withColumn("value", F.col("value") / (1 + F.col("batch")))
    return rounded(X.anchor_rescale(b, F.col("series_id") == "1-URGENT").select("series_id", "month", "batch", "value"), 2)


def _vr_sql(q: int) -> str:
    theta = " + ".join(f"{(2 * (q - j) / q) ** 2!r} * p{j}" for j in range(1, q))
    homo = (2 * (2 * q - 1) * (q - 1) / (3 * q)) ** 0.5
    return f"""SELECT series_id, {q} AS q, round(vr, 6) AS vr, round((vr - 1) / sqrt(({theta}) / (ee * ee)), 5) AS z, round((vr - 1) * sqrt(m) / {homo!r}, 5) AS z_homoskedastic FROM (SELECT *, (s{q} / (n{q} * {q} * (1 - {q}.0::DOUBLE / m))) / (ee / (m - 1)) AS vr FROM g)"""


_vr_qs = (2, 3, 6, 12)


@query("variance_ratio", f"""WITH d AS (SELECT series_id, month, ln(value) - lag(ln(value)) OVER ({SW}) AS d FROM v_series), k AS (SELECT d.*, mu, m, pow(d - mu, 2) AS e FROM d JOIN (SELECT series_id, avg(d) AS mu, count(d) AS m FROM d GROUP BY 1) USING (series_id) WHERE d IS NOT NULL),
 w AS (SELECT *, {', '.join(f"CASE WHEN count(d) OVER ({SW} ROWS {q - 1} PRECEDING) = {q} THEN pow(sum(d) OVER ({SW} ROWS {q - 1} PRECEDING) - {q} * mu, 2) END AS s{q}" for q in _vr_qs)}, {', '.join(f"e * lag(e, {j}) OVER ({SW}) AS p{j}" for j in range(1, 12))} FROM k),
 g AS (SELECT series_id, max(m) AS m, sum(e) AS ee, {', '.join(f"sum(s{q}) AS s{q}, count(s{q}) AS n{q}" for q in _vr_qs)}, {', '.join(f"sum(p{j}) AS p{j}" for j in range(1, 12))} FROM w GROUP BY 1) {' UNION ALL '.join(_vr_sql(q) for q in _vr_qs)}""")
def variance_ratio(v):
    f = X.variance_ratio(v.series.withColumn("lv", F.ln("value")), "series_id", "month", "lv", _vr_qs)
    return f.select("series_id", "q", F.round("vr", 6).alias("vr"), F.round("z", 5).alias("z"), F.round("z_homoskedastic", 5).alias("z_homoskedastic"))


@query("lead_lag", f"""WITH t AS (SELECT series_id, month, value AS a, value - lag(value) OVER ({SW}) AS da FROM v_series), c AS (SELECT series_id, CAST(month + to_months(k) AS DATE) AS month, k AS lag, b, db FROM (SELECT series_id, month, value AS b, value - lag(value) OVER ({SW}) AS db FROM v_series2) CROSS JOIN (SELECT CAST(unnest(range(-4, 5)) AS INT) AS k)),
 g AS (SELECT series_id, lag, count(*) AS n, corr(a, b) AS level, corr(da, db) AS change FROM t JOIN c USING (series_id, month) GROUP BY ALL HAVING count(*) >= 36)
 SELECT series_id, lag, n, round(level, 6) AS level, round(change, 6) AS change, lag = arg_max(lag, level) OVER (PARTITION BY series_id) AS best_level, lag = arg_max(lag, change) OVER (PARTITION BY series_id) AS best_change FROM g""")
def lead_lag(v):
    t, c = v.series.withColumnRenamed("value", "a"), v.series2.withColumnRenamed("value", "b")
    return rounded(X.lead_lag(t, c, "series_id", "month", range(-4, 5)))


_ic_feats = {"mom_12m": ("mom_12m", "fwd_6m"), "drawdown_36m": ("drawdown_36m", "fwd_6m"), "exports_cycle": ("exports_cycle", "fwd_6m")}


@query("spearman_ic", f"""WITH {_long}, l AS ({' UNION ALL '.join(f"SELECT series_id, '{k}' AS feature, {x} AS x, {y} AS y FROM lf" for k, (x, y) in _ic_feats.items())}), d AS (SELECT * FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
 r AS (SELECT series_id, feature, rank() OVER (PARTITION BY series_id, feature ORDER BY x) + (count(*) OVER (PARTITION BY series_id, feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY series_id, feature ORDER BY y) + (count(*) OVER (PARTITION BY series_id, feature, y) - 1) / 2.0::DOUBLE AS ry FROM d)
 SELECT series_id, feature, count(*) AS n, round(CASE WHEN count(*) >= 24 THEN corr(rx, ry) END, 6) AS ic FROM r GROUP BY ALL""")
def spearman_ic(v):
    return rounded(X.spearman(M.longterm_frame(v.series2, v.series), "series_id", _ic_feats))


@query("flash_scale", """WITH j AS (SELECT series_id, month, s.value / t.value AS r, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS k FROM v_series s JOIN v_series2 t USING (series_id, month)),
 m AS (SELECT series_id, count(*) AS overlap, quantile_cont(r, 0.5) FILTER (k <= 6) AS scale, quantile_cont(1 / r, 0.5) AS overall FROM j GROUP BY 1), p AS (SELECT series_id, max(abs(r / scale - 1)) AS spread FROM j JOIN m USING (series_id) WHERE k <= 6 GROUP BY 1)
 SELECT series_id, overlap, round(scale, 6) AS scale, round(spread, 6) AS spread, round(overall, 6) AS overall, overlap >= 6 AND spread <= 0.10 AS usable, overall BETWEEN 0.85 AND 1.15 AS same_size FROM m JOIN p USING (series_id)""")
def flash_scale(v):
    return rounded(X.flash_scale(v.series, v.series2, "series_id"))


@query("trailing_change", """WITH f AS (SELECT *, max(session) OVER (PARTITION BY instrument) AS now FROM v_thin) SELECT instrument, n, as_of, round(last, 6) AS last, round(last / b7 - 1, 6) AS change_7d, round(last / b30 - 1, 6) AS change_30d FROM (
 SELECT instrument, count(*) AS n, max(session) AS as_of, arg_max(close, session) AS last, arg_max(close, session) FILTER (session <= now - 7) AS b7, arg_max(close, session) FILTER (session <= now - 30) AS b30 FROM f GROUP BY 1)""")
def trailing_change(v):
    return rounded(X.trailing_change(v.thin, "instrument", "session", "close"))


def trade_record(v):
    """Trades opened on every session and closed a hashed number of sessions later."""
    f = B.with_vol20(v.bars).join(v.calendar.select("session", "ordinal"), "session")
    u = unit("concat(instrument, cast(session as string), 't')")
    held = F.floor(u * 5).cast("bigint") + 1
    ents = f.withColumn("u", u).withColumn("exit_ord", F.col("ordinal") + held)
    out = f.select("instrument", F.col("ordinal").alias("exit_ord"), F.col("close").alias("exit_close"))
    j = ents.join(out, ["instrument", "exit_ord"], "left")
    fills = j.select("instrument", F.col("ordinal").alias("entry"), F.when(F.col("exit_close").isNotNull(), F.col("exit_ord")).alias("exit"),
                     (F.col("exit_close") / F.col("close") - 1).alias("pnl"), (F.col("u") > 0.1).alias("filled"))
    return fills, f.select("instrument", "ordinal")


@query("run_summary", f"""WITH b AS (SELECT instrument, session, close, ordinal, {sql_unit("instrument||session||'t'")} AS u FROM v_bars JOIN v_cal USING (session)),
 f AS (SELECT e.instrument, e.ordinal AS entry, x.ordinal AS exit, x.close / e.close - 1 AS pnl, e.u > 0.1 AS filled FROM b e LEFT JOIN b x ON x.instrument = e.instrument AND x.ordinal = e.ordinal + CAST(floor(e.u * 5) AS BIGINT) + 1),
 d AS (SELECT instrument, count(*) AS sessions, max(ordinal) AS last FROM b GROUP BY 1)
 SELECT instrument, max(sessions) AS sessions, round(sum(coalesce(exit, last) - entry + 1) FILTER (filled) / max(sessions), 6) AS exposure, round(avg(exit - entry + 1) FILTER (filled AND exit IS NOT NULL), 6) AS mean_holding,
 round(avg(pnl) FILTER (filled AND exit IS NOT NULL), 6) AS mean_net, round(avg(CAST(NOT filled AS INT)), 6) AS unfilled_rate FROM f JOIN d USING (instrument) GROUP BY 1""")
def run_summary(v):
    return rounded(X.run_summary(*trade_record(v)))


