"""Normalising, checks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prob
from ..operators import bars as B
from ..operators import checks as C
from ..operators import ledger as L
from ..operators.calendar import session_spine
from .bindings import sql_unit, unit
from .registry import query
from .rounding import rounded
from .windows import lag

_text_monthly = """SELECT series_id, CASE month(month) % 5 WHEN 0 THEN strftime(month, '%Y%m') WHEN 1 THEN strftime(month, '%Y-%m') WHEN 2 THEN strftime(month, '%Y.%m')
 WHEN 3 THEN strftime(month, '%Y/%m') ELSE strftime(month, '%Y-%m-%d') END AS month_text, CASE WHEN month(month) = 7 THEN '-' WHEN month(month) = 8 THEN '-1' ELSE format('{:,.2f}', value) END AS value_text, month, value FROM v_series"""


def text_monthly(v):
    shapes = ["yyyyMM", "yyyy-MM", "yyyy.MM", "yyyy/MM", "yyyy-MM-dd"]
    txt = F.when(F.lit(False), "")
    for i, s in enumerate(shapes):
        txt = txt.when(F.month("month") % 5 == i, F.date_format("month", s))
    val = F.when(F.month("month") == 7, "-").when(F.month("month") == 8, "-1").otherwise(F.format_number("value", 2))
    rows = v.series.select("series_id", txt.alias("month_text"), val.alias("value_text"))
    return rows.unionByName(v.series.filter(F.month("month") == 3).select(
        "series_id", F.date_format("month", "yyyyMM").alias("month_text"), F.lit("1").alias("value_text")))


@query("normalize_monthly", f"""WITH r AS (SELECT series_id, month, CASE WHEN month(month) NOT IN (7, 8) THEN value END AS value FROM ({_text_monthly})
  UNION ALL SELECT series_id, month, 1.0 FROM v_series WHERE month(month) = 3)
 SELECT series_id, month, value, count(*) OVER (PARTITION BY series_id, month) AS copies FROM r""")
def normalize_monthly(v):
    return C.normalize_monthly(text_monthly(v))


@query("normalize_daily", """WITH d AS (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)
 SELECT series_id, date, value, count(*) OVER (PARTITION BY series_id, date) AS copies FROM (SELECT * FROM d WHERE day(date) <> 13 UNION ALL SELECT series_id, date, 5.0 FROM d WHERE day(date) = 5)""")
def normalize_daily(v):
    d = v.orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("d")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"))
    raw = d.select("series_id", F.date_format("d", "yyyy.MM.dd.").alias("date_text"),
                   F.when(F.day("d") == 13, "n/a").otherwise(F.format_number("value", 2)).alias("value_text"))
    twice = d.filter(F.day("d") == 5).select("series_id", F.date_format("d", "yyyyMMdd").alias("date_text"), F.lit("5").alias("value_text"))
    return C.normalize_daily(raw.unionByName(twice))


def shaken(v):
    """Bars with some contradictory highs, more of them in one half of the brands."""
    u = unit("concat(instrument, cast(session as string))")
    limit = F.when(F.substring("instrument", -1, 1).isin("1", "3", "5"), 0.03).otherwise(0.004)
    return v.thin.withColumn("high", F.when(u < limit, F.col("low") * 0.5).otherwise(F.col("high")))


_shaken = f"""shaken AS (SELECT * REPLACE (CASE WHEN {sql_unit('instrument||session')} < CASE WHEN right(instrument, 1) IN ('1','3','5') THEN 0.03 ELSE 0.004 END THEN low * 0.5 ELSE high END AS high) FROM v_thin)"""


@query("bar_sanity", f"""WITH {_shaken} SELECT instrument, count(*) AS n, count(*) FILTER (bad) AS n_bad, round(avg(CAST(bad AS INT)), 6) AS bad_share,
 CASE WHEN bool_or(invalid) THEN 'invalid_value' WHEN avg(CAST(bad AS INT)) > 0.01 THEN 'too_many_inconsistent' ELSE 'usable' END AS verdict
 FROM (SELECT *, high < greatest(low, open, close) OR low > least(open, close) AS bad, least(open, high, low, close) <= 0 OR volume < 0 AS invalid FROM shaken) GROUP BY 1""")
def bar_sanity(v):
    return rounded(C.bar_sanity(shaken(v)))


@query("corporate_action_flag", f"""SELECT instrument, session, coalesce((open / pc <= 0.7 AND close / pc <= 0.7) OR (open / pc >= 1 / 0.7 AND close / pc >= 1 / 0.7), false) AS action
 FROM (SELECT *, {lag('close')} AS pc FROM v_thin)""")
def corporate_action_flag(v):
    return C.corporate_action_flag(v.thin)


@query("boundary_anomalies", f"""SELECT instrument, round(max(r), 6) AS max_move, count(*) FILTER (r > 0.3) AS n_moves, round(max(j), 6) AS max_ratio_jump, count(*) FILTER (j > 0.05) AS n_ratio_jumps,
 count(*) FILTER (volume <= 0) AS n_zero_volume, count(*) FILTER (r > 0.3) > 0 OR count(*) FILTER (j > 0.05) > 0 AS flag
 FROM (SELECT *, abs(close / {lag('close')} - 1) AS r, abs(k / {lag('k')} - 1) AS j FROM (SELECT *, CASE WHEN session < DATE '1997-01-01' THEN 0.9 ELSE 1.0 END * close / close AS k FROM v_bars)) GROUP BY 1""")
def boundary_anomalies(v):
    adj = F.when(F.col("session") < F.lit("1997-01-01").cast("date"), 0.9).otherwise(1.0) * F.col("close")
    return rounded(C.boundary_anomalies(v.bars.withColumn("adj_close", adj)))


def raw_minutes(v):
    """Five-minute bars as observed: most at the end of the day, some too early, a few in two versions."""
    u = unit("concat(instrument, cast(ts as string))")
    base = v.intraday.withColumn("u", u).withColumn("day", F.col("session")).drop("session")
    seen = F.when(F.col("u") < 0.05, F.col("ts")).when(F.col("u") < 0.5, F.date_add("day", 1).cast("timestamp_ntz")).otherwise(
        F.date_add("day", 2).cast("timestamp_ntz"))
    base = base.withColumn("observed_at", seen).withColumn("split", F.when(F.col("u") > 0.99, 2.0).otherwise(0.0)).withColumn("dividend", F.lit(0.0))
    again = base.filter("u > 0.9").withColumn("close", F.least(F.col("high"), F.col("close") + 0.01))
    return base.unionByName(again)


_raw_minutes = f"""rm0 AS (SELECT *, {sql_unit("instrument||strftime(ts, '%Y-%m-%d %H:%M:%S')")} AS u FROM v_intraday),
 rm1 AS (SELECT * EXCLUDE (session), CASE WHEN u < 0.05 THEN ts WHEN u < 0.5 THEN CAST(session + 1 AS TIMESTAMP) ELSE CAST(session + 2 AS TIMESTAMP) END AS observed_at, CASE WHEN u > 0.99 THEN 2.0 ELSE 0.0 END AS split FROM rm0),
 rm AS (SELECT * FROM rm1 UNION ALL SELECT * REPLACE (least(high, close + 0.01) AS close) FROM rm1 WHERE u > 0.9)"""


@query("normalize_completed_bars", f"""WITH {_raw_minutes}, f AS (SELECT *, ts + INTERVAL 5 MINUTE AS bar_end, CAST(ts + INTERVAL 9 HOUR AS DATE) AS session FROM rm
  WHERE ts + INTERVAL 5 MINUTE <= observed_at AND strftime(ts + INTERVAL 9 HOUR, '%H:%M') >= '09:00' AND strftime(ts + INTERVAL 545 MINUTE, '%H:%M') <= '15:30'
  AND least(open, high, low, close) > 0 AND NOT (high < greatest(low, open, close) OR low > least(open, close)))
 SELECT instrument, ts, observed_at, bar_end, session, min(open) AS open, min(high) AS high, min(low) AS low, min(close) AS close, min(volume) AS volume, min(split) NOT IN (0, 1) AS needs_adjustment,
 CASE WHEN session < CAST(observed_at + INTERVAL 9 HOUR AS DATE) THEN 'backfill' ELSE 'live' END AS provenance, count(DISTINCT close) > 1 AS conflict FROM f GROUP BY ALL""")
def normalize_completed_bars(v):
    return C.normalize_completed(raw_minutes(v))


@query("drop_unclosed", "SELECT instrument, session, close FROM v_bars WHERE dayofweek(session) NOT IN (0, 6) AND session < (SELECT max(session) - 3 FROM v_cal)")
def drop_unclosed(v):
    top = v.calendar.agg(F.max("session").alias("s")).select(
        (F.date_sub("s", 3).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(20))).alias("now")).scalar()
    return C.drop_unclosed(v.bars, top).select("instrument", "session", "close")


@query("eligible_universe", """SELECT p_brand AS instrument, first_session, CASE WHEN first_session IS NULL THEN 'no_bars' WHEN first_session > DATE '1995-01-03' THEN 'listed_late' ELSE 'kept' END AS reason
 FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT instrument, min(session) AS first_session FROM v_thin GROUP BY 1) ON p_brand = instrument""")
def eligible_universe(v):
    return C.eligible_universe(v.part.select(F.col("p_brand").alias("instrument")).distinct(), v.thin, "1995-01-03")


_grid = "grid AS (SELECT instrument, session FROM (SELECT instrument, min(session) a, max(session) b FROM v_thin GROUP BY 1) JOIN v_cal ON session BETWEEN a AND b)"


@query("interpolation_check", f"WITH {_grid} SELECT instrument, count(*) AS invented FROM grid ANTI JOIN v_thin USING (instrument, session) GROUP BY 1")
def interpolation_check(v):
    return C.interpolation_check(session_spine(v.thin, v.calendar), v.thin)


@query("leaky_row_filter", f"""SELECT instrument, CAST(sum(CAST(l < session AS INT)) AS BIGINT) AS dropped, CAST(sum(CAST(l >= session AS INT)) AS BIGINT) AS kept FROM (
 SELECT instrument, session, session + CAST(floor({sql_unit('instrument||session')} * 10) AS INT) - 2 AS l FROM v_bars) GROUP BY 1""")
def leaky_row_filter(v):
    lab = F.date_add("session", F.floor(unit("concat(instrument, cast(session as string))") * 10).cast("int") - 2)
    return C.leaky_rows(v.bars.select("instrument", F.col("session").alias("feature_date"), lab.alias("label_date")))


def prediction_docs(v):
    u = unit("concat(instrument, cast(session as string), 'doc')")
    return B.returns_and_legs(v.bars).join(v.bars, ["instrument", "session"]).withColumn("u", u).select(
        "instrument", F.col("session").alias("target_date"),
        (F.col("session").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.col("u") * 11).cast("int"))).alias("created_local"),
        F.when(F.col("u") < 0.9, F.col("close")).alias("previous_close"), F.col("open").alias("predicted_open"), F.col("high").alias("predicted_close"),
        F.when(F.col("ret") > 0, "up").when(F.col("ret") < 0, "down").when(F.col("ret") == 0, "flat").otherwise("none").alias("direction"),
        F.when(F.col("u") < 0.1, F.array().cast("array<struct<title:string,url:string>>")).otherwise(F.array(F.struct(
            F.lit("note").alias("title"), F.when(F.col("u") < 0.3, "http://example.org").otherwise("https://example.org").alias("url")))).alias("sources"))


@query("validate_prediction", f"""SELECT instrument, target_date, concat_ws(',', CASE WHEN NOT CAST(floor(u * 11) AS INT) < 9 THEN 'created_late' END, CASE WHEN NOT u < 0.9 THEN 'price' END,
 CASE WHEN ret IS NULL THEN 'direction' END, CASE WHEN u < 0.1 THEN 'no_sources' WHEN u < 0.3 THEN 'source' END) AS problems
 FROM (SELECT instrument, session AS target_date, ret, {sql_unit("instrument||session||'doc'")} AS u FROM v_vol)""")
def validate_prediction(v):
    return C.validate_prediction(prediction_docs(v)).select("instrument", "target_date", "problems")


@query("issue_gate", f"""WITH d AS (SELECT record_id, model, p_down, p_flat, p_up, greatest(p_down, p_flat, p_up) AS top, CAST(abs(p_down - greatest(p_down, p_flat, p_up)) < 1e-9 AS INT) + CAST(abs(p_flat - greatest(p_down, p_flat, p_up)) < 1e-9 AS INT) + CAST(abs(p_up - greatest(p_down, p_flat, p_up)) < 1e-9 AS INT) AS ties FROM v_ledger WHERE kind = 'direction'),
 e AS (SELECT *, abs(p_down + p_flat + p_up - 1) < 0.01 AND ties = 1 AND p_down BETWEEN 0 AND 1 AND p_flat BETWEEN 0 AND 1 AND p_up BETWEEN 0 AND 1 AS valid FROM d)
 SELECT record_id, valid, valid AND top >= 0.5 AS issued, CASE WHEN valid AND top >= 0.5 THEN CASE WHEN p_down = top THEN 'down' WHEN p_flat = top THEN 'flat' ELSE 'up' END WHEN valid THEN 'hold' ELSE 'undecided' END AS call, round(CASE WHEN valid THEN top END, 6) AS max_prob FROM e""")
def issue_gate(v):
    return rounded(v.ledger.filter("kind = 'direction'").select("record_id", *prob.issue_gate(threshold=0.5)))


@query("headline_filter", "SELECT kind, signal, count(*) AS n, count(*) FILTER (signal IN ('yes', 'unverified')) AS published FROM v_ledger WHERE NOT starts_with(model, 'Candidate') AND NOT starts_with(model, 'Post-open') GROUP BY ALL")
def headline_filter(v):
    pub = F.sum(F.when(F.col("signal").isin("yes", "unverified"), 1).otherwise(0))
    return v.ledger.filter(L.headline()).groupBy("kind", "signal").agg(F.count(F.lit(1)).alias("n"), pub.alias("published"))


@query("staleness_report", """SELECT series_id, last_month, age_days, CASE WHEN age_days >= 100 THEN 'expired' WHEN age_days >= 45 THEN 'warn' ELSE 'fresh' END AS level FROM (
 SELECT series_id, max(month) AS last_month, greatest(date_diff('day', CAST(max(month) + INTERVAL 2 MONTH AS DATE), (SELECT max(session) FROM v_cal)), 0) AS age_days FROM v_series GROUP BY 1)""")
def staleness_report(v):
    return C.staleness(v.series, v.calendar.agg(F.max("session")).scalar())


@query("session_done_gate", "SELECT target_date, kind, count(*) AS n, count(*) FILTER (status = 'scored') AS n_scored, count(*) FILTER (status = 'scored') > 0 AS done FROM v_scored GROUP BY 1, 2")
def session_done_gate(v):
    return C.scored_sessions(v.scored)


def vendors(v):
    """The thin bars as two vendors report them: gaps, copies, splits, zero volumes and changed prices by hash."""
    u = v.thin.withColumn("u", unit("concat(instrument, cast(session as string), 'v')"))
    a = u.filter("u > 0.02").unionByName(u.filter("u > 0.98"))
    b = u.filter("u < 0.97 or u > 0.99").withColumn("volume", F.when(F.col("u").between(0.1, 0.12), 0.0).otherwise(F.col("volume")))
    b = b.withColumn("close", F.when(F.col("u").between(0.2, 0.23), F.col("close") + 0.01).otherwise(F.col("close")))
    b = b.withColumn("high", F.greatest("high", "close")).withColumn("split", F.when(F.col("u").between(0.3, 0.31), 2.0).when(F.col("u") < 0.9, 0.0))
    return a, b.withColumn("dividend", F.lit(0.0))


@query("cross_source_verify", f"""WITH u AS (SELECT *, {sql_unit("instrument||session||'v'")} AS u FROM v_thin),
 a AS (SELECT instrument, session, CASE WHEN u > 0.98 THEN 2 ELSE 1 END AS an, volume AS av, high AS ah, close AS ac, low AS al, open AS ao FROM u WHERE u > 0.02),
 b AS (SELECT instrument, session, open AS bo, low AS bl, greatest(high, c) AS bh, c AS bc, CASE WHEN u BETWEEN 0.1 AND 0.12 THEN 0.0 ELSE volume END AS bv, CASE WHEN u BETWEEN 0.3 AND 0.31 THEN 2.0 WHEN u < 0.9 THEN 0.0 END AS split FROM (SELECT *, CASE WHEN u BETWEEN 0.2 AND 0.23 THEN close + 0.01 ELSE close END AS c FROM u) WHERE u < 0.97 OR u > 0.99)
 SELECT instrument, session, CASE WHEN an > 1 THEN 'duplicate_session' WHEN an IS NULL OR bo IS NULL THEN 'missing_cross_source' WHEN split IS NULL THEN 'invalid_or_incomplete_bar' WHEN av <= 0 OR bv <= 0 THEN 'untradeable_session'
 WHEN split NOT IN (0, 1) THEN 'corporate_action_unresolved' WHEN ao <> bo OR ah <> bh OR al <> bl OR ac <> bc THEN 'ohlc_mismatch' ELSE 'accepted' END AS reason FROM a FULL JOIN b USING (instrument, session)""")
def cross_source_verify(v):
    return C.cross_source_verify(*vendors(v))


def statements(v):
    """Quarter statements per nation drawn from its orders."""
    o = v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("instrument"),
                  F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("q")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"), F.count(F.lit(1)).alias("n"))
    q = q.withColumn("period", F.date_sub(F.add_months("q", 3), 1))
    return q.select("instrument", "period", (F.col("s") / 10).alias("net_income"), (F.col("s") / 10 / (1000 + F.col("n"))).alias("eps"), (F.col("s") * 2).alias("equity"))


_statements = """st AS (SELECT instrument, CAST(q + INTERVAL 3 MONTH AS DATE) - 1 AS period, s / 10 AS net_income, s / 10 / (1000 + n) AS eps, s * 2 AS equity FROM (
  SELECT 'N' || c_nationkey AS instrument, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, round(sum(o_totalprice), 2) AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)),
 ba AS (SELECT instrument, max(period) AS period, quantile_cont(net_income / eps, 0.5) AS shares, sum(net_income) FILTER (rn <= 4) AS ttm, arg_max(equity, period) AS equity, count(net_income) FILTER (rn <= 4) AS n4 FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY period DESC) AS rn FROM st) GROUP BY 1),
 qt AS (SELECT instrument, max(period) - 5 AS price_date, max(period) + 2 AS observed_on, arg_max(eps, period) * 12 AS price FROM st GROUP BY 1)"""


@query("valuation_multiples", f"""WITH {_statements}, x AS (SELECT instrument, price, metric, CASE WHEN metric = 'per' THEN ttm / shares ELSE equity / shares END AS basis, multiple FROM ba JOIN qt USING (instrument)
  CROSS JOIN (SELECT 'per' AS metric, unnest([10.0, 15.0, 20.0]) AS multiple UNION ALL SELECT 'pbr', unnest([1.0, 1.5, 2.0])) WHERE n4 = 4)
 SELECT instrument, metric, CAST(multiple AS DOUBLE) AS multiple, round(price / basis, 6) AS current, round(basis * multiple, 6) AS fair, round(basis * multiple / price - 1, 6) AS upside FROM x WHERE basis > 0""")
def valuation_multiples(v):
    st = statements(v)
    quotes = st.groupBy("instrument").agg(F.date_sub(F.max("period"), 5).alias("price_date"), F.date_add(F.max("period"), 2).alias("observed_on"),
                                          (F.max_by("eps", "period") * 12).alias("price"))
    return rounded(C.valuation_multiples(C.statement_basis(st), quotes))


@query("column_groups")
def column_groups(v):
    f = B.instrument_features(v.bars)
    return f.select("instrument", "session", *C.columns_like(f, keep=("ret_", "mom_", "vol_"), drop=("vol_ratio",)))


_holes = f"""holes AS (SELECT instrument, session, {lag('close', 1)} / {lag('close', 6)} - 1 AS a, vol20 AS b, ret AS c, CASE WHEN {sql_unit("instrument||session||'h'")} > 0.1 THEN volume END AS d FROM v_vol)"""


def holes(v):
    f = B.with_vol20(v.bars)
    return f.select("instrument", "session", (B.ratio(B.lagged("close", 1), B.lagged("close", 6)) - 1).alias("a"), F.col("vol20").alias("b"), F.col("ret").alias("c"),
                    F.when(unit("concat(instrument, cast(session as string), 'h')") > 0.1, F.col("volume")).alias("d"))


@query("availability_fill", f"""WITH {_holes}, k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS ok FROM holes)
 SELECT instrument, session, {', '.join(f'round(CASE WHEN ok THEN coalesce({x}, 0.0) ELSE 0.0 END, 6) AS {x}' for x in 'abcd')}, CAST(ok AS INT) AS available, CAST(ok AND d IS NULL AS INT) AS filled FROM k""")
def availability_fill(v):
    return rounded(C.availability_fill(holes(v), ["a", "b", "c"], ["d"]))


@query("complete_rows", f"""WITH {_holes} SELECT instrument, count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS market, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL) AS everything FROM holes GROUP BY 1""")
def complete_rows(v):
    return C.complete_rows(holes(v), {"market": ["a", "b"], "everything": ["a", "b", "c", "d"]})


@query("exposure_limit_check", f"""WITH p AS (SELECT o_custkey AS account, o_orderpriority AS symbol, CASE WHEN count(*) % 2 = 0 THEN 0.0 ELSE CAST(count(*) AS DOUBLE) END AS quantity,
   CASE WHEN {sql_unit("o_custkey||o_orderpriority")} > 0.03 THEN 100.0 + length(o_orderpriority) END AS price, count(*) * 10.0 AS reserved FROM orders GROUP BY ALL),
 t AS (SELECT account, sum(coalesce(quantity * price, 0)) AS exposure, sum(reserved) AS res, max(CAST(price IS NULL AND quantity > 0 AS INT)) AS blind FROM p GROUP BY 1),
 j AS (SELECT p.*, c_acctbal AS cash, exposure, res, blind, coalesce(quantity * price, 0) AS value, concat_ws(',', CASE WHEN price IS NULL THEN 'missing_quote' END, CASE WHEN quantity > 0 THEN 'already_holding' END, CASE WHEN blind = 1 THEN 'exit_deferred' END) AS rs
   FROM p JOIN t USING (account) JOIN customer ON c_custkey = account),
 k AS (SELECT *, CASE WHEN rs = '' THEN greatest(0.0, least(cash - res, (cash + exposure) * 0.2 - value - reserved, (cash + exposure) * 0.5 - exposure - res)) ELSE 0.0 END AS budget FROM j)
 SELECT account, symbol, round(budget, 6) AS budget, CAST(CASE WHEN rs = '' THEN floor(budget / (price * 1.003)) ELSE 0 END AS BIGINT) AS units, CASE WHEN rs = '' AND floor(budget / (price * 1.003)) = 0 THEN 'cash_or_exposure_limit' ELSE rs END AS reasons FROM k""")
def exposure_limit_check(v):
    n = F.count(F.lit(1))
    p = v.orders.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol")).agg(n.alias("n"))
    u = unit("concat(cast(account as string), symbol)")
    p = p.select("account", "symbol", F.when(F.col("n") % 2 == 0, 0.0).otherwise(F.col("n").cast("double")).alias("quantity"),
                 F.when(u > 0.03, 100.0 + F.length("symbol")).alias("price"), (F.col("n") * 10.0).alias("reserved"))
    return rounded(C.exposure_limit_check(p, v.customer.select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("cash"))))


