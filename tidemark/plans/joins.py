"""As-of, bitemporal, range and set-style joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import bars as B
from ..operators import calendar as K
from ..operators import events as E
from ..operators import joins as J
from ..operators import macro as M
from ..operators import traffic as T
from ..operators.frames import median, rows
from .bindings import sql_unit, unit
from .registry import query
from .rounding import rd, rounded
from .windows import _asof_thin, _monthly

_grid = "grid AS (SELECT instrument, session FROM (SELECT instrument, min(session) a, max(session) b FROM v_thin GROUP BY 1) JOIN v_cal ON session BETWEEN a AND b)"


@query("asof_backward", f"""WITH {_asof_thin}, st AS (SELECT g.instrument, g.session, CASE WHEN date_diff('day', o.d, g.session) <= 6 THEN close END AS strict_value
   FROM grid g ASOF LEFT JOIN (SELECT instrument, session AS d, close FROM v_thin) o ON g.instrument = o.instrument AND g.session > o.d)
 SELECT instrument, session, {rd('value strict_value')}, source_date FROM lvl JOIN st USING (instrument, session)""")
def asof_backward(v):
    grid = K.session_spine(v.thin, v.calendar).drop("ordinal")
    loose = A.asof_backward(grid, v.thin, "session", "session", "instrument", "close").withColumnRenamed("close", "value")
    strict = A.asof_join(loose, v.thin.withColumnRenamed("session", "d"), "session", "d", "instrument", ["close"], strict=True, tolerance_days=6)
    return rounded(strict.withColumnRenamed("close", "strict_value"))


def decision_days(v):
    """Month middles for every monthly series."""
    span = v.series.groupBy("series_id").agg(F.min("month").alias("a"), F.add_months(F.max("month"), 8).alias("b"))
    return span.select("series_id", F.explode(F.expr("transform(sequence(a, b, interval 1 month), x -> date_add(x, 14))")).alias("decision"))


_decisions = "dd AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP) + INTERVAL 8 MONTH, INTERVAL 1 MONTH)) + INTERVAL 14 DAY AS DATE) AS decision FROM v_series GROUP BY series_id)"


def _expiry(months: int, days: int, age: int, name: str) -> str:
    return f"""{name} AS (SELECT dd.*, CASE WHEN decision <= expires THEN yoy END AS yoy_{name}, CASE WHEN decision <= expires THEN diff_3 END AS diff_3_{name} FROM dd ASOF LEFT JOIN
  (SELECT *, CAST(month + INTERVAL {months} MONTH AS DATE) + {days} AS available, CAST(month + INTERVAL {months} MONTH AS DATE) + {days + age} AS expires FROM mf) f ON dd.series_id = f.series_id AND dd.decision >= f.available)"""


@query("asof_with_expiry", f"""WITH {_monthly}, {_decisions}, {_expiry(2, 0, 100, 'a')}, {_expiry(1, 19, 75, 'b')}, {_expiry(0, 14, 21, 'c')}
 SELECT series_id, decision, {rd('yoy_a yoy_b yoy_c')}, {rd('diff_3_a diff_3_b diff_3_c', 2)} FROM a JOIN b USING (series_id, decision) JOIN c USING (series_id, decision)""")
def asof_with_expiry(v):
    f = M.monthly_features(v.series).select("series_id", "month", "yoy", "diff_3")
    out = decision_days(v)
    for tag, (m, d, age) in {"a": (2, 0, 100), "b": (1, 19, 75), "c": (0, 14, 21)}.items():
        out = M.macro_at(out, "decision", f.withColumnsRenamed({"yoy": f"yoy_{tag}", "diff_3": f"diff_3_{tag}"}), [f"yoy_{tag}", f"diff_3_{tag}"], m, d, age)
    return out.select("series_id", "decision", *[F.round(f"yoy_{t}", 6).alias(f"yoy_{t}") for t in "abc"],
                      *[F.round(f"diff_3_{t}", 2).alias(f"diff_3_{t}") for t in "abc"])


@query("asof_vintage", """WITH dec AS (SELECT DISTINCT CAST(date_trunc('quarter', observed_at) AS DATE) + 30 AS decision FROM v_versions),
 sp AS (SELECT *, lead(observed_at) OVER (PARTITION BY key, period ORDER BY observed_at) AS valid_to FROM v_versions),
 k AS (SELECT decision, key, period, value, observed_at FROM dec JOIN sp ON observed_at <= decision AND (valid_to IS NULL OR decision < valid_to))
 SELECT decision, key, arg_max(period, period) AS period, arg_max(value, period) AS value, arg_max(observed_at, period) AS observed_at, count(*) AS known_periods FROM k GROUP BY 1, 2""")
def asof_vintage(v):
    dec = v.versions.select(F.date_add(F.trunc("observed_at", "quarter"), 30).alias("decision")).distinct()
    known = A.known_state(v.versions, dec, "key", "period", "observed_at", "decision", "value")
    return known.select("decision", "key", "newest.*", F.col("known").alias("known_periods"))


@query("next_calendar_date", f"""WITH sh AS (SELECT session, ret AS shared_ret FROM v_vol WHERE instrument = 'A')
 SELECT instrument, t.session, next_session, round(shared_ret, 6) AS shared_ret FROM (SELECT t.instrument, t.session, (SELECT min(session) FROM v_cal c WHERE c.session > t.session) AS next_session FROM v_thin t) t
 LEFT JOIN sh ON sh.session = next_session""")
def next_calendar_date(v):
    shared = B.returns_and_legs(v.bars.filter("instrument = 'A'")).select("session", F.col("ret").alias("shared_ret"))
    return rounded(E.attach_shared(v.thin.select("instrument", "session"), "session", v.calendar, shared).select("instrument", "session", "next_session", "shared_ret"))


@query("session_reindex", f"WITH {_grid} SELECT instrument, session, close, volume FROM grid LEFT JOIN v_thin USING (instrument, session)")
def session_reindex(v):
    return K.session_reindex(v.thin, v.calendar).select("instrument", "session", "close", "volume")


def filing_periods(v):
    """Filing periods: every order opens a period of 20 to 60 days."""
    return v.orders.select(
        F.col("o_orderkey").alias("filing"), F.col("o_orderdate").cast("date").alias("start"),
        F.date_add(F.col("o_orderdate").cast("date"), 20 + (F.col("o_orderkey") % 41).cast("int")).alias("end"), F.col("o_totalprice").alias("amount"))


_periods = "per AS (SELECT o_orderkey AS filing, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 20 + CAST(o_orderkey % 41 AS INT) AS stop, o_totalprice AS amount FROM orders)"


@query("interval_join_periods", f"WITH {_periods} SELECT session, count(*) AS n, round(sum(amount), 2) AS amount, min(filing) AS first_filing FROM v_cal JOIN per ON session BETWEEN start AND stop GROUP BY 1")
def interval_join_periods(v):
    return E.open_periods(v.calendar.select("session"), filing_periods(v)).withColumn("amount", F.round("amount", 2))


@query("period_transition", f"""WITH {_periods}, f AS (SELECT *, sum(foreign_net) OVER (PARTITION BY instrument ORDER BY ordinal ROWS 4 PRECEDING) AS s5, min(ordinal) OVER (PARTITION BY instrument ORDER BY ordinal ROWS 4 PRECEDING) AS o5,
  sum(foreign_net) OVER (PARTITION BY instrument ORDER BY ordinal ROWS 19 PRECEDING) AS s20, min(ordinal) OVER (PARTITION BY instrument ORDER BY ordinal ROWS 19 PRECEDING) AS o20,
  sum(foreign_net) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS t5, max(ordinal) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS p5,
  sum(foreign_net) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS t20, max(ordinal) OVER (PARTITION BY instrument ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS p20
  FROM v_flows JOIN v_cal USING (session))
 SELECT filing, instrument, CASE WHEN ordinal - o5 = 4 THEN s5 END AS b5, CASE WHEN p5 - ordinal = 5 THEN t5 END AS a5, CASE WHEN ordinal - o20 = 19 THEN s20 END AS b20, CASE WHEN p20 - ordinal = 20 THEN t20 END AS a20
 FROM (SELECT filing, (SELECT max(c.ordinal) FROM v_cal c WHERE c.session <= stop) AS e FROM per) x JOIN f ON f.ordinal = x.e""")
def period_transition(v):
    return E.period_transition(v.flows, filing_periods(v), v.calendar).select("filing", "instrument", "b5", "a5", "b20", "a20")


@query("event_window_join", """WITH b AS (SELECT session, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM v_cal JOIN v_evdays ON date BETWEEN session - 4 AND session - 1 GROUP BY 1),
 a AS (SELECT session, count(*) AS n_ahead, min(date) AS next_event FROM v_cal JOIN v_evdays ON date BETWEEN session AND session + 10 GROUP BY 1)
 SELECT session, coalesce(labels, '') AS labels, coalesce(n_ahead, 0) AS n_ahead, next_event, session - CAST(date_trunc('quarter', session) AS DATE) < 14 AS earnings_season FROM v_cal LEFT JOIN b USING (session) LEFT JOIN a USING (session)""")
def event_window_join(v):
    days = v.calendar.select("session")
    ahead = E.events_ahead(days, v.event_days).groupBy("session").agg(F.count(F.lit(1)).alias("n_ahead"), F.min("event_date").alias("next_event"))
    f = E.events_before(days, v.event_days).join(ahead, "session", "left")
    season = F.datediff("session", F.trunc("session", "quarter")) < 14
    return f.select("session", "labels", F.coalesce("n_ahead", F.lit(0)).alias("n_ahead"), "next_event", season.alias("earnings_season"))


RELEVANT, NOISE = ["on", "the", "ch"], ["sale", "%%%"]


def session_events(v):
    return v.hits.select("event_id", "ts")


@query("news_in_window", f"""WITH s AS (SELECT doc_id, time, CASE WHEN contains(title, 'The') THEN 3 ELSE 0 END {' '.join(f"+ CASE WHEN contains(lower(title), '{w}') THEN 2 ELSE 0 END" for w in RELEVANT)}
  {' '.join(f"- CASE WHEN contains(title, '{w}') THEN 2 ELSE 0 END" for w in NOISE)} AS score FROM v_heads)
 SELECT event_id, rank, doc_id, time, score FROM (SELECT event_id, doc_id, time, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, time, doc_id) AS rank
 FROM v_hits JOIN s ON time BETWEEN ts - INTERVAL 90 MINUTE AND ts + INTERVAL 15 MINUTE) WHERE rank <= 5""")
def news_in_window(v):
    return E.news_in_window(session_events(v), v.headlines, "The", RELEVANT, NOISE)


@query("common_date_intersection", """WITH p AS (SELECT instrument, target_date, model, avg(direction_correct) AS hit FROM v_daily WHERE kind = 'direction' AND status = 'scored' GROUP BY ALL),
 c AS (SELECT instrument, target_date FROM p GROUP BY ALL HAVING count(DISTINCT model) = 4)
 SELECT instrument, model, n_own, n_common, round(hit, 6) AS hit FROM (SELECT instrument, model, count(*) AS n_own FROM p GROUP BY ALL) JOIN
 (SELECT instrument, model, count(*) AS n_common, avg(hit) AS hit FROM p SEMI JOIN c USING (instrument, target_date) GROUP BY ALL) USING (instrument, model)""")
def common_date_intersection(v):
    p = v.daily.filter("kind = 'direction' and status = 'scored'").groupBy("instrument", "target_date", "model").agg(F.avg("direction_correct").alias("hit"))
    own = p.groupBy("instrument", "model").agg(F.count(F.lit(1)).alias("n_own"))
    common = J.keep_common(p, ["instrument", "target_date"], "model", 4)
    return rounded(own.join(common.groupBy("instrument", "model").agg(F.count(F.lit(1)).alias("n_common"), F.avg("hit").alias("hit")), ["instrument", "model"]))


def scale_of(v):
    """Median ratio of the two sources over their last six common months."""
    j = v.series.join(v.series2.withColumnRenamed("value", "b"), ["series_id", "month"])
    j = j.withColumn("rn", F.row_number().over(rows("series_id", "month", None, 0)))
    top = j.groupBy("series_id").agg(F.max("rn").alias("top"))
    return j.join(top, "series_id").filter("rn > top - 6").groupBy("series_id").agg(median(F.col("value") / F.col("b")).alias("scale"))


_scale = """sc AS (SELECT series_id, quantile_cont(r, 0.5) AS scale FROM (SELECT series_id, a.value / b.value AS r, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS rn FROM v_series a JOIN v_series2 b USING (series_id, month)) WHERE rn <= 6 GROUP BY 1)"""


@query("merge_prefer_left", f"""WITH {_scale}, a AS (SELECT * FROM v_series WHERE month(month) NOT IN (3, 4))
 SELECT series_id, month, round(coalesce(a.value, b.value * scale), 2) AS value, CASE WHEN a.value IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN v_series2 b USING (series_id, month) JOIN sc USING (series_id)""")
def merge_prefer_left(v):
    second = v.series2.join(scale_of(v), "series_id").withColumn("value", F.col("value") * F.col("scale"))
    return rounded(J.prefer_left(v.series.filter(~F.month("month").isin(3, 4)), second, ["series_id", "month"], "value"), 2)


@query("combine_first_refresh", f"""WITH fresh AS (SELECT series_id, month, CASE WHEN month(month) <> 5 THEN value END AS rate, value * 2 AS goal FROM v_series WHERE month >= DATE '1997-01-01'),
 old AS (SELECT series_id, month, value AS rate, value / 2 AS base FROM v_series2),
 m AS (SELECT series_id, month, coalesce(fresh.rate, old.rate) AS rate, goal, base FROM fresh FULL JOIN old USING (series_id, month))
 SELECT series_id, month, {rd('rate goal base gap', 3)} FROM (SELECT *, rate - base AS gap FROM m)""")
def combine_first_refresh(v):
    fresh = v.series.filter("month >= date'1997-01-01'").select(
        "series_id", "month", F.when(F.month("month") != 5, F.col("value")).alias("rate"), (F.col("value") * 2).alias("goal"))
    old = v.series2.select("series_id", "month", F.col("value").alias("rate"), (F.col("value") / 2).alias("base"))
    m = J.combine_first(fresh, old, ["series_id", "month"], ["rate", "goal", "base"])
    return rounded(m.withColumn("gap", F.col("rate") - F.col("base")), 3)


FEATURES = ["mom", "vol", "gap", "flow"]


def contributions(v):
    d = v.ledger.filter("kind = 'direction'").withColumn("feature", F.explode(F.array(*[F.lit(f) for f in FEATURES])))
    return d.select("run_id", "model", "instrument", "prediction_date", "feature", (unit("concat(record_id, feature)") - 0.5).alias("contribution"))


@query("ledger_attribution_join", f"""WITH c AS (SELECT run_id, model, instrument, prediction_date, feature, abs({sql_unit('record_id||feature')} - 0.5) AS c FROM v_ledger CROSS JOIN (SELECT unnest({FEATURES!r}) AS feature) WHERE kind = 'direction'),
 w AS (SELECT *, c / sum(c) OVER (PARTITION BY run_id, model, instrument, prediction_date) AS share, c = max(c) OVER (PARTITION BY run_id, model, instrument, prediction_date) AS top FROM c),
 r AS (SELECT run_id, model, instrument, prediction_date FROM v_daily WHERE kind = 'direction' AND status = 'scored' AND direction_correct = 1)
 SELECT model, feature, count(*) AS n, count(*) FILTER (top) AS n_top, round(avg(share), 6) AS mean_share FROM w SEMI JOIN r USING (run_id, model, instrument, prediction_date) GROUP BY ALL""")
def ledger_attribution_join(v):
    return rounded(E.attribution_summary(contributions(v), v.daily.filter("kind = 'direction'")))


def mailing(v):
    """Editions, subscribers and deliveries drawn from customers and orders."""
    editions = v.orders.select(F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("d")).distinct().select(
        F.concat(F.lit("e-"), F.col("d").cast("string")).alias("edition"), F.date_add("d", 40).cast("timestamp_ntz").alias("created_at"), "d")
    first = v.orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp_ntz").alias("since"))
    subs = first.select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("email"),
                        F.when(F.col("o_custkey") % 3 == 0, "main").when(F.col("o_custkey") % 3 == 1, "left").otherwise("right").alias("page"), "since")
    sent = v.orders.withColumn("d", F.trunc(F.col("o_orderdate").cast("date"), "quarter")).groupBy("d", "o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderdate").cast("timestamp_ntz").alias("at"))
    code = F.element_at(F.array(*[F.lit(s) for s in ("sent", "failed", "sending", "pending")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    deliveries = sent.select(F.concat(F.lit("e-"), F.col("d").cast("string")).alias("edition"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("email"),
                             code.alias("status"), (F.col("n") - 1).alias("attempts"), F.when(code == "sent", F.col("at")).alias("sent_at"))
    stopped = editions.filter(F.month("d") == 7).select("edition")
    sections = editions.select("edition", F.explode(F.when(F.month("d") == 4, F.array(F.lit("main"), F.lit("left"))).otherwise(
        F.array(F.lit("main"), F.lit("left"), F.lit("right")))).alias("page"))
    return editions.drop("d"), subs, deliveries, stopped, sections


_mail = """ed AS (SELECT 'e-' || d AS edition, CAST(d + 40 AS TIMESTAMP) AS created_at, d FROM (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS d FROM orders)),
 su AS (SELECT 'u' || o_custkey AS email, ['main', 'left', 'right'][o_custkey % 3 + 1] AS page, min(o_orderdate) AS since FROM orders GROUP BY o_custkey),
 de AS (SELECT 'e-' || d AS edition, 'u' || o_custkey AS email, ['sent', 'failed', 'sending', 'pending'][o_custkey % 4 + 1] AS status, n - 1 AS attempts, CASE WHEN o_custkey % 4 = 0 THEN t END AS sent_at
   FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS d, o_custkey, count(*) AS n, max(o_orderdate) AS t FROM orders GROUP BY 1, 2)),
 stp AS (SELECT edition FROM ed WHERE month(d) = 7),
 sec AS (SELECT edition, unnest(CASE WHEN month(d) = 4 THEN ['main', 'left'] ELSE ['main', 'left', 'right'] END) AS page FROM ed)"""


@query("audience_resolution", f"""WITH {_mail} SELECT DISTINCT edition, email FROM ed JOIN su ON since <= created_at WHERE NOT EXISTS (SELECT 1 FROM stp WHERE stp.edition = ed.edition)
 AND NOT EXISTS (SELECT 1 FROM de WHERE de.edition = ed.edition AND de.email = su.email AND attempts > 0)
 AND NOT EXISTS (SELECT 1 FROM su n WHERE n.email = su.email AND n.since <= ed.created_at AND NOT EXISTS (SELECT 1 FROM sec WHERE sec.edition = ed.edition AND sec.page = n.page))""")
def audience_resolution(v):
    return T.audience(*mailing(v))


_history = f"""{_mail}, who AS (SELECT edition, email FROM ed JOIN su ON since <= created_at UNION SELECT edition, email FROM de),
 hist AS (SELECT w.edition, w.email, CASE WHEN status IN ('sent', 'sending', 'failed', 'cancelled') THEN status WHEN s.edition IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS status, coalesce(attempts, 0) AS attempts, sent_at
  FROM who w LEFT JOIN de USING (edition, email) LEFT JOIN stp s ON s.edition = w.edition)"""


@query("first_event_in_window", f"""WITH q AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) - 1 AS quarter_end FROM orders), t AS (SELECT max(session) - 200 AS today FROM v_cal),
 h AS (SELECT quarter_end, min(date) AS first_filing FROM q JOIN v_evdays ON label = 'P' AND date BETWEEN quarter_end + 1 AND quarter_end + 45 GROUP BY 1)
 SELECT quarter_end, first_filing, CASE WHEN first_filing IS NOT NULL THEN 'found' WHEN quarter_end + 45 < (SELECT today FROM t) THEN 'none' ELSE 'open' END AS status FROM q LEFT JOIN h USING (quarter_end)""")
def first_event_in_window(v):
    quarters = v.orders.select(F.date_sub(F.trunc(F.col("o_orderdate").cast("date"), "quarter"), 1).alias("quarter_end")).distinct()
    today = v.calendar.agg(F.date_sub(F.max("session"), 200)).scalar()
    return E.first_in_window(quarters, v.event_days.filter("label = 'P'"), today)


@query("spread_pairs", f"""WITH b AS (SELECT month, max(value) FILTER (series_id = '1-URGENT') AS va, max(value) FILTER (series_id = '2-HIGH') AS vb FROM v_series GROUP BY 1 HAVING va IS NOT NULL AND vb IS NOT NULL)
 SELECT '1-URGENT-2-HIGH' AS pair, month, round(va - vb, 2) AS spread, round(CASE WHEN lag(month) OVER (ORDER BY month) = CAST(month - INTERVAL 1 MONTH AS DATE) THEN va - vb - lag(va - vb) OVER (ORDER BY month) END, 2) AS change FROM b""")
def spread_pairs(v):
    return rounded(E.spread_pairs(v.series, "1-URGENT", "2-HIGH"), 2)


def flash_rows(v):
    """Totals of the first 10, 20 and 31 days of each month."""
    days = F.array(*[F.lit(d) for d in (10, 20, 31)])
    o = v.orders.withColumn("day", F.day("o_orderdate")).withColumn("days", F.explode(days)).filter("day <= days")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), "days").agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"))


_flash = """fl AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, days, round(sum(o_totalprice), 2) AS value FROM orders JOIN (SELECT unnest([10, 20, 31]) AS days) ON day(o_orderdate) <= days GROUP BY ALL),
 fy AS (SELECT a.series_id, a.month, a.days, a.value, a.value / b.value - 1 AS yoy FROM fl a LEFT JOIN fl b ON a.series_id = b.series_id AND a.days = b.days AND b.month = CAST(a.month - INTERVAL 12 MONTH AS DATE))"""


@query("flash_after_asof", f"""WITH {_flash}, k AS (SELECT series_id, max(month) AS last_month FROM v_series WHERE month <= DATE '2000-01-01' GROUP BY 1)
 SELECT series_id, month, days, round(yoy, 6) AS yoy, row_number() OVER (PARTITION BY series_id ORDER BY month DESC, days DESC) = 1 AS newest FROM fy JOIN k USING (series_id) WHERE month > last_month AND yoy IS NOT NULL""")
def flash_after_asof(v):
    from ..operators.sets import flash_yoy

    known = v.series.filter("month <= date'2000-01-01'").groupBy("series_id").agg(F.max("month").alias("last_month"))
    later = flash_yoy(flash_rows(v)).join(known, "series_id").filter("month > last_month and yoy is not null")
    top = later.groupBy("series_id").agg(F.max(F.struct("month", "days")).alias("top"))
    return rounded(later.join(top, "series_id").select(
        "series_id", "month", "days", "yoy", ((F.col("month") == F.col("top.month")) & (F.col("days") == F.col("top.days"))).alias("newest")))


