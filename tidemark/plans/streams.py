"""Batch forms of the streaming operators (the streams themselves are exercised in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import ledger as L
from ..operators import outlook as O
from ..operators import quotes as U
from ..operators import sets as S
from ..operators import settle as Z
from ..functions.web import BOTS
from ..operators import traffic as T
from .bindings import sql_unit, unit
from .registry import query
from .rounding import rounded
from .scalars import _grid_sql, gaps_of, open_grid

_dedup = f"""hd AS (SELECT visitor, page, CAST(ts AS DATE) AS day, list(DISTINCT ts) AS l FROM v_hits WHERE NOT regexp_matches(ua, '{BOTS}') GROUP BY ALL),
 cv AS (SELECT visitor, page, day, unnest(list_reduce(list_sort(l), lambda acc, x: CASE WHEN epoch(x) - epoch(acc[-1]) >= 600 THEN list_append(acc, x) ELSE acc END, list_sort(l)[1:1])) AS ts FROM hd)"""


@query("hit_dedup_stream", f"WITH {_dedup} SELECT cv.*, (SELECT min(event_id) FROM v_hits h WHERE h.visitor = cv.visitor AND h.page = cv.page AND h.ts = cv.ts AND NOT regexp_matches(ua, '{BOTS}')) AS event_id FROM cv")
def hit_dedup_stream(v):
    return T.dedup_hits(v.hits)


@query("visit_attribution", f"""WITH {_dedup}, p AS (SELECT event_id, visitor, page, CAST(ts AS DATE) AS day, ts, source FROM v_hits WHERE NOT regexp_matches(ua, '{BOTS}')),
 n AS (SELECT *, lead(ts) OVER (PARTITION BY visitor, page, day ORDER BY ts) AS nx FROM cv)
 SELECT n.visitor, n.page, n.day, n.ts, min(p.event_id) FILTER (p.ts = n.ts) AS event_id, CASE WHEN bool_or(source = 'email') THEN 'email' ELSE '' END AS source,
  arg_min(p.event_id, {{'a': p.ts, 'b': p.event_id}}) FILTER (source = 'email') AS attributed_by
 FROM n JOIN p ON p.visitor = n.visitor AND p.page = n.page AND p.day = n.day AND p.ts >= n.ts AND (nx IS NULL OR p.ts < nx) GROUP BY n.visitor, n.page, n.day, n.ts""")
def visit_attribution(v):
    return T.attributed_visits(v.hits)


@query("running_totals_stream", f"WITH {_dedup} SELECT page, count(*) AS total FROM cv GROUP BY 1")
def running_totals_stream(v):
    return T.running_totals(T.dedup_hits(v.hits))


@query("tumbling_views", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, page, count(*) AS views, count(DISTINCT visitor) AS visitors FROM v_hits GROUP BY ALL")
def tumbling_views(v):
    return T.tumbling_views(v.hits)


def quotes(v):
    """Event values as minute quotes that arrive a hashed number of seconds later, some twice."""
    u = unit("concat(cast(event_id as string), 'q')")
    base = v.events.select("event_id", F.col("event_type").alias("instrument"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), u.alias("u"),
                           F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"))
    base = base.withColumn("arrived", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("u") * 400)))
    again = base.filter("u > 0.8").withColumn("arrived", F.col("arrived") + F.expr("interval 5 minute")).withColumn("price", F.when(F.col("u") > 0.9, F.col("price") + 1).otherwise(F.col("price")))
    return base.unionByName(again)


@query("first_seen_quotes", f"""WITH b AS (SELECT event_type AS instrument, date_trunc('minute', ts) AS ts, value AS price, {sql_unit("event_id||'q'")} AS u, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM events),
 q AS (SELECT *, ts + to_seconds(floor(u * 400)) AS arrived FROM b UNION ALL SELECT instrument, ts, CASE WHEN u > 0.9 THEN price + 1 ELSE price END, u, source, ts + to_seconds(floor(u * 400)) + INTERVAL 5 MINUTE FROM b WHERE u > 0.8),
 f AS (SELECT instrument, ts, source, arg_min(price, {{'a': arrived, 'p': price}}) AS price, min(arrived) AS arrived, min(price) <> max(price) AS conflict FROM q WHERE ts + INTERVAL 1 MINUTE <= arrived AND price > 0 GROUP BY ALL)
 SELECT *, date_diff('second', ts + INTERVAL 1 MINUTE, arrived) AS age, date_diff('second', ts + INTERVAL 1 MINUTE, arrived) <= 120 AND strftime(ts + INTERVAL 541 MINUTE, '%H:%M:%S') > '09:00:00' AND strftime(ts + INTERVAL 541 MINUTE, '%H:%M:%S') <= '15:30:00' AS fresh FROM f""")
def first_seen_quotes(v):
    return U.freshness(U.first_seen(quotes(v)))


@query("late_correction", """WITH o AS (SELECT key, period, observed_at, round(value, -5) AS value FROM v_versions), c AS (SELECT *, lag(value) OVER (PARTITION BY key, period ORDER BY observed_at) AS pv FROM o),
 s AS (SELECT *, lead(observed_at) OVER (PARTITION BY key, period ORDER BY observed_at) AS nx FROM (SELECT * FROM c WHERE pv IS NULL OR pv <> value)), d AS (SELECT DISTINCT CAST(date_trunc('quarter', observed_at) AS DATE) + 45 AS decision FROM v_versions)
 SELECT decision, key, count(*) AS known, sum(value) AS total FROM d JOIN s ON observed_at <= decision AND (nx IS NULL OR decision < nx) GROUP BY ALL""")
def late_correction(v):
    o = v.versions.withColumn("value", F.round("value", -5))
    kept = S.archive_versions(o, ["key", "period"], "observed_at", ["value"])
    dec = v.versions.select(F.date_add(F.trunc("observed_at", "quarter"), 45).alias("decision")).distinct()
    return A.known_state(kept, dec, "key", "period", "observed_at", "decision", "value").select("decision", "key", "known", "total")


@query("incremental_scoring", f"""WITH b AS (SELECT * FROM v_scored), o AS (SELECT record_id, CASE WHEN target_date < (SELECT CAST(now AS DATE) - 100 FROM v_now) THEN status ELSE 'pending' END AS old_status, target_date < (SELECT CAST(now AS DATE) - 100 FROM v_now) AND status = 'scored' AS old_ok FROM b),
 n AS (SELECT b.record_id, target_date, b.status, log_loss, old_status, old_ok, {sql_unit("b.instrument||b.target_date||'gap'")} < 0.05 AS gone FROM b JOIN o USING (record_id)),
 r AS (SELECT *, CASE WHEN gone AND status <> 'pending' THEN CASE WHEN old_ok THEN 'scored' ELSE 'missing_actual' END ELSE status END AS st FROM n)
 SELECT record_id, st AS status, round(CASE WHEN st = 'scored' THEN log_loss END, 6) AS log_loss FROM r""")
def incremental_scoring(v):
    first = v.now - F.expr("interval 100 days")
    late = F.col("target_date") >= first.cast("date")
    old = v.scored.withColumn("status", F.when(late, "pending").otherwise(F.col("status")))
    old = old.withColumns({c: F.when(~late, F.col(c)) for c in L.OUTCOMES}).withColumn("scored_at", first)
    gone = unit("concat(instrument, cast(session as string), 'gap')") < 0.05
    # A bar that is missing now cannot grade its day; its rows keep what they had. It still serves as a reference.
    blank = lambda c: F.when(~gone, F.col(c))
    bars = v.bars.select("instrument", "session", blank("open").alias("open"), blank("close").alias("close"), F.col("close").alias("adj_close"))
    fresh = L.score_forecasts(v.ledger, bars, v.now)
    return rounded(L.rescore(old, fresh, v.now).select("record_id", "status", "log_loss"))


def observed_totals(v):
    """Monthly totals as they become known: two provisional estimates from a part of the customers, the confirmed total, and a
    later revision that comes too late."""
    o = v.orders.select(F.col("o_orderpriority").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), "o_custkey", "o_totalprice")
    part = lambda n: F.sum(F.when(F.col("o_custkey") % n == 0, F.col("o_totalprice"))) * n
    g = o.groupBy("series_id", "month").agg(F.round(F.sum("o_totalprice"), 2).alias("whole"), F.round(part(3), 2).alias("third"), F.round(part(2), 2).alias("half"))
    seen = lambda days, kind, value: F.struct(F.date_add(F.add_months("month", 1), days).alias("observed_at"), F.lit(kind).alias("kind"), value.alias("value"))
    rows = F.array(seen(1, "provisional", F.col("third")), seen(10, "provisional", F.col("half")), seen(12, "provisional", F.col("half")), seen(40, "confirmed", F.col("whole")),
                   seen(55, "provisional", F.col("third")), seen(90, "confirmed", F.col("whole") + 1))
    return g.select("series_id", "month", F.explode(rows).alias("e")).select("series_id", "month", "e.*")


@query("confirmed_scoring", """WITH g AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS whole, round(sum(o_totalprice) FILTER (o_custkey % 3 = 0) * 3, 2) AS third,
   round(sum(o_totalprice) FILTER (o_custkey % 2 = 0) * 2, 2) AS half FROM orders GROUP BY ALL),
 t AS (SELECT CAST(max(month) + INTERVAL 2 MONTH AS DATE) AS now FROM g), e AS (SELECT *, CAST(month + INTERVAL 1 MONTH AS DATE) AS e FROM g),
 f AS (SELECT series_id, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, value AS point FROM v_series WHERE month < (SELECT max(month) FROM v_series) UNION ALL SELECT DISTINCT series_id, (SELECT CAST(max(month) + INTERVAL 1 MONTH AS DATE) FROM v_series), 1.0::DOUBLE FROM v_series),
 k AS (SELECT e.*, e + 40 <= now AS closed, CASE WHEN third IS NOT NULL AND e + 1 <= now THEN 1 ELSE 0 END AS has3, CASE WHEN half IS NOT NULL AND e + 10 <= now THEN 1 ELSE 0 END AS has2 FROM e, t),
 s AS (SELECT series_id, month, CASE WHEN closed THEN 'final' ELSE 'provisional' END AS state, CASE WHEN closed THEN whole WHEN has2 = 1 THEN half ELSE third END AS actual,
   CASE WHEN closed THEN e + 40 WHEN has2 = 1 THEN e + 10 ELSE e + 1 END AS updated_at, CASE WHEN has3 = 1 THEN e + 1 WHEN has2 = 1 THEN e + 10 ELSE e + 40 END AS first_seen, has3 + has2 + CAST(closed AS INT) - 1 AS changes FROM k WHERE has3 + has2 > 0 OR closed)
 SELECT f.series_id, f.month, coalesce(state, 'pending') AS state, round(actual, 2) AS actual, first_seen, updated_at, coalesce(changes, 0)::BIGINT AS changes, round(point - actual, 2) AS error, round(abs(point - actual) / abs(actual), 6) AS ape FROM f LEFT JOIN s USING (series_id, month)""")
def confirmed_scoring(v):
    """Last month's total as the forecast of the next, two months after the newest month."""
    seen = observed_totals(v)
    now = v.series.agg(F.add_months(F.max("month"), 2)).scalar()
    newest = v.series.agg(F.add_months(F.max("month"), 1)).scalar()
    points = v.series.select("series_id", F.add_months("month", 1).alias("month"), F.col("value").alias("point")).filter(F.col("month") < newest)
    points = points.unionByName(v.series.select("series_id").distinct().select("series_id", newest.alias("month"), F.lit(1.0).alias("point")))
    out = Z.settled(points, seen, ["series_id", "month"], by_time=now)
    return out.select("series_id", "month", "state", F.round("actual", 2).alias("actual"), "first_seen", "updated_at", "changes", F.round("error", 2).alias("error"), F.round("ape", 6).alias("ape"))


@query("post_open_update", f"""WITH {_grid_sql}, n AS (SELECT max(session) - 30 AS today FROM v_cal), g AS (SELECT instrument, target_date, open, pc, {sql_unit("instrument||target_date||'po'")} AS u FROM (SELECT instrument, session AS target_date, open, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS pc FROM v_bars)),
 w AS (SELECT *, CASE WHEN u < 0.1 THEN 'already_there' WHEN u > 0.9 THEN 'no_grid' WHEN u BETWEEN 0.5 AND 0.52 THEN 'no_open' WHEN pc IS NULL THEN 'no_previous_close' WHEN (SELECT today FROM n) > target_date THEN 'late' ELSE '' END AS skipped FROM g)
 SELECT w.instrument, w.target_date, skipped, round(CASE WHEN skipped = '' THEN open / pc - 1 END, 6) AS gap, CASE WHEN skipped = '' THEN clamped END AS clamped, {', '.join(f"round(CASE WHEN skipped = '' THEN {c} / (p_down + p_flat + p_up) END, 6) AS {c}" for c in ('p_down', 'p_flat', 'p_up'))} FROM w LEFT JOIN ip USING (instrument, target_date)""")
def post_open_update(v):
    u = unit("concat(instrument, cast(target_date as string), 'po')")
    opens = gaps_of(v).drop("x").withColumn("open", F.when(~u.between(0.5, 0.52), F.col("open")))
    grid = open_grid(v).filter(u <= 0.9)
    known = opens.filter(u < 0.1)
    now = v.calendar.agg(F.date_sub(F.max("session"), 30).cast("timestamp_ntz")).scalar()
    return rounded(O.post_open_rows(opens, grid, known, now))
