"""Merging versions of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ledger as L
from ..operators import sets as S
from .bindings import sql_unit, unit
from .joins import _flash, flash_rows
from .registry import query
from .rounding import rounded


def two_ledgers(v):
    """A remote copy that lacks some rows and a local copy with other scores."""
    u = unit("concat(record_id, 'm')")
    s = v.scored.withColumn("u", u)
    remote = s.filter("u < 0.8").withColumn("copy", F.lit("remote")).drop("u")
    local = s.filter("u > 0.3").withColumn("copy", F.lit("local")).withColumn("log_loss", F.lit(9.0)).drop("u")
    return remote, local


@query("merge_ledger", f"""WITH s AS (SELECT record_id, status, log_loss, {sql_unit("record_id||'m'")} AS u FROM v_scored) SELECT record_id, 'remote' AS copy, status, round(log_loss, 6) AS log_loss FROM s WHERE u < 0.8
 UNION ALL SELECT record_id, 'local', status, 9.0 FROM s WHERE u > 0.3 AND u >= 0.8""")
def merge_ledger(v):
    return rounded(L.merge_ledgers(*two_ledgers(v)).select("record_id", "copy", "status", "log_loss"))


@query("merge_history", """WITH o AS (SELECT series_id, month, value AS a, value * 2 AS b FROM v_series2), n AS (SELECT series_id, month, CASE WHEN month(month) <> 6 THEN value END AS a, value / 2 AS c FROM v_series WHERE year(month) > 1996)
 SELECT series_id, month, round(coalesce(n.a, o.a), 3) AS a, round(b, 3) AS b, round(c, 3) AS c FROM n FULL JOIN o USING (series_id, month)""")
def merge_history(v):
    old = v.series2.select("series_id", "month", F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    new = v.series.filter(F.year("month") > 1996).select("series_id", "month", F.when(F.month("month") != 6, F.col("value")).alias("a"), (F.col("value") / 2).alias("c"))
    return rounded(S.merge_history(old, new, ["series_id", "month"]), 3)


def vintages(v):
    """Three vintages of the monthly series; the last one lacks the newest months."""
    s = v.series
    old = s.filter("month < date'2001-01-01'").select(F.lit("2001-01-10").cast("date").alias("vintage_date"), "series_id", "month", "value")
    return old.unionByName(s.filter("month < date'2001-04-01'").select(F.lit("2001-04-10").cast("date").alias("vintage_date"), "series_id", "month", F.when(
        F.col("series_id") == "5-LOW", F.col("value") * 1.1).otherwise(F.col("value")).alias("value")))


@query("vintage_append", """WITH last AS (SELECT series_id, month, CASE WHEN series_id = '5-LOW' THEN value * 1.1 ELSE value END AS old FROM v_series WHERE month < DATE '2001-04-01'),
 f AS (SELECT * FROM v_series WHERE month >= DATE '2000-01-01' AND (month < DATE '2001-04-01' OR series_id IN ('1-URGENT', '5-LOW'))),
 m AS (SELECT series_id FROM f LEFT JOIN last USING (series_id, month) GROUP BY 1 HAVING bool_or(old IS NULL OR abs(value - old) > 1e-9)) SELECT DATE '2001-09-10' AS vintage_date, series_id, month, value FROM f SEMI JOIN m USING (series_id)""")
def vintage_append(v):
    fresh = v.series.filter("month >= date'2000-01-01' and (month < date'2001-04-01' or series_id in ('1-URGENT', '5-LOW'))")
    return S.vintage_append(vintages(v), fresh, F.lit("2001-09-10").cast("date"))


@query("archive_versions", """WITH o AS (SELECT key, observed_at, round(sum(value), -5) AS value FROM v_versions GROUP BY ALL), p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY observed_at) AS pv FROM o)
 SELECT key, observed_at, value, row_number() OVER (PARTITION BY key ORDER BY observed_at) AS version FROM p WHERE pv IS NULL OR pv <> value""")
def archive_versions(v):
    o = v.versions.groupBy("key", "observed_at").agg(F.round(F.sum("value"), -5).alias("value"))
    return S.archive_versions(o, "key", "observed_at", ["value"])


@query("prepend_history", """WITH n AS (SELECT * FROM v_series2 WHERE month >= DATE '1998-03-01'), f AS (SELECT series_id, min(month) AS m, arg_min(value, month) AS v FROM n GROUP BY 1), k AS (SELECT s.series_id, m, f.v / value AS k FROM v_series s JOIN f ON f.series_id = s.series_id AND s.month = m)
 SELECT series_id, month, round(value * k, 3) AS value, 'older' AS origin FROM v_series JOIN k USING (series_id) WHERE month < m UNION ALL SELECT series_id, month, value, 'newer' FROM n""")
def prepend_history(v):
    return rounded(S.prepend_history(v.series, v.series2.filter("month >= date'1998-03-01'")), 3)


ORDER = ["Mean ensemble", "Ridge", "Copy of ridge", "Candidate IV interval"]


@query("dedupe_candidates", "SELECT instrument, 'Copy of ridge' AS model, 'Ridge' AS same_as, 0.0::DOUBLE AS max_diff FROM v_daily WHERE kind = 'direction' AND model = 'Ridge' AND target_mode = 'close_to_close' GROUP BY 1")
def dedupe_candidates(v):
    d = v.daily.filter("kind = 'direction' and target_mode = 'close_to_close'").select("instrument", "target_date", "model", "p_down", "p_flat", "p_up")
    copy = d.filter("model = 'Ridge'").withColumn("model", F.lit("Copy of ridge"))
    return S.dedupe_candidates(d.filter(F.col("model").isin(*ORDER)).unionByName(copy), ORDER)


@query("flash_fill", f"""WITH {_flash}, c AS (SELECT * FROM v_series WHERE month < DATE '2001-01-01'), fu AS (SELECT series_id, month, value AS fv FROM fy WHERE days = 31 AND month < DATE '2001-06-01'), pa AS (SELECT series_id, month, arg_max(yoy, days) AS g FROM fy WHERE days < 31 AND yoy IS NOT NULL GROUP BY ALL)
 SELECT series_id, month, round(v, 3) AS value, basis FROM (SELECT series_id, month, coalesce(c.value, fv, l.value * (1 + g)) AS v, CASE WHEN c.value IS NOT NULL THEN 'confirmed' WHEN fv IS NOT NULL THEN 'flash_month' ELSE 'flash_growth' END AS basis
  FROM c FULL JOIN fu USING (series_id, month) FULL JOIN pa USING (series_id, month) LEFT JOIN (SELECT series_id, CAST(month + INTERVAL 12 MONTH AS DATE) AS month, value FROM c) l USING (series_id, month)) WHERE v IS NOT NULL""")
def flash_fill(v):
    flash = flash_rows(v)
    return rounded(S.flash_fill(v.series.filter("month < date'2001-01-01'"), flash.filter("days < 31 or month < date'2001-06-01'")), 3)


@query("expected_grid_gap", """WITH g AS (SELECT instrument, session, unnest(generate_series(CAST(session AS TIMESTAMP), CAST(session AS TIMESTAMP) + INTERVAL 1435 MINUTE, INTERVAL 5 MINUTE)) AS ts FROM (SELECT DISTINCT instrument, session FROM v_intraday))
 SELECT instrument, session, count(*) AS missing, min(ts) AS first_missing FROM g ANTI JOIN v_intraday USING (instrument, ts) GROUP BY ALL""")
def expected_grid_gap(v):
    key = ["instrument", "session", "ts"]
    gap = S.expected_grid(v.intraday, 5).join(v.intraday.select(*key), key, "left_anti")
    return gap.groupBy("instrument", "session").agg(F.count(F.lit(1)).alias("missing"), F.min("ts").alias("first_missing"))


@query("sink_append_first", f"""WITH s AS (SELECT record_id, target_date, created_at, {sql_unit("record_id||'x'")} AS u FROM v_ledger) SELECT record_id, target_date, created_at FROM s WHERE u > 0.5""")
def sink_append_first(v):
    s = v.ledger.select("record_id", "target_date", "created_at").withColumn("u", unit("concat(record_id, 'x')"))
    known = s.filter("u <= 0.5").drop("u")
    again = s.filter("u > 0.4").drop("u")
    return J.append_first(known, again.unionByName(again.withColumn("created_at", F.col("created_at") + F.expr("interval 1 hour"))), "record_id", ["created_at"])
