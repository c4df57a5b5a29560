"""Top-k reports and rule-based choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import choices as Q
from ..operators import traffic as T
from .bindings import MODELS, sql_unit
from .joins import FEATURES, contributions
from .registry import query
from .rounding import rounded
from .windows import W, lag


@query("top_dimension", """WITH t AS (SELECT dimension, value, count(*) AS views FROM (UNPIVOT (SELECT country, region, city, referrer FROM v_hits) ON country, region, city, referrer INTO NAME dimension VALUE value) WHERE value <> '' GROUP BY ALL)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY views DESC, value) AS rank FROM t) WHERE rank <= 30""")
def top_dimension(v):
    return T.top_dimension(v.hits)


@query("feature_top_k", f"""WITH c AS (SELECT run_id, instrument, feature, sum({sql_unit('record_id||feature')} - 0.5) / {len(MODELS)} AS contribution FROM v_ledger CROSS JOIN (SELECT unnest({FEATURES!r}) AS feature) WHERE kind = 'direction' GROUP BY ALL)
 SELECT run_id, instrument, feature, round(contribution, 6) AS contribution, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, instrument ORDER BY abs(contribution) DESC, feature) AS rank FROM c) WHERE rank <= 3""")
def feature_top_k(v):
    return rounded(Q.feature_top_k(contributions(v), ["run_id", "instrument"], len(MODELS), 3))


@query("last_n_sessions", "SELECT instrument, session, round(close, 6) AS close, back FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session DESC) AS back FROM v_thin) WHERE back <= 252")
def last_n_sessions(v):
    return rounded(Q.last_n(v.thin.select("instrument", "session", "close"), "instrument", "session", 252))


def rival_errors(v):
    """Absolute error of four naive rivals for the next close, per brand and year."""
    K, TM = "instrument", "session"
    f = v.thin.select(K, TM, F.year(TM).alias("year"), F.quarter(TM).alias("block"), F.col("close").alias("y"), B.lagged("close").alias("rw"),
                      (2 * B.lagged("close", 1) - B.lagged("close", 2)).alias("drift"), B.roll(F.avg, "close", 5, 1).alias("ar"),
                      B.roll(F.avg, "close", 20, 1).alias("var")).dropna()
    return f


_rivals = f"""rv AS (SELECT instrument, session, year(session) AS year, quarter(session) AS block, close AS y, {lag('close')} AS rw, 2 * {lag('close')} - {lag('close', 2)} AS drift,
  CASE WHEN count(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 5 THEN avg(close) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS ar,
  CASE WHEN count(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 20 THEN avg(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS var FROM v_thin),
 rr AS (SELECT * FROM rv WHERE rw IS NOT NULL AND drift IS NOT NULL AND ar IS NOT NULL AND var IS NOT NULL)"""

LADDER = ("rw", "drift", "ar", "var")
_pairs = [(b, m) for i, b in enumerate(LADDER) for m in LADDER[i + 1:]]


@query("ladder_choice", f"""WITH {_rivals}, s AS ({' UNION ALL '.join(f"SELECT instrument, '{m}' AS model, '{b}' AS baseline, avg(abs({m} - y) - abs({b} - y)) + 1.96 * stddev_samp(abs({m} - y) - abs({b} - y)) / sqrt(count(*)) AS hi FROM rr GROUP BY 1" for b, m in _pairs)}),
 w AS (SELECT instrument, {', '.join(f"max(hi) FILTER (baseline = '{b}' AND model = '{m}') AS {b}_{m}" for b, m in _pairs)} FROM s GROUP BY 1),
 a AS (SELECT *, CASE WHEN rw_drift < 0 THEN 'drift' ELSE 'rw' END AS c1 FROM w), b AS (SELECT *, CASE WHEN CASE c1 WHEN 'rw' THEN rw_ar ELSE drift_ar END < 0 THEN 'ar' ELSE c1 END AS c2 FROM a),
 c AS (SELECT *, CASE WHEN CASE c2 WHEN 'rw' THEN rw_var WHEN 'drift' THEN drift_var ELSE ar_var END < 0 THEN 'var' ELSE c2 END AS c3 FROM b),
 mb AS ({' UNION ALL '.join(f"SELECT instrument, year, '{m}' AS candidate, block, avg(abs({m} - y)) AS mae FROM rr GROUP BY ALL" for m in LADDER)}),
 g AS (SELECT m.instrument, m.year, m.candidate, avg(m.mae) AS mean, count(*) FILTER (m.mae < r.mae) AS wins, avg(r.mae) AS ref FROM mb m JOIN mb r ON r.instrument = m.instrument AND r.year = m.year AND r.block = m.block AND r.candidate = 'rw' GROUP BY ALL),
 p AS (SELECT instrument, year, arg_min(candidate, {{'a': mean, 'b': candidate}}) AS chosen, min(mean) AS mean_mae FROM g WHERE candidate = 'rw' OR (wins >= 2 AND mean < ref) GROUP BY ALL)
 SELECT instrument, p.year, c3 AS by_ladder, p.chosen AS by_inner, round(mean_mae, 6) AS mean_mae FROM c JOIN p USING (instrument)""")
def ladder_choice(v):
    f = rival_errors(v)
    items = []
    for b, m in _pairs:
        d = F.abs(F.col(m) - F.col("y")) - F.abs(F.col(b) - F.col("y"))
        items.append(F.struct(F.lit(m).alias("model"), F.lit(b).alias("baseline"), d.alias("d")))
    s = f.select("instrument", F.explode(F.array(*items)).alias("i")).select("instrument", "i.*").groupBy("instrument", "model", "baseline").agg(
        (F.avg("d") + 1.96 * F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("hi"))
    ladder = Q.ladder_choice(s, "instrument", LADDER).withColumnRenamed("chosen", "by_ladder")
    long = f.select("instrument", "year", "block", F.explode(F.array(*[F.struct(F.lit(m).alias("candidate"), F.abs(F.col(m) - F.col("y")).alias("e")) for m in LADDER])).alias("i"))
    maes = long.select("instrument", "year", "block", "i.*").groupBy("instrument", "year", "block", "candidate").agg(F.avg("e").alias("mae"))
    inner = Q.select_by_inner(maes, ["instrument", "year"], "rw").withColumnRenamed("chosen", "by_inner")
    return rounded(inner.join(ladder, "instrument"))


@query("prequential_choice", f"""WITH {_rivals}, g AS (SELECT instrument, session, abs(ar - y) - abs(rw - y) AS g, ar, rw FROM rr)
 SELECT instrument, session, use_candidate, round(CASE WHEN use_candidate THEN ar ELSE rw END, 6) AS prediction FROM (SELECT *, coalesce(count(g) OVER p >= 8 AND avg(g) OVER p < 0, false) AS use_candidate FROM g WINDOW p AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def prequential_choice(v):
    f = Q.prequential_choice(rival_errors(v), "instrument", "session", "rw", "ar", "y")
    return rounded(f.select("instrument", "session", "use_candidate", "prediction"))


def two_models(v):
    d = v.daily.filter("kind = 'direction' and actual_class is not null")
    side = lambda m, t: d.filter(F.col("model") == m).select("instrument", "target_date", "target_mode", F.col("actual_class").alias(f"y{t}"),
                                                            *[F.col(c).alias(f"{t}{i}") for i, c in enumerate(("p_down", "p_flat", "p_up"))])
    return side("Mean ensemble", "a").join(side("Ridge", "b"), ["instrument", "target_date", "target_mode"]).withColumnRenamed("ya", "y")


_mix = lambda w: f"avg(-ln(greatest([{', '.join(f'{w} * a.{c} + (1 - {w}) * b.{c}' for c in ('p_down', 'p_flat', 'p_up'))}][a.actual_class + 1], 1e-7)))"


@query("best_weight", f"""WITH d AS (SELECT * FROM v_daily WHERE kind = 'direction' AND actual_class IS NOT NULL),
 g AS (SELECT a.instrument, count(*) AS n, [{', '.join(f"{{'loss': round({_mix(w)}, 12), 'w': {w}::DOUBLE}}" for w in (0.0, 0.25, 0.5, 0.75, 1.0))}] AS l FROM d a JOIN d b USING (instrument, target_date, target_mode) WHERE a.model = 'Mean ensemble' AND b.model = 'Ridge' GROUP BY 1)
 SELECT instrument, n, CASE WHEN n < 20 THEN 0.5 ELSE list_min(l).w END AS weight, round(list_min(l).loss, 6) AS loss FROM g""")
def best_weight(v):
    return rounded(Q.best_weight(two_models(v), "instrument"))


STOP, SUFFIXES = ["the", "der", "la"], ["ens", "en", "es", "s", "e"]
_cut = "CASE " + " ".join(f"WHEN i = {i} AND ends_with(word, '{s}') AND length(word) - {len(s)} >= 2 THEN left(word, length(word) - {len(s)})" for i, s in enumerate(SUFFIXES)) + " END"


@query("term_ranking", f"""WITH h AS (SELECT *, CAST(time AS DATE) AS day, regexp_replace(lower(title), '[^0-9a-z\\x{{AC00}}-\\x{{D7A3}}]+', '', 'g') AS key FROM v_heads),
 f AS (SELECT * FROM h WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY day, key ORDER BY time DESC, doc_id DESC) = 1),
 w AS (SELECT day, doc_id, time, source, unnest(list_distinct(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]{{2,}}'))) AS word FROM f),
 st AS (SELECT day, word, arg_min(stem, i) AS stem FROM (SELECT day, word, i, {_cut} AS stem FROM (SELECT DISTINCT day, word FROM w) CROSS JOIN (SELECT unnest(range({len(SUFFIXES)})) AS i)) c SEMI JOIN (SELECT DISTINCT day, word AS stem FROM w) v USING (day, stem) GROUP BY ALL),
 t AS (SELECT day, coalesce(stem, word) AS term, doc_id, max(time) AS time, max(source) AS source FROM w LEFT JOIN st USING (day, word) WHERE coalesce(stem, word) NOT IN ('the', 'der', 'la') AND word NOT IN ('the', 'der', 'la') GROUP BY ALL),
 g AS (SELECT day, term, count(DISTINCT source) AS sources, count(*) AS articles, max(time) AS latest FROM t GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT source) >= 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sources DESC, articles DESC, latest DESC, term DESC) AS rank FROM g QUALIFY rank <= 10),
 n AS (SELECT day, term, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY day, term ORDER BY time DESC, doc_id DESC) AS k FROM t QUALIFY k <= 3) GROUP BY ALL)
 SELECT day, term, sources, articles, latest, rank, newest FROM r JOIN n USING (day, term)""")
def term_ranking(v):
    return Q.term_ranking(v.headlines, STOP, SUFFIXES)
