"""Column functions: probabilities, labels, text, web, calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as LB
from ..functions import prob, text, web
from ..operators import bars as B
from ..operators import calendar as K
from ..operators import intraday as I
from ..operators import macro as M
from ..operators import outlook as O
from .aggregates import _device
from .bindings import sql_unit, unit
from .registry import query
from .rounding import rounded
from .windows import QW, SW, _quarter, full, lag

DIR = "SELECT * FROM v_ledger WHERE kind = 'direction'"


@query("temperature_scale", f"""WITH e AS (SELECT record_id, model, instrument, run_id, {', '.join(f'exp(ln(least(greatest({c}, 1e-7), 1.0)) / 1.5) AS {c}' for c in prob.P3)} FROM v_ledger WHERE kind = 'direction'),
 s AS (SELECT instrument, run_id, model, {', '.join(f'{c} / (p_down + p_flat + p_up) AS {c}' for c in prob.P3)} FROM e),
 m AS (SELECT instrument, run_id, {', '.join(f"greatest(sum({c} * w) / sum(w), 1e-9) AS {c}" for c in prob.P3)} FROM (SELECT *, CASE WHEN model = 'Ridge' THEN 2.0 ELSE 1.0 END AS w FROM s) GROUP BY ALL)
 SELECT instrument, run_id, {', '.join(f'round({c} / (p_down + p_flat + p_up), 6) AS {c}' for c in prob.P3)} FROM m""")
def temperature_scale(v):
    d = v.ledger.filter("kind = 'direction'")
    soft = d.withColumns({f"s{i}": e for i, e in enumerate(prob.softened(temperature=1.5))})
    w = F.when(F.col("model") == "Ridge", 2.0).otherwise(1.0)
    g = soft.groupBy("instrument", "run_id").agg(*[F.greatest(F.sum(F.col(f"s{i}") * w) / F.sum(w), F.lit(1e-9)).alias(f"m{i}") for i in range(3)])
    total = F.col("m0") + F.col("m1") + F.col("m2")
    return rounded(g.select("instrument", "run_id", *[(F.col(f"m{i}") / total).alias(c) for i, c in enumerate(prob.P3)]))


@query("log_loss_brier", f"""WITH y AS (SELECT instrument, session AS target_date, CASE WHEN ret < 0 THEN 0 WHEN ret > 0 THEN 2 ELSE 1 END AS y FROM v_vol WHERE ret IS NOT NULL)
 SELECT record_id, round(-ln(greatest([p_down, p_flat, p_up][y + 1], 1e-7)), 6) AS log_loss, round(pow(p_down - CAST(y = 0 AS INT), 2) + pow(p_flat - CAST(y = 1 AS INT), 2) + pow(p_up - CAST(y = 2 AS INT), 2), 6) AS brier FROM ({DIR}) JOIN y USING (instrument, target_date)""")
def log_loss_brier(v):
    y = B.with_vol20(v.bars).filter("ret is not null").select("instrument", F.col("session").alias("target_date"), B.class_of("ret", F.lit(0.0)).alias("y"))
    d = v.ledger.filter("kind = 'direction'").join(y, ["instrument", "target_date"])
    return rounded(d.select("record_id", prob.log_loss(prob.vector(), F.col("y")).alias("log_loss"), prob.brier(prob.vector(), F.col("y")).alias("brier")))


@query("recency_weight", f"""WITH a AS (SELECT instrument, session, row_number() OVER (PARTITION BY instrument ORDER BY session DESC) - 1 AS age FROM v_thin)
 SELECT instrument, session, {', '.join(f"round(pow(2.0, -age / {h}.0::DOUBLE) / avg(pow(2.0, -age / {h}.0::DOUBLE)) OVER (PARTITION BY instrument), 6) AS w{h}" for h in (126, 252, 504))} FROM a""")
def recency_weight(v):
    from pyspark.sql import Window

    key = Window.partitionBy("instrument")
    f = v.thin.withColumn("age", F.row_number().over(key.orderBy(F.col("session").desc())) - 1)
    raw = {h: F.pow(F.lit(2.0), -F.col("age") / float(h)) for h in (126, 252, 504)}
    return rounded(f.select("instrument", "session", *[(w / F.avg(w).over(key)).alias(f"w{h}") for h, w in raw.items()]))


@query("conformal_bounds", f"""WITH f AS (SELECT series_id, month, value AS y, {lag('value', 1, SW)} AS p FROM v_series), s AS (SELECT series_id, list_sort(list(abs(y - p) / greatest(abs(p), 1000))) AS a, count(*) AS n FROM f WHERE p IS NOT NULL GROUP BY 1)
 SELECT series_id, month, round(p - h * greatest(abs(p), 1000), 2) AS low, round(p + h * greatest(abs(p), 1000), 2) AS high FROM f JOIN (SELECT series_id, a[CAST(least(ceil((n + 1) * 0.8 - 1e-12), n) AS INT)] AS h FROM s) USING (series_id) WHERE p IS NOT NULL""")
def conformal_bounds(v):
    f = v.series.select("series_id", "month", F.col("value").alias("y"), M.lag("value").alias("p")).filter("p is not null")
    s = f.groupBy("series_id").agg(F.array_sort(F.collect_list(F.abs(F.col("y") - F.col("p")) / F.greatest(F.abs("p"), F.lit(1000.0)))).alias("a"))
    half = s.select("series_id", F.element_at("a", prob.conformal_rank(F.size("a"))).alias("h"))
    lo, hi = LB.conformal_bounds(F.col("p"), F.col("h"), 1000.0)
    return rounded(f.join(half, "series_id").select("series_id", "month", lo.alias("low"), hi.alias("high")), 2)


@query("round_levels", """WITH b AS (SELECT instrument, session, close, pow(10.0, floor(log10(close))) AS step FROM v_thin WHERE close > 0)
 SELECT instrument, session, round(close, 6) AS close, (floor(close / step) + 1) * step AS level_1, (floor(close / step) + 1) * step + step AS level_2 FROM b""")
def round_levels(v):
    lv = LB.round_levels(F.col("close"))
    return rounded(v.thin.filter("close > 0").select("instrument", "session", "close", F.element_at(lv, 1).alias("level_1"), F.element_at(lv, 2).alias("level_2")))


def open_grid(v):
    """A grid of eleven gaps per instrument and date."""
    gaps = F.array(*[F.lit(round(-0.5 + 0.1 * i, 3)) for i in range(11)])
    b = v.bars.select("instrument", F.col("session").alias("target_date"), unit("concat(instrument, cast(session as string), 'g')").alias("u"), F.explode(gaps).alias("gap"))
    w = 1 / (1 + F.exp(-20 * F.col("gap")))
    a, c = (0.1 + w) * (1 + F.col("u")), 1.1 - w
    total = a + c + 0.5
    return b.select("instrument", "target_date", "gap", (c / total).alias("p_down"), (F.lit(0.5) / total).alias("p_flat"), (a / total).alias("p_up"))


_grid_sql = f"""gr AS (SELECT instrument, target_date, gap, c / (a + c + 0.5) AS p_down, 0.5 / (a + c + 0.5) AS p_flat, a / (a + c + 0.5) AS p_up FROM (SELECT *, (0.1 + w) * (1 + u) AS a, 1.1 - w AS c FROM (
   SELECT instrument, session AS target_date, {sql_unit("instrument||session||'g'")} AS u, gap, 1 / (1 + exp(-20 * gap)) AS w FROM v_bars CROSS JOIN (SELECT unnest([{', '.join(str(round(-0.5 + 0.1 * i, 3)) for i in range(11))}])::DOUBLE AS gap)))),
 gp AS (SELECT instrument, session AS target_date, open, pc, open / pc - 1 AS x FROM (SELECT *, {lag('close')} AS pc FROM v_bars) WHERE pc IS NOT NULL),
 lo AS (SELECT p.instrument, p.target_date, x, least(greatest(x, -0.5), 0.5) AS xc, x < -0.5 OR x > 0.5 AS clamped, max(gap) AS g0 FROM gp p JOIN gr g ON g.instrument = p.instrument AND g.target_date = p.target_date AND gap <= least(greatest(x, -0.5), 0.5) GROUP BY ALL),
 ip AS (SELECT l.*, {', '.join(f"greatest(least(a.{c} + CASE WHEN b.gap > a.gap THEN (xc - a.gap) / (b.gap - a.gap) ELSE 0 END * (coalesce(b.{c}, a.{c}) - a.{c}), 1.0), 1e-7) AS {c}" for c in prob.P3)} FROM lo l JOIN gr a ON a.instrument = l.instrument AND a.target_date = l.target_date AND a.gap = g0
  LEFT JOIN (SELECT instrument, target_date, gap, p_down, p_flat, p_up, lag(gap) OVER (PARTITION BY instrument, target_date ORDER BY gap) AS pg FROM gr) b ON b.instrument = l.instrument AND b.target_date = l.target_date AND b.pg = g0)"""


def gaps_of(v):
    return v.bars.select("instrument", F.col("session").alias("target_date"), "open", B.lagged("close").alias("previous_close"), (B.ratio("open", B.lagged("close")) - 1).alias("x"))


@query("grid_interpolate", f"WITH {_grid_sql} SELECT instrument, target_date, round(x, 6) AS x, clamped, {', '.join(f'round({c} / (p_down + p_flat + p_up), 6) AS {c}' for c in prob.P3)} FROM ip")
def grid_interpolate(v):
    rows = gaps_of(v).filter("x is not null").select("instrument", "target_date", "x")
    return rounded(O.interpolate_grid(rows, open_grid(v), ["instrument", "target_date"], "x"))


@query("macro_stage", f"""WITH p AS (SELECT series_id, month, CASE WHEN hi > lo THEN (value - lo) / (hi - lo) WHEN hi = lo THEN 0.5 END AS pos, value - {lag('value', 3, SW)} AS chg FROM (SELECT *, {full('min', 'value', 12, part=SW)} AS lo, {full('max', 'value', 12, part=SW)} AS hi FROM v_series)),
 s AS (SELECT *, CASE WHEN good >= 0.6 THEN 1 WHEN good <= 0.4 THEN -1 ELSE 0 END AS lv, CASE WHEN fav * chg >= 100000 THEN 1 WHEN fav * chg <= -100000 THEN -1 ELSE 0 END AS mv FROM (SELECT *, CASE WHEN fav > 0 THEN pos ELSE 1 - pos END AS good FROM (SELECT *, CASE WHEN series_id = '5-LOW' THEN -1 ELSE 1 END AS fav FROM p)) WHERE pos IS NOT NULL AND chg IS NOT NULL),
 o AS (SELECT month, count(*) AS n, CASE WHEN avg(lv) >= 0.25 THEN 1 WHEN avg(lv) <= -0.25 THEN -1 ELSE 0 END AS lv, CASE WHEN avg(mv) >= 0.25 THEN 1 WHEN avg(mv) <= -0.25 THEN -1 ELSE 0 END AS mv FROM s GROUP BY 1 HAVING count(*) >= 3),
 u AS (SELECT series_id, month, lv, mv FROM s UNION ALL SELECT 'overall', month, lv, mv FROM o)
 SELECT series_id, month, CASE WHEN lv > 0 THEN CASE WHEN mv < 0 THEN 'caution' ELSE 'good' END WHEN lv < 0 THEN CASE WHEN mv > 0 THEN 'improving' ELSE 'bad' END ELSE CASE WHEN mv > 0 THEN 'improving' WHEN mv < 0 THEN 'caution' ELSE 'neutral' END END AS stage FROM u""")
def macro_stage(v):
    lo, hi = M.roll(F.min, "value", 12), M.roll(F.max, "value", 12)
    f = v.series.withColumn("pos", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).when(hi == lo, 0.5)).withColumn("chg", F.col("value") - M.lag("value", 3))
    lv, mv = LB.stage_sides(F.col("pos"), F.col("chg"), F.when(F.col("series_id") == "5-LOW", -1).otherwise(1), F.lit(100000.0))
    s = f.select("series_id", "month", lv.alias("lv"), mv.alias("mv")).dropna()
    cut = lambda c: F.when(F.avg(c) >= 0.25, 1).when(F.avg(c) <= -0.25, -1).otherwise(0)
    o = s.groupBy("month").agg(F.count(F.lit(1)).alias("n"), cut("lv").alias("lv"), cut("mv").alias("mv")).filter("n >= 3")
    both = s.unionByName(o.select(F.lit("overall").alias("series_id"), "month", "lv", "mv"))
    return both.select("series_id", "month", LB.stage(F.col("lv"), F.col("mv")).alias("stage"))


@query("session_labels", f"""WITH l AS (SELECT instrument, session, ret / 20 AS c2c, (open / {lag('close')} - 1) / 20 AS gap, (close / open - 1) / 20 AS intra, {sql_unit("instrument||session||'z'")} AS u FROM v_vol),
 x AS (SELECT l.*, k.ix FROM l LEFT JOIN (SELECT session, avg(ret) / 20 AS ix FROM v_vol GROUP BY 1) k USING (session) WHERE c2c IS NOT NULL),
 y AS (SELECT *, concat_ws(',', CASE WHEN abs(c2c) < 0.003 THEN 'weak' END, CASE WHEN abs(gap) > 0.005 AND sign(gap) = sign(c2c) AND abs(gap) >= 0.6 * abs(c2c) THEN 'gap_led' END, CASE WHEN u * 6 >= 3 AND abs(u - 0.2) >= 0.4 THEN 'intraday_jump' END,
  CASE WHEN abs(c2c) >= 0.003 AND sign(ix) = sign(c2c) AND abs(c2c - ix) <= greatest(0.5 * abs(c2c), 0.003) THEN 'with_index' END, CASE WHEN abs(0.6 - u) >= 0.3 AND abs(intra) >= 0.003 THEN 'closing_rush' END) AS labels FROM x)
 SELECT instrument, session, CASE WHEN labels = '' THEN 'steady' ELSE labels END AS labels FROM y""")
def session_labels(v):
    f = B.returns_and_legs(v.bars).withColumn("u", unit("concat(instrument, cast(session as string), 'z')"))
    ix = f.groupBy("session").agg((F.avg("ret") / 20).alias("ix"))
    f = f.filter("ret is not null").join(ix, "session", "left")
    s = lambda c: F.col(c) / 20
    return f.select("instrument", "session", LB.session_labels(s("ret"), s("gap"), s("intraday"), F.col("u") * 6, F.col("u") - 0.2, F.col("ix"), 0.6 - F.col("u")).alias("labels"))


@query("flow_rules", f"""WITH f AS (SELECT v.*, close, ret, {full('avg', 'abs(foreign_net)', 20, 1, least=5)} AS usual, -(foreign_net + inst_net) AS indiv_net FROM v_flows v JOIN v_vol USING (instrument, session)),
 g AS (SELECT *, foreign_net * close AS a, inst_net * close AS b, indiv_net * close AS c FROM f), h AS (SELECT *, (a < 0 AND b < 0 AND c < 0) OR (a > 0 AND b > 0 AND c > 0) AS one_side, CASE WHEN ret > 0.001 THEN 'up' WHEN ret < -0.001 THEN 'down' ELSE 'flat' END AS direction,
  {{'v': -a, 'n': 'foreign'}} AS x1, {{'v': -b, 'n': 'institution'}} AS x2, {{'v': -c, 'n': 'individual'}} AS x3 FROM g)
 SELECT instrument, session, direction, CASE direction WHEN 'down' THEN list_max([x1, x2, x3]).n WHEN 'up' THEN CASE WHEN one_side THEN list_max([x1, x2, x3]).n ELSE list_min([x1, x2, x3]).n END ELSE list_max([{{'v': abs(a), 'n': 'foreign'}}, {{'v': abs(b), 'n': 'institution'}}, {{'v': abs(c), 'n': 'individual'}}]).n END AS lead,
 CASE WHEN one_side THEN NULL WHEN direction = 'down' THEN list_min([x1, x2, x3]).n WHEN direction = 'up' THEN list_max([x1, x2, x3]).n END AS counter, round(abs(foreign_net) / nullif(usual, 0), 6) AS foreign_vs_usual,
 concat_ws(',', CASE WHEN one_side THEN 'all_one_side' END, CASE WHEN abs(foreign_net) >= 2 * usual THEN 'foreign_twice_usual' END, CASE WHEN sign(foreign_net) <> sign(ret) THEN 'foreign_against_price' END) AS observations FROM h""")
def flow_rules(v):
    f = v.flows.join(B.with_vol20(v.bars).select("instrument", "session", "close", "ret"), ["instrument", "session"])
    f = f.withColumn("absf", F.abs("foreign_net")).withColumn("usual", B.roll(F.avg, "absf", 20, 1, 5))
    won = {"foreign": F.col("foreign_net"), "institution": F.col("inst_net"), "individual": -(F.col("foreign_net") + F.col("inst_net"))}
    won = {k: x * F.col("close") for k, x in won.items()}
    a, b, c = won.values()
    one = ((a < 0) & (b < 0) & (c < 0)) | ((a > 0) & (b > 0) & (c > 0))
    sold = F.array(*[F.struct((-x).alias("v"), F.lit(k).alias("n")) for k, x in won.items()])
    size = F.array(*[F.struct(F.abs(x).alias("v"), F.lit(k).alias("n")) for k, x in won.items()])
    seller, buyer = F.array_max(sold)["n"], F.array_min(sold)["n"]
    way = F.when(F.col("ret") > 0.001, "up").when(F.col("ret") < -0.001, "down").otherwise("flat")
    lead = F.when(way == "down", seller).when(way == "up", F.when(one, seller).otherwise(buyer)).otherwise(F.array_max(size)["n"])
    counter = F.when(one, F.lit(None).cast("string")).when(way == "down", buyer).when(way == "up", seller)
    seen = LB.listed(F.when(one, "all_one_side"), F.when(F.col("absf") >= 2 * F.col("usual"), "foreign_twice_usual"),
                     F.when(F.signum("foreign_net") != F.signum("ret"), "foreign_against_price"))
    return rounded(f.select("instrument", "session", way.alias("direction"), lead.alias("lead"), counter.alias("counter"),
                            B.ratio("absf", "usual").alias("foreign_vs_usual"), seen.alias("observations")))


@query("forecast_explain", f"""WITH l AS (SELECT instrument, session AS target_date, ret, open / {lag('close')} - 1 AS gap, close / open - 1 AS intra FROM v_vol), d AS (SELECT record_id, instrument, target_date, band, CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 0 WHEN p_flat >= p_up THEN 1 ELSE 2 END AS p FROM ({DIR}) WHERE band IS NOT NULL),
 e AS (SELECT *, CASE WHEN ret < -band THEN 0 WHEN ret > band THEN 2 ELSE 1 END AS actual FROM d JOIN l USING (instrument, target_date))
 SELECT record_id, actual, actual = p AS hit, CASE WHEN gap < -band THEN 0 WHEN gap > band THEN 2 ELSE 1 END AS gap_class, CASE WHEN intra < -band THEN 0 WHEN intra > band THEN 2 ELSE 1 END AS intraday_class, CASE WHEN abs(gap) >= abs(intra) THEN 'gap' ELSE 'intraday' END AS decided_by,
 actual <> p AND sign(gap) = p - 1 AND sign(intra) <> sign(gap) AND abs(intra) > band AS reversed FROM e""")
def forecast_explain(v):
    legs = B.returns_and_legs(v.bars).withColumnRenamed("session", "target_date")
    d = v.ledger.filter("kind = 'direction' and band is not null").join(legs, ["instrument", "target_date"])
    return d.select("record_id", *LB.forecast_explain(prob.argmax(prob.vector()), F.col("band"), F.col("ret"), F.col("gap"), F.col("intraday")))


@query("title_key", "SELECT doc_id, regexp_replace(lower(title), '[^0-9a-z\\x{AC00}-\\x{D7A3}]+', '', 'g') AS key FROM v_heads")
def title_key(v):
    return v.headlines.select("doc_id", text.title_key(F.col("title")).alias("key"))


CLASSES = [("licence", r"(?i)licen[cs]e"), ("contact", r"@|(?i)phone"), ("number", r"[0-9]{3,}"), ("question", r"\?")]


@query("disclosure_class", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]e') THEN 'licence' WHEN regexp_matches(text, '@|(?i)phone') THEN 'contact' WHEN regexp_matches(text, '[0-9]{3,}') THEN 'number' WHEN regexp_matches(text, '\\?') THEN 'question' ELSE '' END AS label FROM documents")
def disclosure_class(v):
    return v.documents.select("doc_id", text.first_class(F.col("text"), CLASSES).alias("label"))


@query("device_class", f"SELECT event_id, {_device} AS device FROM v_hits")
def device_class(v):
    return v.hits.select("event_id", web.device_class(F.col("ua")).alias("device"))


@query("visitor_hash", "SELECT event_id, left(sha256('salt|' || CAST(CAST(ts AS DATE) AS VARCHAR) || '|' || visitor || '|' || ua), 16) AS visitor_id FROM v_hits")
def visitor_hash(v):
    return v.hits.select("event_id", web.visitor_hash("salt", F.col("ts").cast("date").cast("string"), F.col("visitor"), F.col("ua")).alias("visitor_id"))


@query("referrer_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def referrer_host(v):
    return v.pages.select("page_id", web.referrer_host(F.col("url")).alias("host"))


def tagged_urls(v):
    """Page addresses with email parameters: complete, repeated, invalid or missing by hash."""
    k = F.col("page_id") % 5
    day = F.when(k == 3, "2024-02-30").otherwise(F.concat(F.lit("2024-03-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")))
    base = F.concat(F.lit("https://x.example.org/p?utm_source=email&utm_medium=report&edition_day="), day, F.lit("&edition_phase="),
                    F.when(k == 4, "noon").when(F.col("page_id") % 2 == 0, "pre_open").otherwise("post_close"))
    return v.pages.select("page_id", F.when(k == 1, F.concat(base, F.lit("&utm_source=email"))).when(k == 2, F.col("url")).otherwise(base).alias("url"))


@query("email_attribution", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '2024-03-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') END AS edition_day, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'pre_open' ELSE 'post_close' END END AS edition_phase FROM pages")
def email_attribution(v):
    day, phase = web.email_attribution(F.col("url"))
    return tagged_urls(v).select("page_id", day.alias("edition_day"), phase.alias("edition_phase"))


@query("mask_secrets", r"""WITH m AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, 'https?://\S+', '<url>', 'g'), '(?i)\b(key|crtfc_key|api_key|token|secret|serviceKey)=[^&\s]+', '<masked>', 'g') AS t FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)(api[_-]?key|secret|token|passwd|password|authorization)') THEN '<withheld>' ELSE t END AS masked, left(sha256(text), 8) AS fingerprint FROM m""")
def mask_secrets(v):
    return v.documents.select("doc_id", text.mask_secrets(F.col("text")).alias("masked"), text.fingerprint(F.col("text")).alias("fingerprint"))


@query("working_days", "WITH d AS (SELECT CAST(date_trunc('month', session) AS DATE) AS month, count(*) AS days FROM v_cal GROUP BY 1) SELECT series_id, month, days, round(value / greatest(days, 1), 2) AS daily_average FROM v_series JOIN d USING (month)")
def working_days(v):
    return rounded(v.series.join(K.working_days(v.calendar), "month").select(
        "series_id", "month", "days", (F.col("value") / F.greatest("days", F.lit(1))).alias("daily_average")), 2)


@query("nth_session", "WITH d AS (SELECT DISTINCT date FROM v_evdays) SELECT date, (SELECT session FROM v_cal c WHERE c.ordinal = coalesce((SELECT max(ordinal) FROM v_cal x WHERE x.session <= d.date), 0) + 3) AS third FROM d")
def nth_session(v):
    return K.nth_session(v.event_days.select("date").distinct(), "date", v.calendar, 3, "third")


@query("expand_paths", f"""WITH {_quarter}, e AS (SELECT series_id, quarter_ord, profit, exports_k / {lag('exports_k', 1, QW)} AS r, {lag('exports_k', 1, QW)} / {lag('exports_k', 2, QW)} AS r0, {lag('profit', 1, QW)} AS p1, {lag('profit', 2, QW)} AS p2 FROM qf),
 x AS (SELECT *, least(greatest(CASE WHEN r0 > 0 AND abs(ln(r0)) > 1e-6 THEN ln((p1 + 150) / p2) / ln(r0) ELSE 1.0 END, 0.5), 2.5) AS el FROM e WHERE r IS NOT NULL AND r0 IS NOT NULL AND p1 > 0 AND p2 > 0)
 SELECT series_id, quarter_ord, CAST(quarter_ord // 4 AS INT) AS year, CAST(quarter_ord % 4 + 1 AS INT) AS quarter, round(el, 6) AS elasticity, round(least((0.7 * p1 + 100) * r + 0.3 * p1, (0.7 * p1 + 200) * pow(r, el) + 0.3 * p1), 2) AS low, round(greatest((0.7 * p1 + 100) * r + 0.3 * p1, (0.7 * p1 + 200) * pow(r, el) + 0.3 * p1), 2) AS high FROM x""")
def expand_paths(v):
    profit = v.series2.groupBy("series_id", M.quarter_ordinal("month").alias("quarter_ord")).agg(F.round(F.sum("value"), 2).alias("profit"))
    f = M.quarter_frame(v.series, v.series2.withColumn("value", F.col("value") / 1e6), profit, 2)
    L = lambda c, k=1: M.lag(c, k, "series_id", "quarter_ord")
    e = f.select("series_id", "quarter_ord", B.ratio("exports_k", L("exports_k")).alias("r"), B.ratio(L("exports_k"), L("exports_k", 2)).alias("r0"), L("profit").alias("p1"), L("profit", 2).alias("p2"))
    e = e.filter("r is not null and r0 is not null and p1 > 0 and p2 > 0")
    el = F.when((F.col("r0") > 0) & (F.abs(F.ln("r0")) > 1e-6), F.ln((F.col("p1") + 150) / F.col("p2")) / F.ln("r0")).otherwise(1.0)
    e = e.withColumn("elasticity", F.least(F.greatest(el, F.lit(0.5)), F.lit(2.5)))
    lo, hi = LB.split_estimate(0.7 * F.col("p1"), 0.3 * F.col("p1"), 100.0, 200.0, F.col("r"), F.col("elasticity"))
    return e.select("series_id", "quarter_ord", F.floor(F.col("quarter_ord") / 4).cast("int").alias("year"), (F.col("quarter_ord") % 4 + 1).cast("int").alias("quarter"),
                    F.round("elasticity", 6).alias("elasticity"), F.round(lo, 2).alias("low"), F.round(hi, 2).alias("high"))


@query("unit_price", "SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice) / nullif(sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END), 0), 6) AS unit_price FROM lineitem GROUP BY 1")
def unit_price(v):
    g = v.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("s"),
                                             F.sum(F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).otherwise(0.0)).alias("w"))
    return rounded(g.select("l_orderkey", "n", B.ratio("s", "w").alias("unit_price")))


@query("condition_codes", f"""WITH c AS (SELECT series_id, month, value / {lag('value', 3, SW)} - 1 AS chg FROM v_series), p AS (SELECT month, max(chg) FILTER (series_id = '1-URGENT') AS spread, max(chg) FILTER (series_id = '2-HIGH') AS rate, max(chg) FILTER (series_id = '3-MEDIUM') AS stock, max(chg) FILTER (series_id = '5-LOW') AS fx FROM c GROUP BY 1)
 SELECT month, CASE WHEN spread IS NULL OR rate IS NULL OR stock IS NULL THEN 'incomplete' WHEN rate > 0.1 AND stock < -0.1 AND NOT spread > 0.1 THEN 'rate_pressure' WHEN spread > 0.1 AND stock < -0.1 THEN 'credit_stress' WHEN spread > 0.1 THEN 'credit_warning' ELSE 'quiet' END AS credit_code,
 CASE WHEN fx > 0.1 AND rate < -0.1 THEN 'gap_narrow_fx_up' WHEN fx < -0.1 AND rate > 0.1 THEN 'gap_wide_fx_down' ELSE '' END AS fx_code FROM p""")
def condition_codes(v):
    c = v.series.withColumn("chg", B.ratio("value", M.lag("value", 3)) - 1)
    at = lambda s: F.max(F.when(F.col("series_id") == s, F.col("chg")))
    p = c.groupBy("month").agg(at("1-URGENT").alias("spread"), at("2-HIGH").alias("rate"), at("3-MEDIUM").alias("stock"), at("5-LOW").alias("fx"))
    up, dn = lambda c: F.col(c) > 0.1, lambda c: F.col(c) < -0.1
    missing = F.col("spread").isNull() | F.col("rate").isNull() | F.col("stock").isNull()
    credit = F.when(missing, "incomplete").when(up("rate") & dn("stock") & ~up("spread"), "rate_pressure").when(up("spread") & dn("stock"), "credit_stress").when(
        up("spread"), "credit_warning").otherwise("quiet")
    fx = F.when(up("fx") & dn("rate"), "gap_narrow_fx_up").when(dn("fx") & up("rate"), "gap_wide_fx_down").otherwise("")
    return p.select("month", credit.alias("credit_code"), fx.alias("fx_code"))


@query("timeline_points", """WITH l AS (SELECT *, ts + INTERVAL 9 HOUR AS local FROM v_intraday WHERE close > 0), f AS (SELECT instrument, CAST(local AS DATE) AS session, strftime(local, '%H:%M') AS clock, close FROM l)
 SELECT instrument, session, count(*) AS n, string_agg(clock || '=' || printf('%.2f', close), ';' ORDER BY clock) AS points FROM f WHERE clock BETWEEN '09:00' AND '15:30' GROUP BY ALL""")
def timeline_points(v):
    return I.timeline_points(v.intraday)
