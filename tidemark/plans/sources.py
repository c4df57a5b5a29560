"""Parsing landed payloads. The payload texts are written by Spark from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import macro as M
from ..sources import payloads as P
from ..sources import readers as R
from ..sources import sinks as K
from .bindings import sql_unit, unit
from .joins import _flash, flash_rows
from .registry import query
from .rounding import rounded


@query("scan_bars", f"""WITH u AS (SELECT *, {sql_unit("instrument||session||'s'")} AS u FROM v_thin), r AS (SELECT instrument, session, open, high, low, CASE WHEN u < 0.2 THEN close + 1 ELSE close END AS close, volume FROM u WHERE u < 0.9)
 SELECT instrument, session, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM r""")
def scan_bars(v):
    raw = v.thin.withColumn("u", unit("concat(instrument, cast(session as string), 's')")).select(
        F.col("session").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
        F.col("volume").alias("Volume"), F.col("instrument").alias("Instrument"), F.when(F.col("u") >= 0.9, "adjusted").otherwise("unadjusted").alias("Adjustment"), F.lit(1).alias("Row No"), "u")
    twice = raw.filter("u < 0.2").withColumn("Close", F.col("Close") + 1).withColumn("Row No", F.lit(2))
    return rounded(R.clean_bars(raw.unionByName(twice).drop("u")))


@query("monthly_close", "SELECT * FROM (SELECT instrument, CAST(date_trunc('month', session) AS DATE) AS month, round(arg_max(close, session), 6) AS value FROM v_thin WHERE close > 0 GROUP BY 1, 2) WHERE last_day(month) < (SELECT max(session) - 40 FROM v_cal)")
def monthly_close(v):
    return rounded(R.monthly_close(v.thin, v.calendar.agg(F.date_sub(F.max("session"), 40)).scalar()))


@query("read_monthly_wide", "SELECT series_id, month, round(value * CASE WHEN series_id = '1-URGENT' THEN 1000 ELSE 1 END, 2) AS value FROM v_series")
def read_monthly_wide(v):
    months = {f"m{i:02d}": i for i in range(1, 13)}
    wide = v.series.withColumn(
        "_m", F.date_format("month", "'m'MM")).groupBy("series_id", F.year("month").alias("year")).pivot("_m", list(months)).agg(F.max("value"))
    wide = wide.withColumn("unit", F.when(F.col("series_id") == "1-URGENT", "Thousand dollar").otherwise("Dollar"))
    return rounded(P.unpivot_months(wide, "series_id", months, "unit"), 2)


def _rows(v, *fields):
    """All rows of a series as one JSON answer; a monthly series has a few hundred rows."""
    rows = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")))
    return rows.alias("payload")


@query("ingest_stat_json", "SELECT series_id, month, round(value * 1000, 2) AS value FROM v_series WHERE month(month) <> 5")
def ingest_stat_json(v):
    m = v.series
    f = m.select("series_id", F.date_format("month", "yyyyMM").alias("period"), F.when(F.month("month") == 5, ".").otherwise(F.format_number("value", 2)).alias("value"),
                 F.lit("Thousand Dollar").alias("unit"), F.lit("M").alias("kind"))
    yearly = m.groupBy("series_id", F.year("month").alias("y")).agg(F.sum("value").alias("s")).select(
        "series_id", F.concat(F.col("y").cast("string"), F.lit("12")).alias("period"), F.format_number("s", 2).alias("value"), F.lit("Thousand Dollar").alias("unit"), F.lit("Y").alias("kind"))
    landed = f.unionByName(yearly).groupBy("series_id").agg(_rows(v, "period", "value", "unit", "kind"))
    return rounded(P.stat_json(landed, unit="unit", kind="kind", keep="series_id"), 2)


@query("ingest_stat_csv", "SELECT series_id AS REF_AREA, month, value FROM v_series WHERE series_id = '2-HIGH' AND month(month) <> 2")
def ingest_stat_csv(v):
    f = v.series.select(F.col("series_id").alias("REF_AREA"), F.date_format("month", "yyyy-MM").alias("TIME_PERIOD"),
                        F.when(F.month("month") == 2, "NA").otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("OBS_VALUE"), F.lit(2).alias("row_no"))
    older = f.withColumn("OBS_VALUE", F.when(F.col("OBS_VALUE") != "NA", "1.0").otherwise("NA")).withColumn("row_no", F.lit(1))
    return P.stat_csv(older.unionByName(f), "2-HIGH")


@query("ingest_trade_xml", "SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(round(o_totalprice, 2)), 2) AS value, CAST(sum(o_custkey) FILTER (o_orderstatus = 'F') AS DOUBLE) AS weight FROM orders GROUP BY ALL")
def ingest_trade_xml(v):
    tag = lambda t, x: F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>"))
    xml = lambda period: F.concat(F.lit("<item>"), tag("year", period), tag("hsCd", F.col("o_orderkey").cast("string")), tag("expDlr", F.format_number("o_totalprice", 2)),
                                  F.when(F.col("o_orderstatus") == "F", tag("expWgt", F.col("o_custkey").cast("string"))).otherwise(""), F.lit("</item>"))
    o = v.orders.select(F.col("o_orderpriority").alias("series_id"), F.explode(F.array(
        xml(F.date_format("o_orderdate", "yyyy.MM")), xml(F.date_format("o_orderdate", "yyyy")))).alias("item"))
    return rounded(P.trade_xml(o, keep="series_id"), 2)


@query("ingest_trade_flash_xml", f"WITH {_flash} SELECT series_id, month, days, value, CASE WHEN days < 31 THEN round(value * 2, 2) END AS total FROM fl")
def ingest_trade_flash_xml(v):
    tag = lambda t, x: F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t}>"))
    f = flash_rows(v)
    head = F.concat(F.lit("<item>"), tag("priodMon", F.date_format("month", "yyyy.MM")), tag("priodDt", F.concat(F.lit("01~"), F.col("days").cast("string"))))
    wide = F.concat(head, tag("amt00", F.format_number(F.col("value") * 2, 2)), tag("amt01", F.format_number("value", 2)), F.lit("</item>"))
    long = F.concat(head, tag("name", F.lit("chips")), tag("amount", F.format_number("value", 2)), F.lit("</item>"))
    return rounded(P.trade_flash_xml(f.select("series_id", F.when(F.col("days") < 31, wide).otherwise(long).alias("item")), keep="series_id"), 2)


@query("ingest_company_revenue", """WITH f AS (SELECT series_id, unnest([{'m': month, 'v': value}, {'m': CAST(month - INTERVAL 1 MONTH AS DATE), 'v': round(value * 0.9, 2)}, {'m': CAST(month - INTERVAL 12 MONTH AS DATE), 'v': CASE WHEN month(month) <> 4 THEN round(value * 0.8, 2) END}]) AS e FROM v_series)
 SELECT series_id, CAST(e.m + INTERVAL 30 YEAR AS DATE) AS month, count(*) AS n, round(sum(e.v), 2) AS value FROM f WHERE e.v > 0 GROUP BY ALL""")
def ingest_company_revenue(v):
    roc = F.concat((F.year("month") - 1911 + 30).cast("string"), F.date_format("month", "MM"))
    num = lambda k: F.format_number(F.round(F.col("value") * k, 2), 2)
    row = F.to_json(F.struct(roc.alias("month"), num(1.0).alias("this"), num(0.9).alias("previous"), F.when(F.month("month") == 4, "-").otherwise(num(0.8)).alias("year_ago")))
    return rounded(P.company_revenue(v.series.select("series_id", row.alias("payload")), keep="series_id").groupBy("series_id", "month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), 2)


@query("ingest_flow_feed", "SELECT instrument, session, foreign_net, inst_net, volume, round(foreign_ratio * 100, 4) AS foreign_ratio FROM v_flows WHERE day(session) <> 13")
def ingest_flow_feed(v):
    sign = lambda c: F.concat(F.when(F.col(c) > 0, "+").otherwise(""), F.format_number(c, 0))
    row = F.struct(F.date_format("session", "yyyyMMdd").alias("bizdate"), F.when(F.day("session") == 13, "").otherwise(sign("foreign_net")).alias("foreign"),
                   sign("inst_net").alias("institution"), F.format_number("volume", 0).alias("volume"), F.concat(F.format_number(F.col("foreign_ratio") * 100, 4), F.lit("%")).alias("ratio"))
    landed = v.flows.groupBy("instrument", F.trunc("session", "MM").alias("m")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    return rounded(P.flow_feed(landed, keep="instrument"), 4)


@query("ingest_html_price_table", "SELECT p_partkey, 'retail' AS item, round(p_retailprice, 2) AS value FROM part WHERE p_retailprice > 0 UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part WHERE p_size > 0")
def ingest_html_price_table(v):
    cells = lambda label, value: F.concat(F.lit(f"<tr><td class='x'><b>{label}</b>\n x</td>"), F.lit("<td>1</td>" * 4), F.lit("<td> <span>"), value, F.lit("</span></td></tr>"))
    html = F.concat(F.lit("<html><table><tbody id=\"other\"><tr><td>Retail</td></tr></tbody><tbody id=\"prices\">"), cells("Retail price", F.format_number("p_retailprice", 2)),
                    cells("Size", F.col("p_size").cast("string")), cells("Unknown", F.lit("7")), F.lit("</tbody></table></html>"))
    return rounded(P.html_price_table(v.part.select("p_partkey", html.alias("html")), "html", "prices", {"retail": "Retail", "size": "Size"}, keep="p_partkey"), 2)


@query("page_links", "SELECT page_id, i - 1 AS row, regexp_extract(r[i], 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul></nav>', 1), '(?s)<li>(.*?)</li>', 1) AS r FROM pages), LATERAL (SELECT unnest(generate_series(1, len(r))) AS i)")
def page_links(v):
    c = P.html_cells(v.pages, "html", r"(?s)<nav><ul>(.*?)</ul></nav>", r"(?s)<li>(.*?)</li>", 'href="([^"]*)"', "page_id")
    return c.select("page_id", F.col("row").cast("bigint").alias("row"), F.coalesce(F.get("cells", F.lit(0)), F.lit("")).alias("href"))


def rss_text(v):
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    stamp = F.concat(F.lit("Mon, "), F.date_format("time", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    item = F.concat(F.lit("<item><title>"), safe(F.concat("title", F.lit(" - "), "source")), F.lit("</title><source>"), safe(F.col("source")), F.lit("</source><pubDate>"),
                    F.when(F.col("doc_id") % 50 == 7, "soon").otherwise(stamp), F.lit("</pubDate><link>https://n.example.org/"), F.col("doc_id").cast("string"), F.lit("</link><news_item><news_title>a</news_title></news_item><news_item><news_title>b</news_title></news_item></item>"))
    return v.headlines.select("doc_id", item.alias("item"))


@query("ingest_rss", "SELECT doc_id, time, source, 'https://n.example.org/' || doc_id AS link, 2 AS n_news, length(trim(title)) AS title_length FROM v_heads WHERE doc_id % 50 <> 7")
def ingest_rss(v):
    r = P.rss_items(rss_text(v), keep="doc_id")
    return r.select("doc_id", "time", "source", "link", F.size("news").alias("n_news"), F.length("title").alias("title_length"))


@query("ingest_disclosures", "SELECT o_orderkey, 'buyback' AS kind, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 30 AS \"end\", round(o_totalprice, 2) AS amount, o_orderpriority AS purpose, CAST(o_orderkey AS VARCHAR) AS filing FROM orders WHERE o_custkey % 7 <> 3")
def ingest_disclosures(v):
    d = F.col("o_orderdate").cast("date")
    shape = F.when(F.col("o_custkey") % 3 == 0, F.date_format(d, "yyyyMMdd")).when(F.col("o_custkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    amount = F.format_number("o_totalprice", 2)
    row = F.to_json(F.struct(F.when(F.col("o_custkey") % 7 == 3, "-").otherwise(shape).alias("start"), F.date_format(F.date_add(d, 30), "yyyy/MM/dd").alias("end"),
                             F.when(F.col("o_custkey") % 2 == 0, " - ").otherwise(amount).alias("amount"), amount.alias("planned"),
                             F.col("o_orderpriority").alias("purpose"), F.col("o_orderkey").cast("string").alias("number")))
    return rounded(P.disclosures(v.orders.select("o_orderkey", row.alias("payload")), keep="o_orderkey"), 2)


_ytd = """qt AS (SELECT series_id, CAST(year(month) AS INT) AS year, CAST(quarter(month) AS INT) AS quarter, round(sum(value), 2) AS q FROM v_series GROUP BY ALL)"""


@query("cumulative_to_period", f"""WITH {_ytd}, k AS (SELECT *, lag(quarter) OVER (PARTITION BY series_id, year ORDER BY quarter) AS pq FROM qt WHERE NOT (quarter = 2 AND year % 2 = 0)) SELECT series_id, year, quarter, round(q, 2) AS value FROM k WHERE quarter = 1 OR pq = quarter - 1""")
def cumulative_to_period(v):
    q = v.series.groupBy("series_id", F.year("month").alias("year"), F.quarter("month").alias("quarter")).agg(F.round(F.sum("value"), 2).alias("q"))
    ytd = q.withColumn("value", F.sum("q").over(M.rows(["series_id", "year"], "quarter", None, 0)))
    return rounded(P.cumulative_to_period(ytd.filter("not (quarter = 2 and year % 2 = 0)"), "series_id"), 2)


@query("read_review_json", "SELECT session AS target_date, instrument AS stock, round(pc, 6) AS previous_close, round(close, 6) AS predicted_close, CASE WHEN close > pc THEN 'up' ELSE 'down' END AS direction FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS pc FROM v_bars) WHERE pc IS NOT NULL AND day(session) NOT IN (7, 8)")
def read_review_json(v):
    pc = F.lag("close").over(M.series("instrument", "session"))
    b = v.bars.withColumn("pc", pc).filter("pc is not null")
    val = F.struct(F.col("pc").alias("previous_close"), F.col("close").alias("predicted_close"), F.when(F.col("close") > F.col("pc"), "up").otherwise("down").alias("direction"))
    days = b.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("instrument", val))).alias("stocks"))
    doc = lambda version, at, stocks: F.to_json(F.struct(version.alias("schema_version"), F.col("session").alias("target_date"), F.lit(at).alias("created_at"), stocks.alias("stocks")))
    none = F.create_map().cast("map<string,struct<previous_close:double,predicted_close:double,direction:string>>")
    version = F.when(F.day("session") == 7, 9).otherwise(1)
    good = days.select(F.when(F.day("session") == 8, "{broken").otherwise(doc(version, "b", F.col("stocks"))).alias("payload"))
    stale = days.select(doc(version, "a", none).alias("payload")).filter(F.length("payload") > 0)
    return rounded(P.review_documents(good.unionByName(stale.filter("payload not like '%\"target_date\":\"____-__-08\"%'"))))


@query("sink_snapshot_hash")
def sink_snapshot_hash(v):
    parts = {"bars": v.bars, "series": v.series, "events": v.event_days}
    out = None
    for name, df in parts.items():
        h = K.snapshot_hash(df).select(F.lit(name).alias("input"), "n", "snapshot")
        out = h if out is None else out.unionByName(h)
    return out


@query("source_priority", """WITH r AS (SELECT * FROM v_series WHERE month(month) = 1), f AS (SELECT series_id, month, value + 1 AS value FROM v_series WHERE month(month) < 7)
 SELECT series_id, month, coalesce(r.value, f.value, a.value) AS value, CASE WHEN r.value IS NOT NULL THEN 'replay' WHEN f.value IS NOT NULL THEN 'fresh' ELSE 'archive' END AS source FROM v_series2 a FULL JOIN f USING (series_id, month) FULL JOIN r USING (series_id, month)""")
def source_priority(v):
    fresh = v.series.filter("month(month) < 7").withColumn("value", F.col("value") + 1)
    return R.source_priority([("replay", v.series.filter("month(month) = 1")), ("fresh", fresh), ("archive", v.series2)], ["series_id", "month"])


@query("ingest_market_breadth", """WITH b AS (SELECT session AS date, count(*) FILTER (close > pc) AS rise, count(*) FILTER (close < pc) AS fall, count(*) FILTER (close = pc) AS steady, sum(volume) AS vol, max(high) AS hi, min(low) AS lo FROM (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS pc FROM v_thin) GROUP BY 1)
 SELECT date, rise, fall, steady, -vol AS foreign_net, vol AS personal_net, NULL::DOUBLE AS open, round(hi, 6) AS high, round(lo, 6) AS low FROM b""")
def ingest_market_breadth(v):
    pc = F.lag("close").over(M.series("instrument", "session"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = v.thin.withColumn("pc", pc).groupBy("session").agg(n(F.col("close") > F.col("pc")).alias("rise"), n(F.col("close") < F.col("pc")).alias("fall"),
                                                            n(F.col("close") == F.col("pc")).alias("steady"), F.sum("volume").alias("vol"), F.max("high").alias("hi"), F.min("low").alias("lo"))
    info = lambda code, c: F.struct(F.lit(code).alias("code"), F.format_number(c, 8).alias("value"))
    doc = F.to_json(F.struct(
        F.struct(*[F.format_number(c, 0).alias(c) for c in ("rise", "fall", "steady")]).alias("breadth"),
        F.struct(F.date_format("session", "yyyyMMdd").alias("bizdate"), F.concat(F.lit("+"), F.format_number("vol", 0)).alias("personal"), F.format_number(-F.col("vol"), 0).alias("foreign")).alias("deal"),
        F.array(info("high", "hi"), info("low", "lo")).alias("infos")))
    return rounded(P.market_overview(t.select(doc.alias("payload"))))


@query("ingest_provisional_filing", "SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN round(o_totalprice) * CASE WHEN o_custkey % 2 = 0 THEN 1e6 ELSE 1e3 END END AS amount FROM orders")
def ingest_provisional_filing(v):
    unit_text = F.when(F.col("o_custkey") % 5 == 0, "amounts below").when(F.col("o_custkey") % 2 == 0, "Unit: million won").otherwise("(Unit : thousand won)")
    body = F.concat(F.lit("<p>Report 2024</p><td>"), unit_text, F.lit("</td><p>Revenue 99</p><b>Operating&nbsp;profit</b> Q 3 <td>"),
                    F.format_number(F.round("o_totalprice"), 0), F.lit("</td><td>55</td>"))
    return v.orders.select("o_orderkey", P.provisional_amount(body, r"operating\s*profit", {"million": 1e6, "thousand": 1e3}).alias("amount"))
