"""Views over the driver tables that stand in for bars, series, ledgers, hits and headlines.

``Views`` holds the Spark side; ``SQL_VIEWS`` the same definitions for the SQL check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import ledger as L
from ..tables import load

# Share of the unit interval drawn from a text key; the same digits in Spark and in the check SQL.
def unit(key) -> "F.Column":
    key = F.expr(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def sql_unit(key: str) -> str:
    return f"(('0x'||substr(md5({key}),1,8))::BIGINT / 4294967296.0::DOUBLE)"


EVENT_PRICE = 400000.0
SAME_DAY = "1998-01-01"
MODELS = ["Mean ensemble", "Ridge", "Candidate IV interval", "Candidate evening forecast"]


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Landed times carry no zone and mean UTC; casts to instants must not depend on the caller's zone.
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)

    def __getattr__(self, name):
        from ..tables import NAMES

        if name in NAMES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def ticks(self) -> DataFrame:
        """Priced trades: instrument, session, price, volume, tick (a total order inside the session)."""
        return self.lineitem.filter("l_quantity > 0").select(
            F.col("l_returnflag").alias("instrument"),
            F.col("l_shipdate").cast("date").alias("session"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("volume"),
            # One long, so that open and close stay in a hash aggregate: order, line, then a mix of the other columns.
            ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1048576 + (
                F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.round(F.col("l_extendedprice") * 100).cast("bigint")) % 1048576).alias("tick"),
            "l_partkey",
        )

    @cached_property
    def bars(self) -> DataFrame:
        return B.bars_from_ticks(self.ticks)

    @cached_property
    def thin(self) -> DataFrame:
        """Gappy bars of 25 brands."""
        brand = self.part.select("p_partkey", F.col("p_brand").alias("brand"))
        t = self.ticks.join(brand, F.col("l_partkey") == F.col("p_partkey")).withColumn("instrument", F.col("brand"))
        return B.bars_from_ticks(t)

    @cached_property
    def calendar(self) -> DataFrame:
        days = self.lineitem.filter("l_quantity > 0").select(
            F.col("l_shipdate").cast("date").alias("session")).distinct().withColumn("cal", F.lit("B1"))
        return days.withColumn("ordinal", F.row_number().over(
            Window.partitionBy("cal").orderBy("session")).cast("bigint")).select("cal", "session", "ordinal")

    @cached_property
    def series(self) -> DataFrame:
        """Monthly totals by order priority."""
        return self.orders.groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"),
        ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    @cached_property
    def series2(self) -> DataFrame:
        """The same totals over every third customer: a second, partial source."""
        return self.orders.filter("o_custkey % 3 = 0").groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"),
        ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    @cached_property
    def event_days(self) -> DataFrame:
        return self.orders.filter(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > EVENT_PRICE)
        ).select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderstatus").alias("label")).distinct()

    @cached_property
    def versions(self) -> DataFrame:
        """Revisions: key, period (month), value, observed_at; one row per observation day."""
        return self.orders.groupBy(
            (F.col("o_custkey") % 50).alias("key"),
            F.trunc(F.add_months(F.col("o_orderdate").cast("date"), -1), "MM").alias("period"),
            F.col("o_orderdate").cast("date").alias("observed_at"),
        ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))

    @cached_property
    def hits(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            "event_id",
            F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("ts"),
            F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("visitor"),
            F.col("event_type").alias("page"),
            k.alias("k"),
            F.element_at(F.array(*[F.lit(x) for x in ("KR", "US", "JP", "")]), k % 4 + 1).alias("country"),
            F.concat(F.lit("r"), (k % 7).cast("string")).alias("region"),
            F.concat(F.lit("c"), (k % 11).cast("string")).alias("city"),
            F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("https://site"), (k % 40).cast("string"),
                                                     F.lit(".example.org/p?q=1"))).alias("referrer"),
            F.element_at(F.array(*[F.lit(x) for x in AGENTS]), k % 6 + 1).alias("ua"),
            F.when(k % 3 == 0, "email").otherwise("web").alias("source"),
        )

    @cached_property
    def flows(self) -> DataFrame:
        """Signed trade volume per session, by line status and by discount."""
        q = F.col("l_quantity")
        return self.lineitem.filter("l_quantity > 0").groupBy(
            F.col("l_returnflag").alias("instrument"), F.col("l_shipdate").cast("date").alias("session")
        ).agg(
            F.sum(F.when(F.col("l_linestatus") == "F", q).otherwise(-q)).alias("foreign_net"),
            F.sum(F.when(F.col("l_discount") > 0.05, q).otherwise(-q)).alias("inst_net"),
            F.round(F.avg("l_tax"), 6).alias("foreign_ratio"),
            F.sum(q).alias("volume"),
        )

    @cached_property
    def intraday(self) -> DataFrame:
        """Five-minute bars of the event stream."""
        slot = F.window("ts", "5 minutes")["start"].cast("timestamp_ntz")
        order = F.struct("ts", "event_id")
        return (
            self.events.filter("value > 0")
            .groupBy(F.col("event_type").alias("instrument"), slot.alias("ts"))
            .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
            .withColumn("session", F.col("ts").cast("date"))
        )

    @cached_property
    def hourly(self) -> DataFrame:
        order = F.struct("ts", "event_id")
        return (
            self.events.filter("value > 0")
            .groupBy(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"))
        )

    @cached_property
    def headlines(self) -> DataFrame:
        """First line with text of each document as a title, published 20 minutes apart."""
        return self.documents.select(
            "doc_id",
            F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 20 * cast(doc_id % 2160 as int), 0)").alias("time"),
            F.get(F.filter(F.split("text", "\n", -1), lambda line: line.rlike("[^ \t\r]")), F.lit(0)).alias("title"),
            F.col("source").alias("source"),
        ).filter("title is not null")

    @cached_property
    def now(self):
        """Decision time of the ledger queries: noon of the newest session but two, so some rows are pending."""
        late = self.calendar.agg(F.max("session").alias("s")).select(
            (F.date_sub("s", 2).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(3))).alias("now"))
        return late.scalar()

    @cached_property
    def scored(self) -> DataFrame:
        return L.score_forecasts(self.ledger, self.bars, self.now)

    @cached_property
    def daily(self) -> DataFrame:
        return L.daily_comparison(self.scored, SAME_DAY)

    @cached_property
    def ledger(self) -> DataFrame:
        """Forecast ledger drawn from the bars: two runs for some dates, some late, three kinds."""
        w = Window.partitionBy("instrument").orderBy("session")
        base = (
            B.with_vol20(self.bars)
            .withColumn("as_of_date", F.lag("session").over(w))
            .withColumn("ref_close", F.lag("close").over(w))
            .withColumn("sigma", F.lag("vol20").over(w))
            .filter("sigma is not null")
            .select("instrument", F.col("session").alias("target_date"), "as_of_date", "ref_close", "sigma")
            # Two dozen forecasts grow from each row; spread the rows first.
            .repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "instrument", "target_date")
        )
        rows = (
            base.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("direction", "price", "open")])))
            .withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
            .withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
            .withColumn("key", F.concat_ws("|", "instrument", F.col("target_date").cast("string"), "kind", "model",
                                           F.col("run").cast("string")))
            .withColumn("u0", unit("concat(key, 'a')"))
            .filter("run = 0 or u0 < 0.15")
        )
        rows = rows.withColumns({f"u{i}": unit(f"concat(key, '{tag}')") for i, tag in enumerate("bcdef", 1)})
        is_dir, is_price, is_open = (F.col("kind") == k for k in ("direction", "price", "open"))
        point = F.col("ref_close") * (1 + F.col("sigma") * (F.col("u1") - 0.5))
        half = F.col("ref_close") * F.col("sigma") * (0.5 + F.col("u3"))
        hours = F.floor(F.col("u4") * 40).cast("int") - 4
        total = F.col("u1") + F.col("u2") + F.col("u3") + 0.03
        p = [(F.col(c) + 0.01) / total for c in ("u1", "u2", "u3")]
        only = lambda cond, x: F.when(cond, x)
        return rows.select(
            F.concat_ws(":", F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("-"), F.col("target_date").cast("string")),
                        "instrument", "kind", "model").alias("record_id"),
            F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("-"), F.col("target_date").cast("string")).alias("run_id"),
            (F.col("target_date").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), hours)).alias("created_at"),
            "instrument", F.col("target_date").alias("prediction_date"), "target_date", "as_of_date",
            "kind", "model",
            F.when(is_price & (F.col("u5") < 0.4), 5).otherwise(1).cast("bigint").alias("horizon_days"),
            F.when(is_dir & (F.col("u5") < 0.1), "open_to_close").otherwise("close_to_close").alias("target_mode"),
            F.when(F.col("run") == 0, "cfg-a").otherwise("cfg-b").alias("config_hash"),
            F.when(F.col("u5") > 0.95, "post_open").otherwise("pre_open").alias("information_cutoff"),
            only(is_dir, p[0]).alias("p_down"), only(is_dir, p[1]).alias("p_flat"), only(is_dir, p[2]).alias("p_up"),
            only(is_dir & (F.col("u5") < 0.97), 0.3 * F.col("sigma")).alias("band"),
            F.when(F.col("u0") < 0.99, F.col("ref_close")).alias("current_close"),
            only(~is_dir, point / F.col("ref_close") - 1).alias("predicted_return"),
            only(is_price & (F.col("u2") < 0.8), point).alias("predicted_close"),
            only(is_price, point).alias("center_close"),
            only(is_price, point - half).alias("low_close"), only(is_price, point + half).alias("high_close"),
            only(is_open & (F.col("u2") < 0.8), point).alias("predicted_open"),
            only(is_open, point).alias("center_open"),
            only(is_open, point - half).alias("low_open"), only(is_open, point + half).alias("high_open"),
            only(is_price, F.col("u1")).alias("oof_slope"),
            only(is_price, F.when(F.col("u2") < 0.3, "yes").when(F.col("u2") < 0.8, "unverified").otherwise("no")).alias("signal"),
            F.when(F.col("u3") < 0.2, "cpi").otherwise("").alias("event_flags"),
        )


AGENTS = [
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Mobile Safari",
    "Mozilla/5.0 (iPad; CPU OS 17_0) Safari",
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome",
    "Mozilla/5.0 (Linux; Android 14) Mobile Chrome",
    "",
    "Googlebot/2.1",
]

_BAR_AGGS = """arg_min(price, tick) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, tick) AS close, sum(volume) AS volume"""

SQL_VIEWS: dict[str, str] = {
    "v_ticks": """SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS session,
 l_extendedprice / l_quantity AS price, l_quantity AS volume,
 (l_orderkey * 8 + l_linenumber) * 1048576 + (l_partkey * 31 + l_suppkey * 17 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1048576 AS tick, l_partkey
 FROM lineitem WHERE l_quantity > 0""",
    "v_bars": f"SELECT instrument, session, {_BAR_AGGS} FROM v_ticks GROUP BY ALL",
    "v_thin": f"SELECT p_brand AS instrument, session, {_BAR_AGGS} FROM v_ticks JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "v_cal": """SELECT 'B1' AS cal, session, row_number() OVER (ORDER BY session) AS ordinal
 FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem WHERE l_quantity > 0)""",
    "v_series": """SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
 round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL""",
    "v_series2": """SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
 round(sum(o_totalprice), 2) AS value FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL""",
    "v_evdays": f"""SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS label FROM orders
 WHERE o_orderpriority = '1-URGENT' AND o_totalprice > {EVENT_PRICE}""",
    "v_versions": """SELECT o_custkey % 50 AS key, CAST(date_trunc('month', CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH) AS DATE) AS period,
 CAST(o_orderdate AS DATE) AS observed_at, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL""",
    "v_hits": f"""SELECT event_id, date_trunc('second', ts) AS ts, 'v' || user_id AS visitor, event_type AS page, k,
 ['KR','US','JP',''][k % 4 + 1] AS country, 'r' || (k % 7) AS region, 'c' || (k % 11) AS city,
 CASE WHEN k % 5 = 0 THEN '' ELSE 'https://site' || (k % 40) || '.example.org/p?q=1' END AS referrer,
 {AGENTS!r}[k % 6 + 1] AS ua, CASE WHEN k % 3 = 0 THEN 'email' ELSE 'web' END AS source
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "v_flows": """SELECT l_returnflag AS instrument, CAST(l_shipdate AS DATE) AS session,
 sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) AS foreign_net,
 sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE -l_quantity END) AS inst_net,
 round(avg(l_tax), 6) AS foreign_ratio, sum(l_quantity) AS volume FROM lineitem WHERE l_quantity > 0 GROUP BY ALL""",
    "v_intraday": """SELECT event_type AS instrument, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
 arg_min(value, {'a': ts0, 'b': event_id}) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, {'a': ts0, 'b': event_id}) AS close, CAST(count(*) AS DOUBLE) AS volume,
 CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS DATE) AS session
 FROM (SELECT *, ts AS ts0 FROM events WHERE value > 0) GROUP BY 1, 2, 8""",
    "v_hourly": """SELECT event_type AS instrument, date_trunc('hour', ts) AS ts,
 arg_min(value, {'a': ts0, 'b': event_id}) AS open, arg_max(value, {'a': ts0, 'b': event_id}) AS close
 FROM (SELECT *, ts AS ts0 FROM events WHERE value > 0) GROUP BY 1, 2""",
    "v_heads": """SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(20 * (doc_id % 2160)) AS time,
 title, source FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]'))[1] AS title FROM documents) WHERE title IS NOT NULL""",
    "v_vol": """SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol20
 FROM (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY session) - 1 AS ret FROM v_bars)
 WINDOW w AS (PARTITION BY instrument ORDER BY session ROWS 19 PRECEDING)""",
    "v_ledger_draws": f"""SELECT *, {sql_unit("key||'a'")} AS u0, {sql_unit("key||'b'")} AS u1, {sql_unit("key||'c'")} AS u2,
 {sql_unit("key||'d'")} AS u3, {sql_unit("key||'e'")} AS u4, {sql_unit("key||'f'")} AS u5
 FROM (SELECT *, instrument||'|'||target_date||'|'||kind||'|'||model||'|'||run AS key
  FROM (SELECT instrument, session AS target_date, lag(session) OVER w AS as_of_date, lag(close) OVER w AS ref_close,
   lag(vol20) OVER w AS sigma FROM v_vol WINDOW w AS (PARTITION BY instrument ORDER BY session))
  CROSS JOIN (SELECT unnest(['direction','price','open']) AS kind)
  CROSS JOIN (SELECT unnest({MODELS!r}) AS model)
  CROSS JOIN (SELECT unnest([0,1]) AS run) WHERE sigma IS NOT NULL)""",
    "v_ledger": """SELECT 'run'||run||'-'||target_date||':'||instrument||':'||kind||':'||model AS record_id,
 'run'||run||'-'||target_date AS run_id,
 CAST(target_date AS TIMESTAMP) - to_hours(CAST(floor(u4 * 40) AS INT) - 4) AS created_at,
 instrument, target_date AS prediction_date, target_date, as_of_date, kind, model,
 CAST(CASE WHEN kind = 'price' AND u5 < 0.4 THEN 5 ELSE 1 END AS BIGINT) AS horizon_days,
 CASE WHEN kind = 'direction' AND u5 < 0.1 THEN 'open_to_close' ELSE 'close_to_close' END AS target_mode,
 CASE WHEN run = 0 THEN 'cfg-a' ELSE 'cfg-b' END AS config_hash,
 CASE WHEN u5 > 0.95 THEN 'post_open' ELSE 'pre_open' END AS information_cutoff,
 CASE WHEN kind = 'direction' THEN (u1 + 0.01) / (u1 + u2 + u3 + 0.03) END AS p_down,
 CASE WHEN kind = 'direction' THEN (u2 + 0.01) / (u1 + u2 + u3 + 0.03) END AS p_flat,
 CASE WHEN kind = 'direction' THEN (u3 + 0.01) / (u1 + u2 + u3 + 0.03) END AS p_up,
 CASE WHEN kind = 'direction' AND u5 < 0.97 THEN 0.3 * sigma END AS band,
 CASE WHEN u0 < 0.99 THEN ref_close END AS current_close,
 CASE WHEN kind <> 'direction' THEN pt / ref_close - 1 END AS predicted_return,
 CASE WHEN kind = 'price' AND u2 < 0.8 THEN pt END AS predicted_close,
 CASE WHEN kind = 'price' THEN pt END AS center_close,
 CASE WHEN kind = 'price' THEN pt - half END AS low_close, CASE WHEN kind = 'price' THEN pt + half END AS high_close,
 CASE WHEN kind = 'open' AND u2 < 0.8 THEN pt END AS predicted_open,
 CASE WHEN kind = 'open' THEN pt END AS center_open,
 CASE WHEN kind = 'open' THEN pt - half END AS low_open, CASE WHEN kind = 'open' THEN pt + half END AS high_open,
 CASE WHEN kind = 'price' THEN u1 END AS oof_slope,
 CASE WHEN kind = 'price' THEN CASE WHEN u2 < 0.3 THEN 'yes' WHEN u2 < 0.8 THEN 'unverified' ELSE 'no' END END AS signal,
 CASE WHEN u3 < 0.2 THEN 'cpi' ELSE '' END AS event_flags
 FROM (SELECT *, ref_close * (1 + sigma * (u1 - 0.5)) AS pt, ref_close * sigma * (0.5 + u3) AS half
  FROM v_ledger_draws WHERE run = 0 OR u0 < 0.15)""",
    "v_now": "SELECT CAST(max(session) - 2 AS TIMESTAMP) + INTERVAL 3 HOUR AS now FROM v_cal",
    "v_pro": """SELECT *, coalesce(created_at < CASE WHEN information_cutoff = 'post_open' THEN CAST(target_date AS TIMESTAMP) + INTERVAL 390 MINUTE
  WHEN target_mode = 'open_to_close' THEN CAST(prediction_date AS TIMESTAMP) + INTERVAL 5 MINUTE ELSE CAST(prediction_date AS TIMESTAMP) END, false) AS is_prospective FROM v_ledger""",
    "v_graded": """SELECT l.*, t.open AS o, t.close AS c, b.close AS base_adj, CASE WHEN kind = 'open' THEN t.open ELSE t.close END AS act,
  kind IN ('open', 'price') AS priced FROM v_pro l LEFT JOIN v_bars t ON l.instrument = t.instrument AND l.target_date = t.session
  LEFT JOIN v_bars b ON l.instrument = b.instrument AND l.as_of_date = b.session""",
    "v_status": """SELECT *, CASE WHEN (SELECT now FROM v_now) < CAST(target_date AS TIMESTAMP) + CASE WHEN kind = 'open' THEN INTERVAL 5 MINUTE ELSE INTERVAL 400 MINUTE END THEN 'pending'
  WHEN NOT coalesce(act > 0, false) THEN 'missing_actual' WHEN priced THEN CASE WHEN coalesce(current_close > 0, false) THEN 'scored' ELSE 'missing_reference' END
  WHEN target_mode = 'close_to_close' AND NOT coalesce(base_adj > 0, false) THEN 'missing_reference' WHEN band IS NULL OR band < 0 THEN 'missing_band' ELSE 'scored' END AS status FROM v_graded""",
    "v_scored0": """SELECT *, CASE WHEN status = 'scored' THEN CASE WHEN priced THEN act / current_close - 1 WHEN target_mode = 'open_to_close' THEN c / o - 1 ELSE c / base_adj - 1 END END AS actual_return,
  CASE WHEN status IN ('scored', 'missing_reference', 'missing_band') THEN o END AS actual_open, CASE WHEN status IN ('scored', 'missing_reference', 'missing_band') THEN c END AS actual_close,
  CASE WHEN status = 'scored' AND priced THEN coalesce(predicted_open, predicted_close) - act END AS price_error,
  CASE WHEN status = 'scored' AND priced THEN coalesce(center_open, center_close) - act END AS center_price_error,
  CASE WHEN status = 'scored' AND priced THEN CAST(coalesce(low_open, low_close) <= act AND act <= coalesce(high_open, high_close) AS DOUBLE) END AS interval_hit FROM v_status""",
    "v_scored1": """SELECT *, abs(price_error) AS absolute_price_error, abs(price_error) / act AS price_ape, CASE WHEN priced THEN predicted_return - actual_return END AS return_error,
  CASE WHEN status = 'scored' AND NOT priced THEN CASE WHEN actual_return < -band THEN 0 WHEN actual_return > band THEN 2 ELSE 1 END END AS actual_class FROM v_scored0""",
    "v_scored": """SELECT * EXCLUDE (o, c, base_adj, act, priced), CASE WHEN actual_class IS NOT NULL THEN CAST(actual_class = CASE WHEN p_down >= p_flat AND p_down >= p_up THEN 0 WHEN p_flat >= p_up THEN 1 ELSE 2 END AS DOUBLE) END AS direction_correct,
  CASE WHEN actual_class IS NOT NULL THEN -ln(greatest([p_down, p_flat, p_up][actual_class + 1] / (p_down + p_flat + p_up), 1e-7)) END AS log_loss,
  CASE WHEN actual_class IS NOT NULL THEN pow(p_down / (p_down + p_flat + p_up) - CAST(actual_class = 0 AS INT), 2) + pow(p_flat / (p_down + p_flat + p_up) - CAST(actual_class = 1 AS INT), 2)
   + pow(p_up / (p_down + p_flat + p_up) - CAST(actual_class = 2 AS INT), 2) END AS brier FROM v_scored1""",
    "v_ranked": f"""SELECT *, CASE WHEN prediction_date >= DATE '{SAME_DAY}' AND NOT starts_with(model, 'Candidate evening') AND CAST(created_at + INTERVAL 9 HOUR AS DATE) = prediction_date THEN 0 ELSE 1 END AS same_day FROM v_scored""",
    "v_daily": """SELECT * EXCLUDE (same_day) FROM v_ranked WHERE is_prospective
  QUALIFY row_number() OVER (PARTITION BY instrument, target_date, model, kind, horizon_days, target_mode ORDER BY same_day, created_at, record_id) = 1""",
}
