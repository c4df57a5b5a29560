"""Landed answers of statistics, trade, filing and news services, parsed column by column.

Each function takes a DataFrame with one answer, row or page per row and returns typed rows. Field names are
parameters, so one parser serves services that differ only in naming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_class
from ..operators.checks import month_of, number_of
from ..operators.frames import col, names

# Unit text (lower case, no blanks) to multiplier.
UNITS = {"dollar": 1.0, "usd": 1.0, "thousanddollar": 1e3, "milliondollar": 1e6, "hundredmilliondollar": 1e8}


def unit_factor(unit, units=UNITS) -> Column:
    """Multiplier of a unit text; an unknown unit is missing, never one."""
    u = F.lower(F.regexp_replace(col(unit), r"\s", ""))
    return F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[u]


def _texts(fields) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def json_rows(df: DataFrame, payload: str, path: str, fields, keep=()) -> DataFrame:
    """The row array of a JSON answer as text columns."""
    rows = F.from_json(F.get_json_object(payload, path), T.ArrayType(_texts(fields)))
    return df.select(*names(keep), F.explode(rows).alias("_r")).select(*names(keep), "_r.*")


def stat_json(df: DataFrame, payload="payload", path="$.rows", period="period", value="value", unit=None, kind=None, keep=()) -> DataFrame:
    """(month, value): separators removed, '.' missing, other period types dropped, scaled by the unit text."""
    fields = [period, value] + [f for f in (unit, kind) if f]
    r = json_rows(df, payload, path, fields, keep)
    if kind:
        r = r.filter(F.coalesce(F.col(kind), F.lit("M")) == "M")
    v = number_of(value) * unit_factor(unit) if unit else number_of(value)
    return r.select(*names(keep), month_of(period).alias("month"), v.alias("value")).dropna(subset=["month", "value"])


def stat_csv(df: DataFrame, area: str | None = None) -> DataFrame:
    """Labelled statistics CSV: one area, period and value; the last row of a period wins by row number."""
    f = df.filter(F.col("REF_AREA") == area) if area else df
    f = f.select("REF_AREA", month_of("TIME_PERIOD").alias("month"), F.col("OBS_VALUE").try_cast("double").alias("value"), "row_no")
    return f.dropna(subset=["month", "value"]).groupBy("REF_AREA", "month").agg(F.max_by("value", "row_no").alias("value"))


def trade_xml(df: DataFrame, item="item", keep=()) -> DataFrame:
    """Trade items <item>: only YYYY.MM periods, codes of a month summed, weight missing when no code has one."""
    x = F.from_xml(item, _texts(["year", "expDlr", "expWgt", "hsCd"]))
    r = df.select(*names(keep), x.alias("x")).select(*names(keep), "x.*").filter(F.col("year").rlike(r"^\d{4}[.\-/]\d{2}$"))
    return r.select(*names(keep), month_of("year").alias("month"), number_of("expDlr").alias("value"), number_of("expWgt").alias("weight")).filter(
        "value is not null").groupBy(*names(keep), "month").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight"))


def trade_flash_xml(df: DataFrame, item="item", keep=(), wanted="chips") -> DataFrame:
    """Ten-day trade items, wide (total and item amounts) or long (one item per row), to (month, days, value, total)."""
    x = F.from_xml(item, _texts(["priodMon", "priodDt", "amt00", "amt01", "name", "amount"]))
    r = df.select(*names(keep), x.alias("x")).select(*names(keep), "x.*")
    day = F.regexp_extract("priodDt", r"(\d+)$", 1).try_cast("int")
    value = F.coalesce(number_of("amt01"), F.when(F.col("name") == wanted, number_of("amount")))
    return r.select(*names(keep), month_of("priodMon").alias("month"), day.alias("days"), value.alias("value"), number_of("amt00").alias("total")).dropna(subset=["month", "days", "value"])


def company_revenue(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    """One filing row to three months (this, previous, a year ago); the year counts from 1911."""
    x = F.from_json(payload, _texts(["month", "this", "previous", "year_ago"]))
    r = df.select(*names(keep), x.alias("x")).select(*names(keep), "x.*")
    digits = F.regexp_replace("month", "[^0-9]", "")
    size = F.length(digits)
    year = F.expr("try_cast(left(_d, length(_d) - 2) as int)") + 1911
    r = r.withColumn("_d", digits).filter(size.isin(5, 6)).withColumn("_m", F.make_date(year, F.right("_d", F.lit(2)).cast("int"), F.lit(1)))
    three = F.array(*[F.struct(F.add_months("_m", k).alias("month"), number_of(c).alias("value")) for c, k in (("this", 0), ("previous", -1), ("year_ago", -12))])
    return r.select(*names(keep), F.explode(three).alias("e")).select(*names(keep), "e.*").filter("value > 0")


def flow_feed(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    """Net-buy rows with separators, plus signs and percent marks; rows without date or foreign net are dropped."""
    r = json_rows(df, payload, "$", ["bizdate", "foreign", "institution", "volume", "ratio"], keep)
    iso = F.regexp_replace("bizdate", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    return r.select(*names(keep), iso.alias("session"), number_of("foreign").alias("foreign_net"), number_of("institution").alias("inst_net"),
                    number_of("volume").alias("volume"), number_of("ratio").alias("foreign_ratio")).dropna(subset=["session", "foreign_net"])


def html_cells(df: DataFrame, html: str, block: str, row: str, cell: str, keep=()) -> DataFrame:
    """Rows and cells of one block of a page by position: (row, cells)."""
    rows = F.regexp_extract_all(F.regexp_extract(html, block, 1), F.lit(row), 1)
    f = df.select(*names(keep), F.posexplode(rows).alias("row", "_h"))
    return f.select(*names(keep), "row", F.regexp_extract_all("_h", F.lit(cell), 1).alias("cells"))


def html_price_table(df: DataFrame, html: str, table_id: str, labels: dict[str, str], column: int = 5, keep=()) -> DataFrame:
    """Price of each wanted item from the table body with this id: label starts with the item, value in ``column``."""
    c = html_cells(df, html, rf'(?s)<tbody id="{table_id}">(.*?)</tbody>', r"(?s)<tr>(.*?)</tr>", r"(?s)<td[^>]*>(.*?)</td>", keep)
    plain = lambda e: F.trim(F.regexp_replace(F.regexp_replace(e, "<[^>]+>", " "), r"\s+", " "))
    c = c.filter(F.size("cells") > column).withColumn("label", plain(F.get("cells", F.lit(0)))).withColumn("value", number_of(plain(F.get("cells", F.lit(column)))))
    which = F
    for key, start in labels.items():
        which = which.when(F.col("label").startswith(start), key)
    return c.withColumn("item", which).filter("item is not null and value > 0").select(*names(keep), "item", "value")


def rss_items(df: DataFrame, item="item", keep=()) -> DataFrame:
    """News items: readable time (UTC), title without the trailing source, source, link, nested related news."""
    related = T.ArrayType(_texts(["news_title", "news_source", "news_url"]))
    schema = T.StructType([*_texts(["title", "source", "pubDate", "link"]).fields, T.StructField("news_item", related)])
    r = df.select(*names(keep), F.from_xml(item, schema).alias("x")).select(*names(keep), "x.*")
    stamp = F.regexp_replace(F.regexp_replace("pubDate", r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|\+0000)$", "")
    when = F.try_to_timestamp(stamp, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    tail = F.concat(F.lit(" - "), F.col("source"))
    title = F.when(F.col("title").endswith(tail), F.expr("left(title, length(title) - length(source) - 3)")).otherwise(F.col("title"))
    return r.select(*names(keep), when.alias("time"), F.trim(title).alias("title"), F.trim("source").alias("source"), F.trim("link").alias("link"),
                    F.coalesce(F.col("news_item"), F.array().cast(related)).alias("news")).filter("time is not null and title <> ''")


def disclosures(df: DataFrame, payload="payload", kind="buyback", start="start", end="end", amounts=("amount", "planned"), keep=()) -> DataFrame:
    """Filing periods: dates in several shapes, the first amount that is not blank or '-'; unreadable dates drop the row."""
    r = df.select(*names(keep), F.from_json(payload, _texts([start, end, "purpose", "number", *amounts])).alias("x")).select(*names(keep), "x.*")
    d = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"[^0-9]", ""), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    amount = F.coalesce(*[F.nullif(F.nullif(F.trim(a), F.lit("-")), F.lit("")) for a in amounts])
    return r.select(*names(keep), F.lit(kind).alias("kind"), d(start).alias("start"), d(end).alias("end"), number_of(amount).alias("amount"),
                    F.trim("purpose").alias("purpose"), F.col("number").alias("filing")).dropna(subset=["start", "end"])


def cumulative_to_period(df: DataFrame, by, year="year", quarter="quarter", value="value") -> DataFrame:
    """Year-to-date values to single quarters; a quarter whose predecessor is missing gives nothing."""
    from ..operators.frames import prev

    key = [*names(by), year]
    before, q0 = prev(value, key, quarter), prev(quarter, key, quarter)
    single = F.when(F.col(quarter) == 1, F.col(value)).when(q0 == F.col(quarter) - 1, F.col(value) - before)
    return df.select(*names(by), year, quarter, single.alias("value")).filter(F.col("value").isNotNull())


def review_documents(df: DataFrame, payload="payload", version: int = 1) -> DataFrame:
    """One row per day and stock of nested daily documents; broken ones and other versions are skipped, the last copy of a day wins."""
    stock = T.StructType([T.StructField("previous_close", T.DoubleType()), T.StructField("predicted_close", T.DoubleType()), T.StructField("direction", T.StringType())])
    schema = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("target_date", T.DateType()),
                           T.StructField("created_at", T.StringType()), T.StructField("stocks", T.MapType(T.StringType(), stock))])
    r = df.select(F.from_json(payload, schema).alias("x")).select("x.*").filter((F.col("schema_version") == version) & F.col("target_date").isNotNull())
    last = r.groupBy("target_date").agg(F.max_by("stocks", "created_at").alias("stocks"))
    return last.select("target_date", F.explode("stocks").alias("stock", "v")).select("target_date", "stock", "v.*")


def market_overview(df: DataFrame, payload="payload", keep=()) -> DataFrame:
    """Index overview to counts, net buys and prices; prices sit in a list of code and value."""
    schema = T.StructType([
        T.StructField("breadth", _texts(["rise", "fall", "steady"])), T.StructField("deal", _texts(["bizdate", "personal", "foreign"])),
        T.StructField("infos", T.ArrayType(_texts(["code", "value"])))])
    r = df.select(*names(keep), F.from_json(payload, schema).alias("x")).withColumn("p", F.map_from_entries(F.expr("transform(x.infos, i -> struct(i.code, i.value))")))
    count = lambda c: number_of(F.col(f"x.breadth.{c}")).cast("bigint").alias(c)
    day = F.regexp_replace("x.deal.bizdate", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3").try_cast("date")
    price = lambda c: number_of(F.try_element_at("p", F.lit(c))).alias(c)
    return r.select(*names(keep), day.alias("date"), count("rise"), count("fall"), count("steady"), number_of(F.col("x.deal.foreign")).alias("foreign_net"),
                    number_of(F.col("x.deal.personal")).alias("personal_net"), price("open"), price("high"), price("low")).dropna(subset=["date", "rise", "fall"])


def provisional_amount(t: Column, item: str, units: dict[str, float], reach: int = 400, least: float = 10.0) -> Column:
    """First number of at least ``least`` after the item name, times the unit the text declares; no unit, no value."""
    plain = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "&nbsp;", " ")
    factor = F
    for name, k in units.items():
        factor = factor.when(plain.rlike(rf"(?i)unit\s*[:(]?\s*{name}"), k)
    after = F.regexp_extract(plain, rf"(?is){item}(.{{0,{reach}}})", 1)
    numbers = F.transform(F.regexp_extract_all(after, F.lit(r"(-?[\d,]{2,})"), 1), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.get(F.filter(numbers, lambda x: F.abs(x) >= least), F.lit(0)) * factor


def unpivot_months(wide: DataFrame, keys, months: dict[str, int], factor=None, value="value") -> DataFrame:
    """Months as columns to (month, value) rows; ``months`` maps a column to its month number, ``year`` gives the year."""
    long = wide.unpivot([*names(keys), "year", *([factor] if factor else [])], list(months), "_m", value)
    number = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])[F.col("_m")]
    v = F.col(value) * unit_factor(factor) if factor else F.col(value)
    return long.select(*names(keys), F.make_date("year", number, F.lit(1)).alias("month"), v.alias(value)).filter(F.col(value).isNotNull())


classify = first_class
