"""File readers, writers and payload edge cases."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import text, web
from tidemark.sources import payloads as P
from tidemark.sources import readers as R
from tidemark.sources import sinks as K


def test_xml_items_keep_periods_as_text(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item><year>2026.06</year><expDlr>1,000</expDlr></item><item><year>2026</year><expDlr>9</expDlr></item></r>")
    df = R.read_xml_items(spark, str(tmp_path / "a.xml"), ["year", "expDlr"])
    assert sorted((r.year, r.expDlr) for r in df.collect()) == [("2026", "9"), ("2026.06", "1,000")]


def test_bars_parquet_before_csv(spark, tmp_path):
    row = [(dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 1.5, 10.0, "x", "unadjusted")]
    spark.createDataFrame(row, R.BARS).write.parquet(str(tmp_path / "p.parquet"))
    assert R.read_bars(spark, str(tmp_path)).count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "b.csv").write_text("date,open,high,low,close,adj_close,volume,instrument,adjustment\n2024-01-02,1,2,0.5,1.5,1.5,10,x,unadjusted\n")
    assert R.read_bars(spark, str(tmp_path / "c")).first().close == 1.5


def test_unknown_unit_is_missing(spark):
    df = spark.createDataFrame([('{"rows":[{"period":"202401","value":"1,5","unit":"box"}]}',)], "payload string")
    assert P.stat_json(df, unit="unit").count() == 0


def test_provisional_amount_needs_a_unit(spark):
    df = spark.createDataFrame([("operating profit 2 1,234",), ("unit: million operating profit 2 1,234",)], "t string")
    got = [r[0] for r in df.select(P.provisional_amount(F.col("t"), r"operating\s*profit", {"million": 1e6})).collect()]
    assert got == [None, 1234e6]


def test_append_ledger_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "l")
    new = K.content_id(spark.createDataFrame([(None, 1, "2024-01"), ("b", 2, "2024-02")], "record_id string, v int, target_month string"))
    K.append_ledger(new, path, new.limit(0))
    K.append_ledger(new, path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 2


def test_snapshot_hash_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    h = lambda d: K.snapshot_hash(d).first().snapshot
    assert h(a) == h(a.orderBy(F.col("a").desc())) != h(a.distinct()) != h(a.withColumn("a", F.col("a") + 1))


def test_secrets_and_attribution(spark):
    df = spark.createDataFrame([("see https://a.b/c?x=1 and key=abc&y",), ("my password is",)], "t string")
    got = [r[0] for r in df.select(text.mask_secrets(F.col("t"))).collect()]
    assert got == ["see <url> and <masked>&y", "<withheld>"]
    base = "https://x.org/p?utm_source=email&utm_medium=report&edition_day={}&edition_phase=pre_open"
    urls = spark.createDataFrame([(base.format("2024-02-29"),), (base.format("2023-02-29"),), (base.format("2024-02-29") + "&edition_day=2024-01-01",)], "u string")
    d, p = web.email_attribution(F.col("u"))
    assert [tuple(r) for r in urls.select(d, p).collect()] == [("2024-02-29", "pre_open"), (None, None), (None, None)]
