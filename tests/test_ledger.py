"""Ledger invariants: deadlines, statuses, first forecast kept, scores never undone, merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators.joins import append_first

D1, D2, D3 = dt.date(2024, 1, 2), dt.date(2024, 1, 3), dt.date(2024, 1, 4)
SCHEMA = """record_id string, run_id string, created_at timestamp_ntz, instrument string, prediction_date date, target_date date, as_of_date date,
 kind string, model string, horizon_days bigint, target_mode string, config_hash string, information_cutoff string, p_down double, p_flat double, p_up double,
 band double, current_close double, predicted_return double, predicted_close double, center_close double, low_close double, high_close double,
 predicted_open double, center_open double, low_open double, high_open double, signal string, event_flags string"""


def row(i, created, kind="direction", **kw):
    base = dict(record_id=i, run_id="r", created_at=created, instrument="x", prediction_date=D2, target_date=D2, as_of_date=D1, kind=kind, model="m", horizon_days=1,
                target_mode="close_to_close", config_hash="c", information_cutoff="pre_open", p_down=0.2, p_flat=0.3, p_up=0.5, band=0.01, current_close=100.0, event_flags="")
    base.update(kw)
    return base


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([("x", D1, 99.0, 100.0), ("x", D2, 101.0, 103.0)], "instrument string, session date, open double, close double")


def frame(spark, rows):
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(n.strip()) for n in names) for r in rows], SCHEMA)


NOW = dt.datetime(2024, 1, 3, 12)


def test_deadline_and_status(spark, bars):
    early, late = dt.datetime(2024, 1, 2, 23, 59), dt.datetime(2024, 1, 3, 0, 0)
    rows = [row("a", early), row("b", late), row("c", late, information_cutoff="post_open"), row("d", early, band=None), row("e", early, target_date=D3),
            row("f", early, kind="price", current_close=None), row("g", early, target_mode="open_to_close"), row("h", early, as_of_date=dt.date(2023, 12, 1)),
            row("i", early, kind="price", predicted_close=104.0, low_close=90.0, high_close=102.0, predicted_return=0.04), row("j", early, target_mode="other")]
    got = {r.record_id: r for r in L.score_forecasts(frame(spark, rows), bars, F.lit(NOW)).collect()}
    assert [got[k].is_prospective for k in "abc"] == [True, False, True]
    assert {k: got[k].status for k in "adefghij"} == {
        "a": "scored", "d": "missing_band", "e": "pending", "f": "missing_reference", "g": "scored", "h": "missing_reference", "i": "scored", "j": "invalid_target_mode"}
    assert got["a"].actual_class == 2 and got["a"].direction_correct == 1.0
    assert got["g"].actual_return == pytest.approx(103 / 101 - 1)
    assert got["i"].interval_hit == 0.0 and got["i"].price_error == pytest.approx(1.0)


def test_same_day_forecast_wins_after_the_change(spark):
    day = dt.date(2026, 9, 28)
    mk = lambda i, at, d: row(i, at, prediction_date=d, target_date=d)
    old = dt.date(2026, 9, 24)
    rows = [mk("holiday", dt.datetime(2026, 9, 25, 20), day), mk("own", dt.datetime(2026, 9, 27, 22), day),
            mk("first", dt.datetime(2026, 9, 22, 20), old), mk("second", dt.datetime(2026, 9, 23, 22), old)]
    f = L.prospective(frame(spark, rows))
    assert {r.record_id for r in L.daily_comparison(f).collect()} == {"own", "first"}


def test_scores_never_go_backwards(spark, bars):
    led = frame(spark, [row("a", dt.datetime(2024, 1, 2, 20))])
    t0, t1 = F.lit(dt.datetime(2024, 1, 3, 8)).cast("timestamp_ntz"), F.lit(dt.datetime(2024, 1, 4, 8)).cast("timestamp_ntz")
    first = L.score_forecasts(led, bars, F.lit(NOW)).withColumn("scored_at", t0)
    gone = L.score_forecasts(led, bars.filter(F.col("session") < F.lit(D2)), F.lit(NOW))
    kept = L.rescore(first, gone, t1).first()
    assert kept.status == "scored" and kept.scored_at == dt.datetime(2024, 1, 3, 8) and kept.actual_close == 103.0
    same = L.rescore(first, L.score_forecasts(led, bars, F.lit(NOW)), t1).first()
    assert same.scored_at == dt.datetime(2024, 1, 3, 8)
    moved = L.rescore(first, L.score_forecasts(led, bars.withColumn("close", F.col("close") + 1), F.lit(NOW)), t1).first()
    assert moved.scored_at == dt.datetime(2024, 1, 4, 8)


def test_append_keeps_the_first_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "record_id string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "record_id string, v int")
    add = append_first(old, new, "record_id", ["v"])
    assert [tuple(r) for r in add.collect()] == [("b", 2)]
    assert append_first(old.union(add), new, "record_id", ["v"]).count() == 0


def test_empty_ledger_keeps_columns(spark, bars):
    s = L.ledger_summary(L.daily_comparison(L.score_forecasts(frame(spark, []), bars, F.lit(NOW))))
    assert s.count() == 0 and "mean_log_loss" in s.columns


def test_sink_keeps_unscored_rows_due(spark, tmp_path):
    """A bar that lands before the deadline clock, or before its reference bar, is graded with a later batch."""
    from tidemark.streaming.marts import scores_sink

    path, landed, clock = str(tmp_path / "scores"), [], []
    schema = "instrument string, session date, open double, close double"
    early = dt.datetime(2024, 1, 1, 12)
    rows = [row("wait", early), row("ref", early, as_of_date=dt.date(2023, 12, 29)), row("other", early, instrument="y"), row("later", early, target_date=D3)]
    sink = scores_sink(path, frame(spark, rows), lambda: spark.createDataFrame(landed, schema), lambda: F.lit(clock[-1]))

    def batch(number, bars, now):
        landed.extend(bars)
        clock.append(now)
        sink(spark.createDataFrame(bars, schema), number)
        return sorted((r.record_id, r.batch) for r in spark.read.parquet(path).collect())

    assert batch(0, [("x", D1, 99.0, 100.0), ("x", D2, 101.0, 103.0)], dt.datetime(2024, 1, 1)) == []
    assert batch(1, [("x", D3, 102.0, 104.0)], NOW) == [("wait", 1)]
    assert batch(2, [("x", dt.date(2023, 12, 29), 98.0, 99.0)], dt.datetime(2024, 1, 8)) == [("later", 2), ("ref", 2), ("wait", 1)]


def test_loader_failures_are_not_swallowed(spark, tmp_path):
    from tidemark.sources import readers as R

    archive = spark.createDataFrame([("s", D1, 1.0)], "series_id string, month date, value double")

    def fails(error):
        def load():
            raise error
        return load

    for error in (FileNotFoundError("x"), ConnectionError("x")):
        assert R.load_series(fails(error), archive, ["series_id", "month"]).first().source == "archive"
    assert R.load_series(lambda: spark.read.parquet(str(tmp_path / "none")), archive, ["series_id", "month"]).count() == 1
    with pytest.raises(PermissionError):
        R.load_series(fails(PermissionError("x")), archive, ["series_id", "month"])
