"""Change the future and the past must not move."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B

CUT = dt.date(2023, 9, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(0)
    rows, d = [], dt.date(2022, 6, 1)
    price = 100.0
    while len(rows) < 420:
        if d.weekday() < 5:
            o = price * (1 + rng.gauss(0, 0.01))
            price = o * (1 + rng.gauss(0, 0.02))
            rows.append(("x", d, o, max(o, price) * 1.01, min(o, price) * 0.99, price, float(rng.randint(100, 999))))
        d += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "instrument string, session date, open double, high double, low double, close double, volume double")


FEATURES = [B.instrument_features, B.gap_group_features, B.causal_channels, B.cum_leg_features, B.chart_signals, B.rolling_position,
            B.moving_average_touch, B.wave_signal, lambda b: B.expanding_z(B.with_vol20(b), "ret")]


@pytest.mark.parametrize("feature", FEATURES, ids=lambda f: f.__name__)
def test_future_does_not_reach_back(bars, feature):
    after = F.col("session") >= F.lit(CUT)
    moved = bars.withColumns({c: F.when(after, F.col(c) * 3).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    before = lambda df: sorted((tuple(r) for r in feature(df).filter(F.col("session") < F.lit(CUT)).collect()), key=repr)
    a, b = before(bars), before(moved)
    assert a and a == b


def test_legs_compose(bars):
    f = B.returns_and_legs(bars).dropna()
    worst = f.agg(F.max(F.abs((1 + F.col("gap")) * (1 + F.col("intraday")) - 1 - F.col("ret")))).first()[0]
    assert worst < 1e-12


def test_log_legs_telescope(bars):
    h = 5
    s = B.leg_label_sums(bars, h).dropna()
    t = B.horizon_target(bars, h).select("instrument", F.col("prediction_date").alias("session"), "future_return")
    worst = s.join(t, ["instrument", "session"]).agg(F.max(F.abs(F.col("log_overnight") + F.col("log_intraday") - F.ln(1 + F.col("future_return"))))).first()[0]
    assert worst < 1e-12
