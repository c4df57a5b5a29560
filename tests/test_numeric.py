"""Numbers against numpy: ranks, quantiles, ridge, volatility and autoregression, bootstrap, adaptive widths."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E
from tidemark.operators import metrics as X
from tidemark.operators import models as G
from tidemark.operators import paths as P
from tidemark.operators import ranks
from tidemark.operators import macro as M

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=int(i))


def test_ranks_hold_when_cut_points_change_between_evaluations(spark, monkeypatch):
    """Approximate percentiles depend on the order of arrival; here every evaluation draws other ones."""
    approx = F.percentile_approx
    moved = F.udf(lambda v: v + random.SystemRandom().uniform(-200, 200), "double")
    monkeypatch.setattr(ranks.F, "percentile_approx", lambda c, cuts, accuracy: approx(moved(c), cuts, accuracy))
    x = np.random.default_rng(1).permutation(2000).astype(float)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, x double").repartition(7)
    q = ranks.quantiles(df, "g", "x", {"a": 0.1, "b": 0.9}).first()
    assert (q.a, q.b) == pytest.approx((199.9, 1799.1))
    assert {r.x: r.below for r in ranks.value_ranks(df, "g", "x").collect()} == {float(i): i for i in range(2000)}


def test_quantiles_and_auc_of_a_hot_group(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=3000), 2)
    y = rng.random(3000) < 1 / (1 + np.exp(-x))
    df = spark.createDataFrame([("g", float(a), bool(b)) for a, b in zip(x, y)] + [("h", 1.0, True)], "g string, x double, y boolean")
    q = ranks.quantiles(df, "g", "x", {"a": 0.1, "b": 0.5, "c": 0.93}).filter("g = 'g'").first()
    assert (q.a, q.b, q.c) == pytest.approx(tuple(np.quantile(x, [0.1, 0.5, 0.93])))
    got = {r.g: r.auc for r in ranks.auc(df, "g", "x", "y").collect()}
    pos, neg = x[y], x[~y]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert got["g"] == pytest.approx(want) and got["h"] is None


def test_ridge_per_fold(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=(n, 2)) * [1.0, 3.0]
    y = 0.3 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=n) * 0.1
    rows = [("i", day(i), day(i + 2), float(x[i, 0]), float(x[i, 1]), float(y[i]), 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d date, m date, a double, b double, y double, s double")
    folds = spark.createDataFrame([("i", "f1", day(200), day(300)), ("i", "f2", day(300), day(400))], "k string, fold string, t0 date, t1 date")
    got = G.ridge_folds(df, folds, "k", "d", "m", ["a", "b"], "y", "s", alpha=50.0, least=10).collect()
    for start, name in ((200, "f1"), (300, "f2")):
        tr = np.arange(n)[np.arange(n) + 2 < start]
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z = (x[tr] - mu) / sd
        beta = np.linalg.solve(z.T @ z + 50 * np.eye(2), z.T @ (y[tr] - y[tr].mean()))
        want = y[tr].mean() + (x[start:start + 100] - mu) / sd @ beta
        have = [r.prediction for r in sorted((r for r in got if r.fold == name), key=lambda r: r.d)]
        assert np.allclose(have, want) and {r.n_train for r in got if r.fold == name} == {len(tr)}


def test_har_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    n, h, least = 900, 5, 300
    close = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.01))
    df = spark.createDataFrame([("i", day(i), float(c)) for i, c in enumerate(close)], "instrument string, session date, close double")
    got = {r.session: r.sigma_har for r in G.har_sigma(df, h, 60, least).collect()}
    r = np.concatenate([[np.nan], close[1:] / close[:-1] - 1])
    v = r ** 2
    roll = lambda k: np.array([np.nan if i < k - 1 else v[i - k + 1:i + 1].mean() for i in range(n)])
    sh = lambda a: np.concatenate([[np.nan], a[:-1]])
    X = np.column_stack([np.ones(n), *[np.log(np.maximum(sh(a), 1e-12)) for a in (v, roll(5), roll(22))]])
    fwd = np.array([np.sqrt(v[i:i + h].sum()) if i + h <= n else np.nan for i in range(n)])
    y, ok = np.log(np.maximum(fwd, 1e-12)), np.isfinite(X).all(1)
    beta, last, out = None, -10 ** 9, {}
    for i in range(n):
        end = i - h
        if end > least and i - last >= 60:
            use = ok[:end] & np.isfinite(y[:end])
            if use.sum() >= least:
                beta, last = np.linalg.lstsq(X[:end][use], y[:end][use], rcond=None)[0], i
        if beta is not None and ok[i]:
            out[day(i)] = float(np.exp(X[i] @ beta))
    assert set(got) == set(out) and np.allclose([got[k] for k in out], list(out.values()))


def test_ar_recursion(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=90)) + 100
    months = [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(90)]
    df = spark.createDataFrame([("s", m, float(v)) for m, v in zip(months, x)], "series_id string, month date, value double")
    got = G.ar_forecasts(df, "series_id", "month", "value", (1, 3), 2, True, 48).filter(F.col("month") == F.lit(months[80])).orderBy("horizon").collect()
    d = np.diff(x[:81])
    A = np.column_stack([np.ones(len(d) - 2), d[1:-1], d[:-2]])
    b = np.linalg.lstsq(A, d[2:], rcond=None)[0]
    near, level, path = [d[-1], d[-2]], x[80], []
    for _ in range(3):
        step = b[0] + b[1] * near[0] + b[2] * near[1]
        near, level = [step, near[0]], level + step
        path.append(level)
    assert [r.ar for r in got] == pytest.approx([path[0], path[2]]) and got[0].actual == pytest.approx(x[81])


def test_bootstrap_uses_every_block(spark):
    df = spark.createDataFrame([("g", f"b{i}", float(i)) for i in range(10)], "g string, b string, x double")
    r = E.block_bootstrap(df, "g", "b", {"x": F.col("x"), "n": F.lit(1.0)}, E.STATISTICS["mean"], 500).first()
    assert r.point == 4.5 and r.blocks == 10 and 1.5 < r.lo < 4.5 < r.hi < 7.5
    one = spark.createDataFrame([("g", "b", 2.0)], "g string, b string, x double")
    r = E.block_bootstrap(one, "g", "b", {"x": F.col("x"), "n": F.lit(1.0)}, E.STATISTICS["mean"], 50).first()
    assert (r.point, r.lo, r.hi) == (2.0, 2.0, 2.0)


def test_trailing_and_adaptive_widths(spark):
    rng = np.random.default_rng(4)
    n = 1300
    s = np.abs(rng.normal(size=n))
    df = spark.createDataFrame([("i", day(i), day(i + 4), float(v)) for i, v in enumerate(s)], "k string, made date, matures date, score double")
    avail = [max(0, i - 4) for i in range(n)]
    q = {r.made: r for r in P.trailing_q(df, "k", (250, 500)).collect()}
    for i in (50, 104, 600, 1003, 1299):
        a = avail[i]
        if a < 100:
            assert q[day(i)].quantile_250 is None
            continue
        for w in (250, 500):
            recent = np.sort(s[max(0, a - w):a])
            assert q[day(i)][f"quantile_{w}"] == pytest.approx(np.quantile(recent, 0.8))
            assert q[day(i)][f"conformal_{w}"] == recent[min(int(np.ceil((len(recent) + 1) * 0.8 - 1e-12)), len(recent)) - 1]


def adaptive(spark, values, gamma=0.1, lag=1, least=2):
    df = spark.createDataFrame([("i", day(i), day(i + lag), float(v)) for i, v in enumerate(values)], "k string, made date, matures date, score double")
    return [r.q for r in P.adaptive_q(df, "k", (gamma,), (250,), coverage=0.5, least=least).orderBy("made").collect()]


def test_adaptive_width_by_hand(spark):
    """Level 0.5; with two known scores the median is used; a hit adds 0.05 to the level, a miss takes 0.05."""
    # A forecast knows the scores that matured before its day: of 0, 0, 0+1, ... rows with a lag of one day.
    got = adaptive(spark, [1.0, 3.0, 9.0, 2.0, 2.0, 2.0])
    assert got[:3] == [None, None, None]  # 0, 0 and 1 known scores
    assert got[3] == pytest.approx(2.0)  # known 1, 3; level 0.5
    assert got[4] == pytest.approx(3.0)  # known 1, 3, 9; no forecast has been graded yet
    # The fourth score, 2.0 at a width of 2.0, was a hit: the level is 0.5 + 0.1 * 0.5, so the 0.45 quantile is used.
    assert got[5] == pytest.approx(np.quantile([1, 3, 9, 2], 0.45))


def test_adaptive_width_moves_with_misses(spark):
    """A jump of the scores widens the band until the coverage is restored, and only after scores have matured."""
    rng = np.random.default_rng(2)
    calm, wild = np.abs(rng.normal(size=300)), 4 * np.abs(rng.normal(size=300))
    x = np.concatenate([calm, wild])
    q = [np.nan if v is None else v for v in adaptive(spark, x, 0.05, 5, 50)]
    same = [np.nan if v is None else v for v in adaptive(spark, np.concatenate([calm, wild[:1] * 0, wild[1:]]), 0.05, 5, 50)]
    assert np.array_equal(q[:305], same[:305], equal_nan=True)  # a score changes nothing before it has matured
    assert np.isnan(q[:50]).all() and not np.isnan(q[60:]).any()
    assert np.mean(x[450:] <= q[450:]) == pytest.approx(0.5, abs=0.07)
    still = [v for v in adaptive(spark, x, 0.0, 5, 50)][599]
    assert still == pytest.approx(np.quantile(x[345:595], 0.5)) or still == pytest.approx(np.quantile(x[344:594], 0.5))


def test_short_phases_are_absorbed(spark):
    seq = ["a"] * 4 + ["b"] * 2 + ["a"] * 3 + ["c"] * 3 + ["b"] * 5
    df = spark.createDataFrame([("s", dt.date(2020 + i // 12, i % 12 + 1, 1), p) for i, p in enumerate(seq)], "series_id string, month date, phase string")
    got = [(r.phase, r.months, r.ongoing) for r in M.phase_episodes(df).orderBy("start").collect()]
    assert got == [("a", 9, False), ("c", 3, False), ("b", 5, True)]


@pytest.mark.parametrize("seq,want", [
    ("ab" + "c" * 5, [("c", 7)]), ("a", [("a", 1)]), ("aab", [("b", 3)]), ("aaab", [("a", 4)]), ("abbbb", [("b", 5)]),
    ("aaabbaabbb", [("a", 7), ("b", 3)]), ("aaabcbbb", [("a", 5), ("b", 3)]), ("aabbccc", [("b", 4), ("c", 3)])])
def test_phase_cases(spark, seq, want):
    df = spark.createDataFrame([("s", dt.date(2020 + i // 12, i % 12 + 1, 1), p) for i, p in enumerate(seq)], "series_id string, month date, phase string")
    got = M.phase_episodes(df).orderBy("start").collect()
    assert [(r.phase, r.months) for r in got] == want and [r.ongoing for r in got] == [False] * (len(want) - 1) + [True]


def test_auc_bootstrap_is_resampling(spark):
    """Against areas of the drawn months' rows themselves, ties and all."""
    import hashlib

    rng = np.random.default_rng(9)
    rows = [(g, f"m{b}", float(x), bool(u)) for g in "ab" for b in range(7) for x, u in zip(np.round(rng.random(30), 1), rng.random(30) < 0.4)]
    df = spark.createDataFrame(rows + [("a", "m1", None, True)], "g string, block string, x double, up boolean")
    got = {r.g: r for r in E.auc_bootstrap(df, "g", "block", "x", "up", 0.0, 1.0 + 1e-9, bins=100, draws=60).collect()}

    def area(sample):
        pos, neg = (np.array([x for _, _, x, u in sample if u == side]) for side in (True, False))
        return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))

    for g in "ab":
        own = [[r for r in rows if r[:2] == (g, f"m{b}")] for b in range(7)]
        drawn = [area([r for s in range(7) for r in own[int(hashlib.md5(f"{d}-{s}".encode()).hexdigest()[:8], 16) % 7]]) for d in range(60)]
        assert (got[g].point, got[g].lo, got[g].hi) == pytest.approx((area(sum(own, [])), *np.quantile(drawn, [0.025, 0.975]))) and got[g].blocks == 7


def test_paths_and_bands_of_two_series(spark):
    """All horizons of a VAR against the recursion at some origins, and bands that know matured errors only."""
    rng = np.random.default_rng(12)
    n, hs = 110, (1, 2, 5)
    months = [dt.date(2010 + i // 12, i % 12 + 1, 1) for i in range(n)]
    d = np.zeros((n, 2))
    for t in range(2, n):
        d[t] = [0.2, -0.1] + d[t - 1] @ [[0.4, 0.1], [0.2, 0.3]] + 0.2 * d[t - 2] + rng.normal(size=2)
    level = 100 + np.cumsum(d, axis=0)
    df = spark.createDataFrame([("s", m, float(a), float(b)) for m, (a, b) in zip(months, level)], "k string, month date, a double, b double")
    rows = G.var_paths(df, "k", "month", ["a", "b"], hs, 2, 48)
    got = {(r.month, r.horizon): r for r in G.error_bands(rows, "k", "month", "var", "actual", hs, least=10).collect()}
    dd = np.diff(level, axis=0)
    forecast = {}
    for end in range(60, n):
        use = dd[:end]
        x = np.column_stack([np.ones(len(use) - 2), use[1:-1], use[:-2]])
        beta = np.linalg.lstsq(x, use[2:], rcond=None)[0]
        r, at = [use[-1], use[-2]], level[end, 0]
        for k in range(1, max(hs) + 1):
            step = np.concatenate([[1.0], *r]) @ beta
            r, at = [step, r[0]], at + step[0]
            forecast[end, k] = at
    for (end, h), want in forecast.items():
        if h in hs:
            assert got[months[end], h].var == pytest.approx(want)
    end, h = 100, 5
    known = [got[months[s], h] for s in range(n) if (months[s], h) in got and s + h <= end]
    errors = np.array([r.var - r.actual for r in known])
    r = got[months[end], h]
    assert r.n_errors == len(errors) > 20
    assert (r.low, r.high) == pytest.approx((r.var - np.quantile(errors, 0.9), r.var - np.quantile(errors, 0.1)))
    # What happens after an origin moves nothing at it.
    moved = spark.createDataFrame([("s", m, float(a) + (50.0 if i > end else 0.0), float(b)) for i, (m, (a, b)) in enumerate(zip(months, level))], "k string, month date, a double, b double")
    again = {(q.month, q.horizon): q for q in G.error_bands(G.var_paths(moved, "k", "month", ["a", "b"], hs, 2, 48), "k", "month", "var", "actual", hs, least=10).collect()}
    q = again[months[end], h]
    assert (q.var, q.low, q.high, q.n_errors) == pytest.approx((r.var, r.low, r.high, r.n_errors))


def test_scores_beside_both_naive_forecasts(spark):
    """No change and the outcome 52 weeks earlier (at most a week more) over the rows that have one; beating zero alone is not enough."""
    rng = np.random.default_rng(4)
    y = {i: float(np.round(np.sin(i * 2 * np.pi / 364) + rng.normal() * 0.1, 6)) for i in range(800) if i % 9 not in (3, 4) and not 300 <= i < 320}
    rows = [(m, "x", day(i), v, v * k) for i, v in y.items() for m, k in (("good", 0.95), ("fair", 0.5), ("flat", 0.0))]
    rows += [("good", "y", day(0), 5.0, 1.0), ("good", "x", day(900), None, 1.0), ("fair", "x", day(300), 9.0, None), ("new", "z", day(1), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, s string, target_date date, y double, p double")
    got = {r.model: r for r in X.score_errors(df, "model", "y", "p", "s").collect()}
    known = y | {300: 9.0}
    for m in ("good", "fair", "flat"):
        mine = [(r[3], r[4], next((known[i] for i in range(n - 364, n - 372, -1) if i in known), None) if r[1] == "x" else None)
                for r in rows if r[0] == m and None not in r for n in [(r[2] - D0).days]]
        both = np.array([r for r in mine if r[2] is not None])
        want = [np.abs(both[:, 0] - both[:, 1]).mean(), np.abs(both[:, 0]).mean(), np.abs(both[:, 0] - both[:, 2]).mean()]
        g = got[m]
        assert (g.n, g.n_both, g.direction_n) == (len(mine), len(both), sum(r[1] != 0 for r in mine)) and 0 < len(both) < len(mine)
        assert (g.mae_both, g.mae_zero_both, g.mae_seasonal) == pytest.approx(want) and g.beats_both == (want[0] < min(want[1:]))
    assert [got[m].beats_both for m in ("good", "fair", "flat", "new")] == [True, False, False, None]
    assert got["fair"].beats_zero and got["new"].n_both == 0
