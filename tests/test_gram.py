"""Moment algebra against refits on the rows themselves."""

import datetime as dt
import itertools

import numpy as np
import pytest
from dateutil.relativedelta import relativedelta
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import gram as H

D0 = dt.date(2018, 1, 1)
X = ["a", "b", "c"]
SCHEMA = "grp string, i string, d date, m date, a double, b double, c double, y double, s double"
ALPHAS = (1.0, 30.0, 1000.0)


def day(n):
    return D0 + dt.timedelta(days=int(n))


def months(d, n):
    return d + relativedelta(months=n)


def panel(seed, n=1000, instruments=("p",), group="g"):
    """Rows of one group: features, a target known five days later, scales; some features missing, one nearly constant."""
    rng, out = np.random.default_rng(seed), []
    for i in instruments:
        x = rng.normal(size=(n, 3)) * [1.0, 4.0, 0.5] + [0, 10, 0]
        s = 0.5 + rng.random(n)
        y = s * (0.3 * x[:, 0] - 0.05 * (x[:, 1] - 10) + rng.normal(size=n))
        for t in range(n):
            if rng.random() < 0.9:
                out.append((group, i, day(t), day(t + 5), None if rng.random() < 0.02 else float(x[t, 0]), float(x[t, 1]), float(x[t, 2]), float(y[t]), float(s[t])))
    return out


def folds_of(rows, first=500, length=6):
    last = max(r[2] for r in rows)
    starts = [months(day(first), length * k) for k in range(8)]
    return [("g", f"dev_{k + 1:02d}", t, months(t, length)) for k, t in enumerate(starts) if t < last] + [("g", "lock", last, last + dt.timedelta(days=1))]


def ridge(rows, use, alpha, weight=None):
    """Ridge by its definition, on standardised inputs, target y / s."""
    x = np.array([[r[4 + j] for j in use] for r in rows], float)
    z = np.array([r[7] / max(r[8], 1e-6) for r in rows])
    mu, sd = x.mean(0), x.std(0)
    q = (x - mu) / sd
    beta = np.linalg.solve(q.T @ q + alpha * np.eye(len(use)), q.T @ (z - z.mean()))
    return lambda r: z.mean() + ((np.array([r[4 + j] for j in use], float) - mu) / sd) @ beta


def whole(rows):
    return [r for r in rows if r[4] is not None]


def choose(rows, fold, years, blocks=3, least=100):
    best, t0 = [], fold[2]
    losses = {a: [0.0, 0] for a in ALPHAS}
    for k in range(1, blocks + 1):
        v0, v1 = months(t0, -6 * k), months(t0, -6 * (k - 1))
        train = [r for r in whole(rows) if r[3] < v0 and r[2] >= months(v0, -12 * years)]
        judged = [r for r in whole(rows) if v0 <= r[2] < v1 and r[3] < t0]
        if len(train) < least or not judged:
            continue
        for a in ALPHAS:
            f = ridge(train, range(3), a)
            losses[a][0] += sum((r[7] / max(r[8], 1e-6) - f(r)) ** 2 for r in judged)
            losses[a][1] += len(judged)
        best.append(k)
    if not best:
        return ALPHAS[1], None
    score = {a: round(s / n, 12) for a, (s, n) in losses.items()}
    return max((a for a in ALPHAS if score[a] == min(score.values()))), min(score.values())


@pytest.mark.parametrize("instruments", [("p",), ("p", "q", "r")])
def test_scheduled_refits_equal_refits(spark, instruments):
    """One instrument, and a pooled panel whose instruments share every model and every boundary."""
    rows = panel(1, 1000 if len(instruments) == 1 else 800, instruments)
    folds = folds_of(rows)
    got = H.scheduled_refits(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(folds, "grp string, fold string, t0 date, t1 date"), "grp", "d", "m", X, "y", "s",
                             every=10, alphas=ALPHAS, years=1, least=60).collect()
    have = {(r.fold, r.i, r.d): r for r in got}
    want = {}
    for fold in folds[:-1]:
        alpha, loss = choose(rows, fold, 1, least=60)
        test = [r for r in whole(rows) if fold[2] <= r[2] < fold[3]]
        model, version = None, 0
        for n, d in enumerate(sorted({r[2] for r in test})):
            if n % 10 == 0:
                train = [r for r in whole(rows) if r[3] < d and r[2] >= months(d, -12)]
                if len(train) >= 60:
                    model, version = (ridge(train, range(3), alpha), len(train), d), version + 1
            for r in test:
                if r[2] == d and model:
                    want[fold[1], r[1], d] = (model[0](r) * r[8], model[1], model[2], version, alpha, loss)
    assert set(have) == set(want) and len(want) > 300
    for k, (p, n, at, version, alpha, _) in want.items():
        assert (have[k].n_train, have[k].trained_at, have[k].model_version, have[k].alpha) == (n, at, version, alpha)
        assert have[k].prediction == pytest.approx(p, rel=1e-7, abs=1e-9)


def test_settings_see_no_label_of_the_fold(spark):
    """Labels that mature at a fold's start or later don't move its settings."""
    rows = panel(2)
    folds = folds_of(rows)
    t0 = folds[1][2]
    changed = [r if r[3] < t0 else (*r[:7], r[7] * 50 + 7, r[8]) for r in rows]
    pick = lambda rs: H.chosen_settings(spark.createDataFrame(rs, SCHEMA), spark.createDataFrame(folds[:2], "grp string, fold string, t0 date, t1 date"), "grp", "d", "m", X, "y",
                                        ALPHAS, 1, least=60).filter("fold = 'dev_02'").first()
    assert pick(rows) == pick(changed)


def test_feature_sets_equal_refits(spark):
    rows = panel(3)
    folds = folds_of(rows)
    sets = {"all": X, "ab": ["a", "b"], "only_c": ["c"]}
    got = {(r.fold, r.candidate): r for r in H.feature_sets(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(folds, "grp string, fold string, t0 date, t1 date"), "grp", "d", "m", sets, "y", "s", alpha=20.0, least=100).collect()}
    for fold in folds[:-1]:
        t0 = fold[2]
        everywhere = [r for r in rows if t0 <= r[2] < fold[3]]
        test = whole(everywhere)
        if len(test) < 8:
            assert (fold[1], "all") not in got
            continue
        inner, cells = {}, {}
        for name, cols in sets.items():
            use = [X.index(c) for c in cols]
            model = ridge([r for r in whole(rows) if r[3] < t0], use, 20.0)
            py = pp = 0.0
            for k in range(1, 4):
                v0, v1 = months(t0, -6 * k), months(t0, -6 * (k - 1))
                train = [r for r in whole(rows) if r[3] < v0]
                judged = [r for r in whole(rows) if v0 <= r[2] < v1 and r[3] < t0]
                if len(train) < 100 or not judged:
                    continue
                f = ridge(train, use, 20.0)
                guess = [f(r) * r[8] for r in judged]
                py, pp = py + sum(g * r[7] for g, r in zip(guess, judged)), pp + sum(g * g for g in guess)
                inner.setdefault(name, {})[k] = np.mean([abs(r[7] - g) for g, r in zip(guess, judged)])
            slope = min(max(py / pp, 0.0), 1.0) if pp else 0.0
            guess = [model(r) * r[8] for r in test]
            cells[name] = (np.mean([abs(r[7] - g) for g, r in zip(guess, test)]), np.mean([abs(r[7] - slope * g) for g, r in zip(guess, test)]), slope)
        ref = inner.get("all", {})
        fit = {n: np.mean(list(e.values())) for n, e in inner.items() if n == "all" or sum(e[k] < ref[k] for k in e) >= 2}
        chosen = min(fit, key=fit.get) if fit else "all"
        for name, (mae, shrunk, slope) in cells.items():
            r = got[fold[1], name]
            assert (r.n, r.n_train) == (len(test), len([q for q in whole(rows) if q[3] < t0]))
            assert (r.mae, r.shrunk_mae, r.slope) == pytest.approx((mae, shrunk, slope), rel=1e-6)
            assert r.chosen == (name == chosen)
            if ref:
                assert r.inner_mae == pytest.approx(np.mean(list(inner[name].values())), rel=1e-6)
            assert r.coverage == pytest.approx(1.0)
    assert {r.chosen for r in got.values()} == {True, False}


def test_coverage_counts_rows_the_reference_has(spark):
    rows = [(*r[:6], None if n % 3 == 0 else r[6], *r[7:]) for n, r in enumerate(panel(4, 700))]
    folds = [("g", "dev_01", day(500), day(690))]
    got = {r.candidate: r.coverage for r in H.feature_sets(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(folds, "grp string, fold string, t0 date, t1 date"), "grp", "d", "m", {"ab": ["a", "b"], "abc": X}, "y", "s", least=50).collect()}
    test = [r for r in rows if day(500) <= r[2] < day(690) and r[4] is not None]
    assert got["ab"] == 1.0 and got["abc"] == pytest.approx(sum(r[6] is not None for r in test) / len(test))


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10**6))
def test_places_of_a_moment_array(k, seed):
    z = np.concatenate([[1.0], np.random.default_rng(seed).normal(size=k)])
    flat = np.outer(z, z)[np.triu_indices(k + 1)]
    assert len(flat) == H.size_of(k)
    for i, j in itertools.product(range(k + 1), repeat=2):
        assert flat[H.place(i, j, k)] == z[i] * z[j]


def test_a_column_that_never_moves(spark):
    rows = [(*r[:6], 7.0, *r[7:]) for r in panel(5, 300)]
    m = H.moments_before(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("g", day(400))], "grp string, cut date"), "grp", "m", X, "y")
    got = m.select(H.ridge_solutions(3, [(range(3), 5.0), ([0, 1], 5.0)])("m").alias("b")).first().b
    assert got[0] == pytest.approx(got[1]) and got[0][3] == 0.0
