"""The boosted family: calibrated together, better than the forest inside, and blind to what comes after."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify as C

D0 = dt.date(2019, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    """Two instruments; the class hangs on a product of two features, which no linear model sees."""
    rng, rows = np.random.default_rng(11), []
    for i in ("a", "b"):
        x = rng.normal(size=(700, 4))
        score = 1.5 * x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + 0.7 * rng.normal(size=700)
        y = np.where(score < -0.6, 0, np.where(score > 0.6, 2, 1))
        rows += [(i, D0 + dt.timedelta(days=t), *map(float, x[t]), int(y[t])) for t in range(700)]
    frame = spark.createDataFrame(rows, "instrument string, d date, x0 double, x1 double, x2 double, x3 double, y int")
    return C.assembled(frame, ["x0", "x1", "x2", "x3"], "y", ["instrument", "d"])


@pytest.fixture(scope="module")
def boosted(table):
    return C.fit_boosted(table.filter(F.col("d") < D0 + dt.timedelta(days=550)), "d", block=80)


def test_probabilities_sum_to_one_and_beat_the_forest(table, boosted):
    cut = D0 + dt.timedelta(days=550)
    train, test = table.filter(F.col("d") < cut), table.filter(F.col("d") >= cut)
    p = boosted.probabilities(test)
    rows = p.collect()
    assert len(rows) == 300 and all(abs(r.p_down + r.p_flat + r.p_up - 1) < 1e-9 and min(r.p_down, r.p_flat, r.p_up) > 0 for r in rows)
    assert boosted.inner_loss < C.forest_inner_loss(train, "d", block=80)
    assert C.losses(p)[1.0][0] < C.losses(C.probabilities(C.fit(train, "linear"), test))[1.0][0]
    assert all(1 <= n <= 12 for n in boosted.trees)


def test_margins_are_the_models_own(table, boosted):
    """Three margins a row, each twice the weighted sum of its trees."""
    got = C.margins(boosted.models, table.limit(20)).select("instrument", "d", "features").collect()
    given = {(r.instrument, r.d): r.features for r in table.limit(20).collect()}
    for r in got:
        x = given[r.instrument, r.d]
        for k, m in enumerate(boosted.models):
            assert r.features[k] == pytest.approx(sum(w * t.predict(x) for w, t in zip(m.treeWeights, m.trees)))


def test_later_rows_do_not_matter(table, boosted):
    """The same rows before the cut give the same models, whatever is appended after it and filtered out."""
    again = C.fit_boosted(table.filter(F.col("d") < D0 + dt.timedelta(days=550)), "d", block=80)
    assert again.trees == boosted.trees and again.inner_loss == pytest.approx(boosted.inner_loss)


def test_walk_forward_trains_on_matured_rows_only(table):
    rows = table.withColumn("m", F.date_add("d", 5))
    cut = D0 + dt.timedelta(days=600)
    p = C.walk_forward(rows, [(str(cut), str(cut + dt.timedelta(days=50)))], "d", "m")
    changed = C.walk_forward(rows.withColumn("label", F.when(F.col("m") >= F.lit(cut), 2 - F.col("label")).otherwise(F.col("label"))), [(str(cut), str(cut + dt.timedelta(days=50)))], "d", "m")
    key = lambda f: {(r.instrument, r.d): (r.p_down, r.p_flat, r.p_up, r.prior_0, r.prior_2) for r in f.collect()}
    a, b = key(p), key(changed)
    assert a.keys() == b.keys() and len(a) == 100 and all(a[k] == pytest.approx(b[k]) for k in a)
    assert all(sum(v[:3]) == pytest.approx(1) for v in a.values())


def area(score, up):
    pos, neg = score[up], score[~up]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_walk_forward_report_equals_numpy(spark, table):
    rows = table.withColumn("m", F.date_add("d", 5))
    spans = [(str(D0 + dt.timedelta(days=k)), str(D0 + dt.timedelta(days=k + 150))) for k in (300, 450)]
    p = C.walk_forward(rows, spans, "d", "m")
    got = {r.instrument: r for r in C.walk_forward_report(p, "instrument", "d", draws=100).collect()}
    every = p.collect()
    for i in ("a", "b"):
        own = [r for r in every if r.instrument == i]
        y = np.array([int(r.label) for r in own])
        prob, prior = (np.array([[r[c] for c in cols] for r in own]) for cols in (("p_down", "p_flat", "p_up"), ("prior_0", "prior_1", "prior_2")))
        at = np.arange(len(y))
        balanced = lambda q: np.mean([(q.argmax(1) == y)[y == k].mean() for k in range(3)])
        moving = y != 1
        r = got[i]
        assert (r.n, r.folds) == (len(own), 2) and r.n == 300
        assert (r.log_loss, r.prior_log_loss) == pytest.approx((-np.log(prob[at, y]).mean(), -np.log(prior[at, y]).mean()))
        assert (r.balanced_accuracy, r.prior_balanced_accuracy) == pytest.approx((balanced(prob), balanced(prior)))
        assert (r.auc_up, r.auc_up_vs_down) == pytest.approx((area(prob[:, 2], y == 2), area((prob[:, 2] - prob[:, 0])[moving], (y == 2)[moving])))
        assert [r.share_0, r.share_1, r.share_2] == pytest.approx([np.mean(y == k) for k in range(3)])
        assert r.log_loss_diff_lo < (r.log_loss - r.prior_log_loss) < r.log_loss_diff_hi and r.auc_up_lo < r.auc_up + 2e-3 and r.auc_up - 2e-3 < r.auc_up_hi


def test_live_row_uses_no_unknown_label(spark):
    """The newest row is judged, and labels that mature after it change nothing."""
    rng = np.random.default_rng(3)
    rows = [("a", D0 + dt.timedelta(days=t), D0 + dt.timedelta(days=t + 5), float(rng.normal()), float(rng.normal()), int(rng.integers(0, 3))) for t in range(300)]
    schema = "instrument string, d date, m date, x0 double, x1 double, y int"
    changed = [r if r[2] <= rows[-1][1] else (*r[:5], 0) for r in rows]
    unknown = [r if r[2] <= rows[-1][1] else (*r[:5], None) for r in rows]
    live = lambda rs: C.live_direction(spark.createDataFrame(rs, schema), ["x0", "x1"], "y", "instrument", "d", "m").first()
    a, b, c = live(rows), live(changed), live(unknown)
    assert a.d == rows[-1][1] and a.n_train == 295 and a.p_down + a.p_flat + a.p_up == pytest.approx(1)
    for other in (b, c):
        assert [a.p_down, a.p_up] == pytest.approx([other.p_down, other.p_up])


def test_choice_is_the_least_inner_loss(table):
    """The setting, its temperature and loss against fits made one by one on the same blocks."""
    train = table.filter(F.col("d") < D0 + dt.timedelta(days=550))
    best = C.choose(train, "d", cs=(0.003, 0.3), weights=(False,), splits=2, block=80)
    want = {}
    for c in (0.003, 0.3):
        parts = C.date_blocks(train, "d", 2, 80)
        got = []
        for s in (1, 2):
            a, b = (parts.filter((F.col("split") == s) & (F.col("side") == side)).drop("split", "side") for side in ("train", "validate"))
            got.append(C.losses(C.probabilities(C.fit(a, "linear", c), b), C.TEMPERATURES))
        want[c] = {t: sum(g[t][0] for g in got) / 2 for t in C.TEMPERATURES}
    c = min(want, key=lambda k: want[k][1.0])
    t = min(C.TEMPERATURES, key=lambda k: want[c][k])
    assert (best["c"], best["balanced"], best["temperature"]) == (c, False, t) and best["inner_loss"] == pytest.approx(want[c][t], rel=1e-6)
