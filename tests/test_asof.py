"""As-of joins against a plain Python model, with ties, tolerance edges, chunk borders and both directions."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators.asof import asof_join, asof_with_expiry, known_at

DAY0 = dt.date(2024, 1, 1)
day = st.integers(0, 60).map(lambda n: DAY0 + dt.timedelta(days=n))
key = st.sampled_from(["a", "b"])


def model(left, right, strict, forward, tol):
    out = []
    for k, t in left:
        ok = []
        for rk, rt, v in right:
            if rk != k:
                continue
            if not forward and (rt < t or (rt == t and not strict)):
                ok.append((rt, v))
            if forward and (rt > t or (rt == t and not strict)):
                ok.append((rt, v))
        best = (min(ok) if forward else max(ok)) if ok else None
        if best and tol is not None and abs((t - best[0]).days) > tol:
            best = None
        out.append((k, t, best[1] if best else None))
    return sorted(out, key=repr)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(key, day), min_size=1, max_size=12), st.lists(st.tuples(key, day, st.integers(0, 9)), min_size=1, max_size=12),
       st.booleans(), st.booleans(), st.sampled_from([None, 0, 3, 7]), st.sampled_from([1, 5, 90]))
def test_matches_model(spark, left, right, strict, forward, tol, chunk):
    l = spark.createDataFrame(left, "k string, t date")
    r = spark.createDataFrame(right, "k string, rt date, v int")
    got = asof_join(l, r, "t", "rt", "k", ["v"], strict=strict, forward=forward, tolerance_days=tol, chunk_days=chunk)
    assert sorted(((x.k, x.t, x.v) for x in got.collect()), key=repr) == model(left, right, strict, forward, tol)


def test_expiry(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    l = spark.createDataFrame([("a", d(5)), ("a", d(10)), ("a", d(11))], "k string, t date")
    r = spark.createDataFrame([("a", d(5), d(10), 1.0)], "k string, available date, expires date, v double")
    got = {x.t: x.v for x in asof_with_expiry(l, r, "t", "available", "expires", "k", ["v"]).collect()}
    assert got == {d(5): 1.0, d(10): 1.0, d(11): None}


def test_later_revision_never_leaks_back(spark):
    d = lambda n: DAY0 + dt.timedelta(days=n)
    versions = spark.createDataFrame([("k", d(0), 1.0), ("k", d(30), 2.0)], "key string, observed date, v double")
    dec = spark.createDataFrame([(d(29),), (d(30),), (d(400),)], "decision date")
    got = {x.decision: x.v for x in known_at(versions, dec, "key", "observed", "decision").collect()}
    assert got == {d(29): 1.0, d(30): 2.0, d(400): 2.0}


def test_news_in_window_meets_distinct_times_only(spark, monkeypatch):
    """Many headlines of one time, many events of one time, tied scores and a shared event_id, against brute force."""
    from tidemark.operators import events as E

    joins, join = [], E.range_join
    monkeypatch.setattr(E, "range_join", lambda *a, **k: joins.append(join(*a, **k)) or joins[-1])
    t0 = dt.datetime(2024, 1, 1)
    heads = [(i, t0 + dt.timedelta(minutes=20 * (i % 4)), ("The sale", "on", "quiet", "The ch on")[i % 7 % 4]) for i in range(400)]
    events = [(i, t0 + dt.timedelta(minutes=30 + i % 3)) for i in range(300)] + [(1, t0 - dt.timedelta(minutes=15)), (2, t0 + dt.timedelta(minutes=32)), (None, t0), (9, None)]
    score = lambda t: 3 * ("The" in t) + 2 * ("on" in t.lower()) + 2 * ("ch" in t.lower()) - 2 * ("sale" in t)
    got = E.news_in_window(spark.createDataFrame(events, "event_id long, ts timestamp_ntz"), spark.createDataFrame(heads, "doc_id long, time timestamp_ntz, title string"),
                           "The", ["on", "ch"], ["sale"])
    rows = sorted(map(tuple, got.collect()), key=repr)
    want = []
    for e in {e for e, _ in events}:
        pool = [(-score(t), at, d) for k, ts in events if k == e and ts for d, at, t in heads
                if ts - dt.timedelta(minutes=90) <= at <= ts + dt.timedelta(minutes=15)]
        want += [(e, i + 1, d, at, -s) for i, (s, at, d) in enumerate(sorted(pool)[:5])]
    assert rows == sorted(want, key=repr)
    assert sum(j.count() for j in joins) <= 5 * 4 * len({ts for _, ts in events})
