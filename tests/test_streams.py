"""Streams run to completion over several micro-batches equal the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quotes as U
from tidemark.operators import sets as S
from tidemark.operators import settle as Z
from tidemark.operators import traffic as T
from tidemark.streaming import hits as H
from tidemark.streaming import marts as M

SCHEMA = "event_id bigint, ts timestamp_ntz, visitor string, page string, ua string, source string"
T0 = dt.datetime(2024, 1, 1, 8)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    at, out = T0, []
    for i in range(300):
        at += dt.timedelta(seconds=rng.randint(20, 200))
        out.append((i, at, f"v{rng.randint(0, 3)}", rng.choice(["a", "b"]), "Googlebot" if i % 17 == 0 else "Mozilla", "web"))
    return out


def greedy(rows):
    last, kept = {}, []
    for i, at, v, p, ua, _ in rows:
        if "bot" in ua:
            continue
        k = (v, p, at.date())
        if k not in last or at - last[k] >= dt.timedelta(minutes=10):
            last[k] = at
            kept.append(i)
    return kept


def stream(spark, rows, folder, parts=5):
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step:(k + 1) * step], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k:02d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_batch_dedup_is_greedy(spark, rows):
    got = sorted(r.event_id for r in T.dedup_hits(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == greedy(rows)


def test_boundary_nine_and_eleven_minutes(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(i, at(m), "v", "a", "Mozilla", "web") for i, m in enumerate([0, 9, 10, 11, 19, 20])]
    assert sorted(r.event_id for r in T.dedup_hits(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 2, 5]


def test_stream_dedup_equals_batch(spark, rows, tmp_path):
    counted = H.count_visits(stream(spark, rows, str(tmp_path)))
    M.drain(counted, lambda df, n: M.write_batch(df, str(tmp_path / "out"), n), str(tmp_path / "cp"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == greedy(rows)


def test_running_totals(spark, rows, tmp_path):
    sink = M.totals_sink(str(tmp_path / "tot"))
    M.drain(stream(spark, rows, str(tmp_path)), sink, str(tmp_path / "cp"))
    want = {p: sum(r[3] == p for r in rows) for p in "ab"}
    assert {r.page: r.total for r in M.running_totals(spark, str(tmp_path / "tot")).collect()} == want
    sink(spark.createDataFrame(rows[:60], SCHEMA), 0)  # a repeated batch changes nothing
    assert {r.page: r.total for r in M.running_totals(spark, str(tmp_path / "tot")).collect()} == want


def test_versions_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    obs = [(f"k{k}", d, float(rng.randint(0, 2))) for d in days for k in range(3)]
    df = spark.createDataFrame(obs, "key string, seen date, value double")
    want = sorted(tuple(r) for r in S.archive_versions(df, "key", "seen", ["value"]).select("key", "seen", "value").collect())
    each = M.versions_sink(str(tmp_path / "v"), "key", "seen", ["value"])
    for n in range(4):
        each(df.filter((F.datediff("seen", F.lit(days[0])) / 10).cast("int") == n), n)
    each(df.filter((F.datediff("seen", F.lit(days[0])) / 10).cast("int") == 2), 2)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "v")).select("key", "seen", "value").collect()) == want


def test_append_sink_keeps_the_first(spark, tmp_path):
    each = M.append_sink(str(tmp_path / "a"))
    mk = lambda *r: spark.createDataFrame(list(r), "record_id string, v int")
    each(mk(("a", 1), ("b", 2)), 0)
    each(mk(("a", 9), ("c", 3)), 1)
    each(mk(("a", 9), ("c", 3)), 1)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "a")).select("record_id", "v").collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_robots_origins_and_late_attribution(spark):
    t = lambda m, s=0: dt.datetime(2024, 1, 2, 10, m, s)
    hit = lambda i, ts, ua="Mozilla", source="web", origin="https://own.example", ref="": (i, ts, "v", "main", ua, source, origin, ref)
    rows = [hit(1, t(0)), hit(2, t(9), source="email"), hit(3, t(11)), hit(4, t(12), ua="curl/8"), hit(5, t(13), origin="https://else.example"),
            hit(6, t(30), origin="", ref="https://own.example/page"), hit(7, t(31), origin="", ref=""), hit(8, t(45), ua="HeadlessChrome")]
    h = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, visitor string, page string, ua string, source string, origin string, referrer string")
    own = T.countable(h, own=["https://own.example"])
    assert sorted(r.event_id for r in own.collect()) == [1, 2, 3, 6]
    got = {r.event_id: (r.source, r.attributed_by) for r in T.attributed_visits(own).collect()}
    assert got == {1: ("email", 2), 3: ("", None), 6: ("", None)}


def arrivals(rows, seed, most=580):
    """The rows in the order they arrive when each is late by up to ``most`` seconds."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.randint(0, most)), r[0]))


@pytest.mark.parametrize("seed,parts", [(1, 4), (2, 9)])
def test_late_hits_are_counted_in_order(spark, rows, tmp_path, seed, parts):
    """Hits shuffled within the bound give what the batch gives; the one processed in arrival order does not."""
    flush = (10**6, T0 + dt.timedelta(days=3), "flush", "z", "Mozilla", "web")
    late = [*arrivals(rows, seed), flush]
    assert [r[0] for r in late] != sorted(r[0] for r in late)
    counted = H.count_visits_in_order(stream(spark, late, str(tmp_path), parts))
    M.drain(counted, lambda df, n: M.write_batch(df, str(tmp_path / "out"), n), str(tmp_path / "cp"))
    got = sorted((r.event_id, r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.event_id < 10**6)
    want = {r[0]: r[1] for r in rows}
    assert [i for i, _ in got] == greedy(rows) and all(at == want[i] for i, at in got)


def observations():
    at = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    return [("a", at(1), "provisional", 10.0), ("a", at(5), "provisional", 12.0), ("a", at(9), "confirmed", 11.0), ("a", at(12), "confirmed", 99.0), ("a", at(20), "provisional", 50.0),
            ("b", at(2), "provisional", 7.0), ("b", at(3), "provisional", 7.0 * (1 + 1e-14)), ("b", at(8), "provisional", 8.0), ("c", at(4), "confirmed", 5.0), ("c", at(4), "provisional", 5.0),
            ("d", at(6), "provisional", None), ("e", at(7), "provisional", 3.0), ("e", at(30), "confirmed", 3.0)]


def test_states_of_actual_values(spark):
    at = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame(observations(), "key string, observed_at date, kind string, value double")
    points = spark.createDataFrame([(k, 10.0) for k in "abcdef"], "key string, point double")
    show = lambda f: {r.key: (r.state, r.actual, r.updated_at, r.changes) for r in f.collect()}
    assert show(Z.settled(points, df, "key")) == {
        "a": ("final", 11.0, at(9), 2), "b": ("provisional", 8.0, at(8), 1), "c": ("final", 5.0, at(4), 0), "d": ("pending", None, None, 0), "e": ("final", 3.0, at(7), 0), "f": ("pending", None, None, 0)}
    assert show(Z.settled(points, df, "key", by_time=F.lit(at(6)))) == {
        "a": ("provisional", 12.0, at(5), 1), "b": ("provisional", 7.0, at(2), 0), "c": ("final", 5.0, at(4), 0), "d": ("pending", None, None, 0), "e": ("pending", None, None, 0), "f": ("pending", None, None, 0)}
    r = Z.settled(points, df, "key").filter("key = 'a'").first()
    assert r.error == -1.0 and r.ape == pytest.approx(1 / 11)


@pytest.mark.parametrize("seed", [3, 4])
def test_replayed_and_reordered_batches_settle_alike(spark, tmp_path, seed):
    schema = "key string, observed_at date, kind string, value double"
    rows = observations()
    points = spark.createDataFrame([(k, 10.0) for k in "abcdef"], "key string, point double")
    want = sorted(map(tuple, Z.settled(points, spark.createDataFrame(rows, schema), "key").collect()), key=str)
    rng = random.Random(seed)
    mixed = [*rows, *rng.sample(rows, 4)]
    rng.shuffle(mixed)
    each = M.observations_sink(str(tmp_path / "m"), "key")
    batches = [mixed[k::4] for k in range(4)]
    for n in (2, 0, 3, 1, 0, 2):  # out of order, two of them again
        each(spark.createDataFrame(batches[n], schema), n)
    assert sorted(map(tuple, M.settled_forecasts(spark, str(tmp_path / "m"), points, "key").collect()), key=str) == want


@pytest.mark.parametrize("seed", [5, 6])
def test_quote_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(rng.choice("xy"), at(60 * rng.randint(0, 9)), rng.choice("ab"), float(rng.choice([-1, 0, 5, 5, 6])), at(rng.randint(0, 900))) for _ in range(200)]
    schema = "instrument string, ts timestamp_ntz, source string, price double, arrived timestamp_ntz"
    want = sorted(map(tuple, U.first_seen(spark.createDataFrame(rows, schema)).collect()))
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    quotes = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    each = M.quotes_sink(str(tmp_path / "q"))
    M.drain(quotes, each, str(tmp_path / "cp"))
    each(spark.createDataFrame(rows[2::5], schema), 99)  # a part that comes again under another number
    first, conflicts = M.intake(spark, str(tmp_path / "q"))
    assert sorted(map(tuple, first.collect())) == want
    assert {(r.instrument, r.ts, r.source) for r in conflicts.collect()} == {w[:3] for w in want if w[5]} and any(w[5] for w in want)
