"""Shards hold every row once, counts differ by one at most, slots have no gap."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import sharding

from .cases import awkward, documents


def check(out, rows, shards):
    got = [(r.shard, r.slot) for r in out]
    assert len(got) == len(rows)
    sizes = Counter(s for s, _ in got)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(k for h, k in got if h == s) == list(range(counts[s]))


def test_rows_law_small_buckets(spark):
    rows = awkward() * 5
    out = sharding.shuffled_shards(documents(spark, rows), shards=8, bucket_bytes=2000)
    got = out.collect()
    check(got, rows, 8)
    count = lambda xs: Counter((k, t) for k, t in xs)
    assert count((r.record.doc_id, r.record.text) for r in got) == count(rows)
    assert got[0].record.bucket == "x"


def test_order_is_shuffled(spark):
    frame = documents(spark, [(i, str(i)) for i in range(500)], clash=False)
    order = [r.record.doc_id for r in sharding.shuffled_shards(frame, 3).orderBy("shard", "slot").collect()]
    assert order != sorted(order) and sorted(order) == list(range(500))
    moved = sum(abs(a - b) for a, b in enumerate(order)) / 500
    assert 100 < moved < 240  # a uniform permutation moves rows by a third of 500


def test_joined_manifest_equals_broadcast(spark, monkeypatch):
    frame = documents(spark, awkward(), clash=False)
    monkeypatch.setattr(sharding, "MAX_BROADCAST_BUCKETS", 0)
    check(sharding.shuffled_shards(frame, 4, bucket_bytes=500).collect(), awkward(), 4)


def test_empty_table(spark):
    frame = documents(spark, awkward()).filter("false")
    out = sharding.shuffled_shards(frame, 8)
    assert out.count() == 0 and {"record", "shard", "slot"} == set(out.columns)


def test_size(spark):
    frame = documents(spark, [(1, None), (2, "é")], clash=False)
    assert [r[0] for r in frame.select(sharding.record_size()).collect()] == [1, 3]
    assert dict(frame.select(F.lit(1)).dtypes)  # the column is usable in any projection
