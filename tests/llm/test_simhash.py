"""Fingerprints and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash

from .cases import awkward, documents, prose


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(values, radius=4):
    """The least number of each value's component."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints(spark):
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in simhash.fingerprints(documents(spark, awkward())).collect())
    assert got == sorted((str(k), plain_fingerprint(t)) for k, t in awkward())


def test_spark_hash_is_the_contracts(spark):
    word = spark.sql("select xxhash64('a b ç d') as h").first().h
    assert word & (2**64 - 1) == xxhash.xxh64_intdigest("a b ç d".encode(), 42)


@pytest.mark.parametrize("hot,run", [(simhash.HOT_KEY, simhash.SHORT_RUN), (5, 4)])
def test_components(spark, monkeypatch, hot, run):
    """Chains, dense clusters and lone values; with low limits the long-run and the split-key ways are taken too."""
    monkeypatch.setattr(simhash, "SHORT_RUN", run)
    pick = random.Random(3)
    values = [0, (1 << 64) - 1, 1 << 63]
    for _ in range(12):
        v = pick.getrandbits(64)
        for _ in range(pick.randint(1, 15)):
            values.append(v)
            for _ in range(pick.randint(0, 6)):
                v ^= 1 << pick.randrange(64)
    base = pick.getrandbits(64)
    values += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(frame, hot=hot).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    nodes = frame.selectExpr("fp", "fp as low")
    roots = {r.fp: r.root for r in simhash.labelled_fingerprints(nodes).collect()}
    groups: dict = {}
    for v, g in zip(signed, plain_groups(values)):
        groups.setdefault(g, set()).add(v)
    got: dict = {}
    for v, r in roots.items():
        got.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_masks_find_every_link():
    pick = random.Random(1)
    for blocks in (6, 7, 8):
        masks = simhash.block_masks(blocks)
        for _ in range(300):
            a = pick.getrandbits(64)
            b = a
            for bit in pick.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_pivots_drop_no_link():
    pick = np.random.default_rng(0)
    fps = pick.integers(0, 2**63, 400, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(0b1011)
    near = simhash._near(simhash.pivot_table(fps, simhash.pivot_words()), fps, np.arange(0, 400, 2), np.arange(1, 400, 2), 4)
    assert len(near) == 200


def test_near_duplicates_and_one_of_each(spark):
    text = prose(5, 400)
    rows = awkward() + [(30, text), (31, text + " end"), (32, text.upper()), (33, prose(6, 400)), (33, prose(6, 400))]
    frame = documents(spark, rows)
    values = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(values)
    low: dict = {}
    for (k, _), g in zip(rows, groups):
        low.setdefault(g, []).append(k)
    want = sorted(str((k, min((x for x in low[g] if x is not None), default=None))) for (k, _), g in zip(rows, groups))
    got = sorted(str((r.doc_id, r.component_id)) for r in simhash.near_duplicates(frame).collect())
    assert got == want
    kept = simhash.one_of_each_group(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(None if None in ks else min(ks)) for ks in low.values())


def test_empty_table(spark):
    frame = documents(spark, awkward()).filter("false")
    assert simhash.near_duplicates(frame).count() == 0 and simhash.one_of_each_group(frame).count() == 0


def test_other_splits_between_the_steps(spark, tmp_path, monkeypatch):
    """Cores that come or go between two scans change the splits and so the row numbers; the rows stay the same."""
    rows = [(i, prose(i // 2, 60)) for i in range(60)]
    documents(spark, rows).repartition(12).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    before, label = spark.conf.get("spark.sql.files.openCostInBytes"), simhash.labelled_fingerprints

    def labelled(*args):
        out = label(*args)
        spark.conf.set("spark.sql.files.openCostInBytes", "512m")  # a split a file from now on
        return out

    monkeypatch.setattr(simhash, "labelled_fingerprints", labelled)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        kept = sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept == list(range(0, 60, 2))
