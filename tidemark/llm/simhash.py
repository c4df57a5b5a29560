"""SimHash near-duplicates: fingerprints, pivot distance tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .decontaminate import slices

SHINGLE = 4
RADIUS = 4
PIVOTS = 16
#: Runs of fingerprints under one key up to this size are compared in one go; longer ones step by step.
SHORT_RUN = 64
#: Keys with more fingerprints than this are split by further blocks before they meet in a task.
HOT_KEY = 8192
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits of the seeded XXH64 of the word shingles; no words: 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(first[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at:at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the signed 64-bit ``fp`` of every row's whole text; null texts are empty."""
    rows = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for _, texts in slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], names=[key, "fp"])

    return rows.mapInArrow(compute, T.StructType([rows.schema[0], T.StructField("fp", T.LongType())]))


def block_masks(blocks: int, radius: int = RADIUS, bits: int = 64, allowed: int = (1 << 64) - 1) -> list[int]:
    """Masks of all choices of ``blocks - radius`` blocks: two words at most ``radius`` bits apart agree under one."""
    places = [i for i in range(bits) if allowed >> i & 1]
    cut = [places[len(places) * k // blocks:len(places) * (k + 1) // blocks] for k in range(blocks)]
    parts = [sum(1 << i for i in c) for c in cut]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def pivot_words(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random words."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (columns) to every pivot (rows)."""
    return np.bitwise_count(fps[None, :] ^ pivots[:, None]).astype(np.int8)


def _near(table: np.ndarray, fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (a, b) are within ``radius``: dropped by the largest coordinate difference, survivors verified."""
    alive = np.arange(len(a))
    for row in table:
        alive = alive[np.abs(row[a[alive]] - row[b[alive]]) <= radius]
    return alive[np.bitwise_count(fps[a[alive]] ^ fps[b[alive]]) <= radius]


def _walk(fps: np.ndarray, table: np.ndarray, at: int, size: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect a long run as all its links would: each fingerprint looks only at those not yet reached."""
    rest = np.arange(at, at + size)
    while len(rest):
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for x in queue.pop():
                near = _near(table, fps, np.full(len(rest), x), rest, radius)
                if len(near):
                    yield np.full(len(near), x), rest[near]
                    queue.append(rest[near])
                    rest = np.delete(rest, near)
                if not len(rest):
                    break


def links_in_runs(keys: list[np.ndarray], fps: np.ndarray, pivots: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside runs of equal keys (sorted input)."""
    same = np.ones(max(0, len(fps) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    starts = np.nonzero(np.concatenate([[True], ~same]))[0] if len(fps) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(fps)))
    table = pivot_table(fps, pivots)
    out_a, out_b = [], []
    run_end = np.repeat(starts + sizes, sizes)
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for d in range(1, min(SHORT_RUN, int(sizes.max(initial=1)))):
        a = np.nonzero(short & (np.arange(len(fps)) + d < run_end))[0]
        if not len(a):
            break
        near = _near(table, fps, a, a + d, radius)
        out_a.append(a[near])
        out_b.append(a[near] + d)
    for at, size in zip(starts[sizes > SHORT_RUN].tolist(), sizes[sizes > SHORT_RUN].tolist()):
        for a, b in _walk(fps, table, at, size, radius):
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return fps[:0], fps[:0]
    return fps[np.concatenate(out_a)], fps[np.concatenate(out_b)]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key: the last run of a batch waits for the next one."""
    pivots = pivot_words()
    held: list[np.ndarray] | None = None

    def links(columns):
        a, b = links_in_runs(columns[:-1], columns[-1].view(np.uint64), pivots)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if not len(columns[0]):
            continue
        open_run = np.ones(len(columns[0]), bool)
        for c in columns[:-1]:
            open_run &= c == c[-1]
        cut = int(np.argmax(open_run)) if open_run.any() else len(open_run)
        closed = np.nonzero(~open_run)[0]
        cut = int(closed[-1]) + 1 if len(closed) else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield links([c[:cut] for c in columns])
    if held is not None and len(held[0]):
        yield links(held)


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, hot: int = HOT_KEY) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at most ``radius`` bits apart, enough to connect all that are linked.

    Two linked fingerprints agree on all but ``radius`` of m blocks, so each is keyed by every choice of m - radius
    blocks (m grows with the count, so that a key holds a few), and only those under one key meet. There the pivot table
    drops a pair whose distances to some pivot differ by more than the radius, and the survivors are verified. A key
    with more than ``hot`` fingerprints is keyed again by blocks of its other bits. Input: distinct values ``fp``.
    """
    count = fps.count()
    blocks = 6 if count < 1 << 24 else 7 if count < 1 << 30 else 8
    masks = block_masks(blocks, radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    crowded = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("t", "k", F.lit(True).alias("crowded"))
    marked = keyed.join(crowded, ["t", "k"], "left")
    finer = F.lit(None).cast("array<bigint>")
    for t, mask in enumerate(masks):
        rest = block_masks(6, radius, allowed=~mask & ((1 << 64) - 1))
        finer = F.when(F.col("t") == t, F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in rest])).otherwise(finer)
    sub = F.when(F.col("crowded"), F.transform(finer, lambda x, i: F.struct(i.cast("long").alias("s"), x.alias("x")))).otherwise(
        F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("x"))))
    ready = marked.select(F.col("t").cast("long").alias("t"), "k", F.explode(sub).alias("sub"), "fp").select("t", "k", "sub.s", "sub.x", "fp")
    return (ready.repartition("t", "k", "s", "x").sortWithinPartitions("t", "k", "s", "x", "fp")
            .mapInArrow(_link_runs, "a long, b long").distinct())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; large-star and small-star steps, each written."""
    pairs = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda frame: tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(pairs)
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(lows.select("u", F.col("m").alias("v")))).distinct()
        pairs = written(small, "stars")
        now = mark(pairs)
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def labelled_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, low, root): the component of every distinct fingerprint ``fp``, named by one of its fingerprints."""
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``key``, signed ``fp`` and ``component_id`` (the smallest key reachable over links) of every row.

    Equal fingerprints are one node, so copies cost one row each and no pair. Rows without words have fingerprint 0
    and are linked like any other. Null keys are skipped by the minimum; a component of null keys only has a null id.
    Repeated rows stay; an empty table gives no rows; other columns are not looked at.
    """
    marked = written(fingerprints(documents, key, text), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min(f"`{key}`").alias("low")), "nodes")
    rooted = labelled_fingerprints(nodes, radius)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.join(lows, "root").select("fp", "component_id")
    return marked.join(ids, "fp").select(F.col(f"`{key}`"), "fp", "component_id")


def _record_names(columns: list[str]) -> list:
    """Two 64-bit hashes of a whole row with unlike seeds; a null column counts as such."""
    parts = [x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "i1"), (2, "i2"))]


def one_of_each_group(documents: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents with all their columns, one row of each component: that of the smallest key (null is smallest), of
    unlike rows that share it the one whose 128-bit hash is least, of equal rows one.

    Rows are told apart by their contents, not by numbers that change with the splits of a scan, so no numbered copy of
    the documents has to be written.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"), *_record_names(documents.columns))
    ids = rows.select(F.struct(F.col(f"record.`{key}`").alias("key"), "i1", "i2").alias("id"), F.col(f"record.`{text}`").alias("text"))
    nodes = written(fingerprints(ids, "id", "text").groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    stay = labelled_fingerprints(nodes, radius).groupBy("root").agg(F.min("low").alias("low")).select("low.i1", "low.i2")
    return rows.join(stay, ["i1", "i2"], "left_semi").dropDuplicates(["i1", "i2"]).select("record.*")
