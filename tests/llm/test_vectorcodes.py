"""Cover trees and codebooks against plain integer arithmetic."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code string, error string, salt int, own int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", 1, 2) for r in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2, scale=256):
    """(id, code, error, label) of every kept row and the final books, one part and row at a time."""
    kept = [(k, [math.floor(scale * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = len(kept[0][1]) // parts
    books = [[v[p * step:(p + 1) * step] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in kept:
                x = v[p * step:(p + 1) * step]
                groups[nearest(x, book)[1]].append(x)
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if groups[i] else e for i, e in enumerate(book)]
    out = []
    for k, v, lab in kept:
        best = [nearest(v[p * step:(p + 1) * step], book) for p, book in enumerate(books)]
        out.append((k, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), lab))
    return out, books


def vectors(seed, n, width=32, spread=0.2):
    pick = random.Random(seed)
    centers = [[pick.gauss(0, 0.3) for _ in range(width)] for _ in range(12)]
    return [(i, [float(np.float32(c + pick.gauss(0, spread))) for c in centers[i % 12]], pick.choice([0, 1, 2, None])) for i in range(n)]


def check(spark, rows, **more):
    coded, books = vectorcodes.vector_codes(frame(spark, rows).repartition(3), **more)
    want, want_books = plain(rows, **more)
    assert [b.tolist() for b in books] == want_books
    got = sorted(map(tuple, coded.select("vec_id", "code", "error", "label").collect()), key=str)
    assert got == sorted(want, key=str)
    return coded, books, want


@pytest.mark.parametrize("spread", [0.001, 0.05, 0.3])
def test_equals_plain(spark, spread):
    """Close clusters settle as whole subtrees, loose ones go down to points."""
    coded, _, want = check(spark, vectors(1, 400, spread=spread))
    sums = defaultdict(int)
    for _, _, e, lab in want:
        sums[lab] += e
    rows = vectorcodes.with_label_errors(coded).collect()
    assert len(rows) == len(want) and all(r.label_error == sums[r.label] for r in rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = vectors(2, 90, width=16)
    same = [1.0] * 16
    rows = base + [(1000, None, 1), (1001, [nan] + same[1:], 1), (1002, [inf] + same[1:], 1), (1003, [-inf] + same[1:], None), (1004, [None] + same[1:], 1),
                   (None, same, None), (None, None, None), (5, same, 2), (5, base[5][1], 2), (7, same, None)] + [(2000 + i, same, 3) for i in range(60)] + base[:3]
    check(spark, rows)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [x / 256.0] * 16, 0) for i, x in enumerate([0, 4, 2, 2, 2, 6, 4, 0, 3])]
    check(spark, rows, entries=2, rounds=1)
    check(spark, rows, entries=4, rounds=3)


def test_few_and_none(spark):
    check(spark, vectors(3, 5, width=16))
    empty, books = vectorcodes.vector_codes(frame(spark, vectors(3, 5)).filter("false"))
    assert books == [] and vectorcodes.with_label_errors(empty).count() == 0 and vectorcodes.books_digest([])
    nothing, books = vectorcodes.vector_codes(frame(spark, [(1, None, 1)]))
    assert nothing.count() == 0 and books == []


def test_empty_vectors_and_large_numbers(spark):
    check(spark, [(i, [], i % 2) for i in range(4)])
    check(spark, [(i, [float(np.float32(x * 1e5 + i)) for x in v], lab) for i, v, lab in vectors(4, 80, width=16)])
    with pytest.raises(Exception, match="squared distances"):
        vectorcodes.vector_codes(frame(spark, [(1, [1e30] * 16, 1)]))
    with pytest.raises(Exception, match="one length"):
        vectorcodes.vector_codes(frame(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)]))


def test_many_blocks_give_one_result(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BLOCK", 37)
    check(spark, vectors(5, 200, width=16))


@pytest.mark.parametrize("seed,kind", [(0, "spread"), (1, "close"), (2, "equal"), (3, "line")])
def test_tree_covers_and_separates(seed, kind):
    pick = np.random.default_rng(seed)
    points = {"spread": pick.integers(-500, 500, (700, 3)), "close": pick.integers(0, 3, (700, 3)), "equal": np.full((50, 3), 7),
              "line": np.repeat(pick.integers(0, 10**6, (300, 1)), 3, axis=1)}[kind]
    order, nodes = vectorcodes.cover_tree(points, leaf=4)
    placed = points[order]
    assert sorted(order.tolist()) == list(range(len(points)))
    for node in nodes:
        own = placed[node["first"]:node["last"]]
        gap = np.sqrt(((own - placed[node["center"]]) ** 2).sum(axis=1).max())
        assert abs(gap - node["radius"]) < 1e-6
        assert node["first"] <= node["center"] < node["last"], "a center lies below its own node"
        if node["low"] < node["high"]:
            below = nodes[node["low"]:node["high"]]
            assert below["first"][0] == node["first"] and below["last"][-1] == node["last"] and (below["first"][1:] == below["last"][:-1]).all()
    # levels: nested centers, pairwise farther apart than the farthest point of the next level is from its nearest center
    level, at = nodes[:1], 0
    while level["low"][0] < level["high"][0]:
        below = nodes[level["low"][0]:level["high"][-1]]
        assert set(level["center"]) <= set(below["center"])
        c = placed[level["center"]]
        if len(c) > 1:
            apart = ((c[:, None] - c[None]) ** 2).sum(axis=2)
            cover = ((placed[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).max()
            assert apart[np.triu_indices(len(c), 1)].min() >= cover
        level, at = below, at + 1


def test_subtrees_are_assigned_whole():
    """Far clusters: nearly all points are settled without being looked at."""
    pick = np.random.default_rng(5)
    points = (pick.integers(0, 8, (4000, 1)) * 10_000 + pick.integers(0, 50, (4000, 4))).astype(np.int64)
    part = vectorcodes.CoveredPart(points, *vectorcodes.cover_tree(points))
    book = np.repeat(np.arange(8)[:, None] * 10_000 + 20, 4, axis=1)
    ranges, _, places, _ = part.assigned(book)
    assert len(places) == 0 and len(ranges) < 50
    codes, errors = part.codes(book)
    assert (codes == ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert (errors == ((points - book[codes]) ** 2).sum(axis=1)).all()
