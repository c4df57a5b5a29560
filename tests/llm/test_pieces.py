"""Sampling against all segmentations of short units; round trips; reproducibility."""

import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import pieces

from .cases import awkward, documents


@pytest.fixture(scope="module")
def lattice():
    return pieces.PieceLattice()


def segmentations(lattice, unit):
    if not unit:
        yield (), 0.0
        return
    for n in range(1, min(len(unit), lattice.longest) + 1):
        piece = lattice.vocabulary.get(unit[:n])
        if piece:
            for rest, weight in segmentations(lattice, unit[n:]):
                yield (piece[0], *rest), piece[1] + weight


@pytest.mark.parametrize("unit", [" the", " then", "ing", " x"])
def test_sampled_as_often_as_likely(lattice, unit):
    every = dict(segmentations(lattice, unit))
    total = sum(map(math.exp, every.values()))
    n = 20_000
    texts = [unit[1:] if unit[0] == " " else "\n" + unit] * n
    ids, counts = lattice.sample(texts, [pieces.row_seed(i, 1) for i in range(n)])
    at, seen = 0, Counter()
    for c in counts.tolist():
        own = tuple(ids[at:at + c].tolist())
        seen[own if unit[0] == " " else own[2:]] += 1
        at += c
    assert set(seen) <= set(every)
    for s, w in every.items():
        p = math.exp(w) / total
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_many_at_once_equals_one_by_one(lattice):
    units = [" the", " internationalization", "ouieaux", " x", "  ab", " Eéauxñ"]
    fresh = pieces.PieceLattice()
    fresh._store_plain(units)
    for u in units:
        first, last = fresh.low[fresh.at[u]], fresh.high[fresh.at[u]]
        made = lattice.lattice(u)
        assert last - first + 1 == len(made)
        for k, incoming in enumerate(made):
            for i, (share, token, back) in enumerate(incoming):
                e = fresh.first[first + k] + i
                assert (fresh.token[e], fresh.back[e]) == (token, back) and abs(fresh.share[e] - share) < 1e-5


def test_round_trip_and_reproducible(spark):
    frame = documents(spark, awkward())
    rows = pieces.round_trips(frame).collect()
    assert len(rows) == len(awkward()) and all(r.lossless for r in rows)
    again = pieces.round_trips(frame.repartition(3)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert pieces.round_trips(frame, seed=7).collect() != rows
    assert [r.n_pieces for r in rows if r.doc_id in (1, 2)] == [0, 0]
    same = [r.ids_sha256 for r in rows if r.doc_id == 4]
    assert len(set(same)) == 1


def test_encode_then_decode(spark):
    frame = documents(spark, [(k, t) for k, t in awkward() if k is not None and k != 4])
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(frame)).collect()}
    assert back == {r.doc_id: r.text or "" for r in frame.collect()}


def test_other_key_other_sample(lattice):
    text = "segmentation of reasonable length with many ways " * 5
    ids, counts = lattice.sample([text, text], [pieces.row_seed(1, 42), pieces.row_seed(2, 42)])
    assert not np.array_equal(ids[:counts[0]], ids[counts[0]:])


def test_empty_table(spark):
    assert pieces.round_trips(documents(spark, awkward()).filter("false")).count() == 0


def test_store_starts_afresh(monkeypatch, lattice):
    monkeypatch.setattr(pieces, "STORE_BYTES", 10)
    small = pieces.PieceLattice()
    for text in ("some words here", "other words there", "some words here"):
        a, _ = small.sample([text], [3])
        b, _ = lattice.sample([text], [3])
        assert a.tolist() == b.tolist()


def test_spans_of_units_do_not_show(monkeypatch, lattice):
    """A text longer than a span of units gives the ids it would give at once, whatever the store forgets in between."""
    texts = ["one two three four five six seven " * 30, "", "ouieaux 😀 ▁ x" * 20]
    want, counts = lattice.sample(texts, [1, 2, 3])
    monkeypatch.setattr(pieces, "SPAN_UNITS", 7)
    monkeypatch.setattr(pieces, "STORE_BYTES", 2000)
    small = pieces.PieceLattice()
    got, own = small.sample(texts, [1, 2, 3])
    assert got.tolist() == want.tolist() and own.tolist() == counts.tolist()


def test_store_keeps_its_bound(monkeypatch):
    """Ever new words: what is held never passes the bound by more than one span of units."""
    monkeypatch.setattr(pieces, "STORE_BYTES", 1 << 20)
    monkeypatch.setattr(pieces, "SPAN_UNITS", 500)
    small, most = pieces.PieceLattice(), 0
    for i in range(40):
        small.sample([" ".join(f"word{i}x{k}" for k in range(1000))], [i])
        arrays = sum(getattr(small, c).nbytes for c in ("low", "high", "first", "share", "token", "back"))
        most = max(most, arrays + pieces.UNIT_BYTES * len(small.at))
    assert small.held < (1 << 20) + (1 << 19) and most < 3 << 20


def test_round_trips_with_ids(spark):
    frame = documents(spark, awkward())
    rows = pieces.round_trips(frame, with_ids=True).collect()
    ids = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode(frame).collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == ids and all(r.n_pieces == len(r.ids) for r in rows)
