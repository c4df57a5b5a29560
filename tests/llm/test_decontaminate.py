"""Hits against a plain search; the joined way equals the broadcast one."""

import re

import pytest

from tidemark.llm import decontaminate

from .cases import awkward, documents, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    own, hit, found = words(text), set(), set()
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        if not n:
            continue
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
        for i in range(len(own) - n + 1):
            if tuple(own[i:i + n]) in windows:
                hit.update(range(i, i + n))
                if k is not None:
                    found.add(k)
    return len(own), len(hit), len(found), decontaminate.items_digest(found), len(hit) > 0 and 20 * len(hit) >= len(own)


A, B = prose(50, 40), prose(51, 17)
ITEMS = [(10, A), (2, B), (3, "Éa! two, THREE"), (4, None), (5, " .,"), (6, A), (7, "lonely")]
ROWS = awkward() + [(20, prose(60, 30) + " " + A.upper().replace(" ", " -- ") + " " + prose(61, 900)), (21, B[5:]), (22, " ".join(B.split()[:12])),
                    (23, "x éa two three y"), (24, "x Éa two three y"), (25, prose(1, 5) + " LONELY " + B + B), (26, A[:-1] + B)]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_WORDS, 0])
def test_hits_equal_plain(spark, limit):
    hits = decontaminate.benchmark_hits(documents(spark, ROWS), benchmark(spark), max_words=limit)
    got = sorted(str(tuple(r)) for r in decontaminate.report(hits).collect())
    assert got == sorted(str((k, *plain(t, ITEMS))) for k, t in ROWS)


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_WORDS, 0])
def test_documents_removed(spark, limit):
    frame = documents(spark, ROWS)
    out = decontaminate.decontaminated(frame, benchmark(spark), max_words=limit)
    assert out.columns == frame.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(k) for k, t in ROWS if not plain(t, ITEMS)[-1])


@pytest.mark.parametrize("limit", [decontaminate.MAX_BROADCAST_WORDS, 0])
def test_spans_removed(spark, limit):
    frame = documents(spark, [(1, "One two. " + B + " Three!"), (2, None), (3, "Éa, two three; four")])
    out = decontaminate.decontaminated(frame, benchmark(spark), mode="spans", max_words=limit)
    assert out.columns == frame.columns
    assert {r.doc_id: (r.text, r.key) for r in out.collect()} == {1: ("One two. . Three!", "x"), 2: (None, "x"), 3: ("; four", "x")}


def test_spans_are_the_same_beyond_the_bound(spark):
    frame = documents(spark, ROWS)
    texts = lambda limit: sorted(str((r.doc_id, r.text)) for r in decontaminate.decontaminated(frame, benchmark(spark), mode="spans", max_words=limit).collect())
    assert texts(decontaminate.MAX_BROADCAST_WORDS) == texts(0)


def test_empty_tables(spark):
    frame = documents(spark, ROWS)
    assert decontaminate.benchmark_hits(frame.filter("false"), benchmark(spark)).count() == 0
    none = decontaminate.report(decontaminate.benchmark_hits(frame, benchmark(spark).filter("false")))
    assert {r.n_hit for r in none.collect()} == {0}
