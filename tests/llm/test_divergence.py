"""Source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import divergence

from .cases import CLASHES


def frame(spark, rows):
    schema = "doc_id long, text string, lang string, source string" + "".join(f", `{c}` string" for c in CLASHES)
    return spark.createDataFrame([(i, *r, *("x" for _ in CLASHES)) for i, r in enumerate(rows)], schema)


def plain(rows, least, top=50):
    docs = [(lang or "", source or "", ["".join(c.lower() if "A" <= c <= "Z" else c for c in w)
                                        for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(w for _, _, words in own for w in set(words))
        kept = sorted(w for w in seen if seen[w] >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if w in set(kept))
        total = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(total)
        for s in p:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in p if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def corpus(seed, n):
    pick = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "naïve", "x1y", "Straße", "日本", "of", "a", "zeta", "Ω"] + [f"w{chr(97 + i)}{chr(97 + i % 5)}" for i in range(26)]
    rows = []
    for i in range(n):
        source = pick.choice(["s1", "s2", "s3", "s3", "s3", "s4", None])
        lang = pick.choice(["en", "en", "fr", None])
        text = " ".join(pick.choice(words[: 12 + 26 * (source == "s3")]) + pick.choice(["", ".", ",\n", "-"]) for _ in range(pick.randint(0, 40)))
        rows.append((text, lang, source))
    return rows + [(None, "en", "silent"), ("", "de", "a"), ("12 34", "de", "b"), (None, None, None), ("Hallo", "nl", "one"), rows[0], rows[0]]


@pytest.mark.parametrize("least,top", [(3, 50), (30, 50), (1, 2)])
def test_equals_plain(spark, least, top):
    rows = corpus(1, 300)
    got = divergence.source_divergence(frame(spark, rows).repartition(5), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_small_chunks_and_flushes(spark, monkeypatch):
    rows = corpus(2, 200)
    monkeypatch.setattr(divergence, "CHUNK_CELLS", 7)
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 3)
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    assert sorted(map(tuple, divergence.source_divergence(frame(spark, rows), 5).collect())) == plain(rows, 5)


def test_empty_table(spark):
    assert divergence.source_divergence(frame(spark, corpus(1, 3)).filter("false")).count() == 0


def test_long_text(spark):
    rows = [("lang " * 60_000 + "x" * 50_000, "en", "a"), ("lang other", "en", "b")]
    assert sorted(map(tuple, divergence.source_divergence(frame(spark, rows), 1).collect())) == plain(rows, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 10**12)), min_size=1, max_size=30), st.integers(1, 10**14))
def test_runs_and_shares(values, total):
    a, b = (np.array(x, np.int64) for x in zip(*values))

    def runs(x):
        heads = np.concatenate([[0], np.nonzero(np.diff(x))[0] + 1])
        return np.append(heads[1:], len(x)), x[heads]

    assert divergence.run_distance(*runs(a), *runs(b)) == int(np.abs(a - b).sum())
    assert divergence.exact_shares(a, total).tolist() == [1 + 1_000_000_000 * (n + 5) // total for n in a.tolist()]
