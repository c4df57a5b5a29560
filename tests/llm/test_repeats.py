"""Removed bytes against a brute-force search of all strings of 400 bytes."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import repeats

from .cases import awkward, documents, prose


def brute(texts):
    """Per text: bytes, bytes removed, removed runs, digest of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, int)
        for i in range(len(d) - 399):
            if seen[d[i:i + 400]] > 1:
                cover[i] = max(cover[i], 1)
        hit = np.zeros(len(d), bool)
        for i in np.nonzero(cover)[0]:
            hit[i:i + 400] = True
        rest = bytes(b for b, h in zip(d, hit) if not h)
        runs = int(np.sum(np.diff(np.concatenate([[0], hit.astype(int)])) == 1))
        out.append((len(d), int(hit.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def compare(spark, rows):
    out = repeats.repeated_bytes(documents(spark, rows)).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)
    assert got == Counter((k, *b) for (k, _), b in zip(rows, brute([t for _, t in rows])))


def test_awkward(spark):
    compare(spark, awkward())


@pytest.mark.parametrize("seed", range(6))
def test_planted_passages(spark, seed):
    """Passages of 380 to 900 bytes, edited here and there, at the ends and in the middle, overlapping, in one text twice."""
    pick = random.Random(seed)
    passages = [prose(1000 * seed + i, pick.randint(60, 150)) for i in range(4)]
    rows = []
    for i in range(25):
        parts = [prose(5000 + 100 * seed + 10 * i + k, pick.randint(0, 60)) for k in range(3)]
        for k in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            a = pick.randint(0, 80)
            p = p[a:len(p) - pick.randint(0, 80)]
            if pick.random() < 0.3:
                at = pick.randint(0, len(p))
                p = p[:at] + pick.choice(["é", "", "#"]) + p[at + 1:]
            parts.insert(pick.randint(0, len(parts)), p)
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[1][1][:-1]), (102, "z" + rows[1][1])]
    compare(spark, rows)


@pytest.mark.parametrize("unit", ["a", "ab", "abcdefg", prose(5, 9)])
def test_periodic_texts(spark, unit):
    text = (unit * 900)[:1500]
    compare(spark, [(1, text), (2, text[3:900]), (3, text[:399]), (4, text[:400]), (5, prose(1, 200) + text[:420])])


def test_without_repeats_keeps_columns_and_characters(spark):
    shared = "é" * 30 + prose(3, 100)
    rows = [(1, "ü" + shared + prose(1, 20)), (2, "ö" + shared + prose(2, 20)), (3, None), (4, prose(9, 30))]
    frame = documents(spark, rows)
    out = repeats.without_repeats(frame)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == frame.columns and len(got) == 4
    assert got[4].text == rows[3][1] and got[3].text == "" and got[1].n_chars == len(got[1].text)
    assert prose(1, 20) in got[1].text and prose(3, 100)[5:] not in got[1].text and got[1].key == "x"


def brute_passages(texts):
    """The same for 51 consecutive words that start anywhere else too, with the white space between them."""
    data = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", d)] for d in data]
    runs = [[tuple(d[a:b] for a, b in w[i:i + 51]) for i in range(len(w) - 50)] for d, w in zip(data, words)]
    seen, rows = Counter(r for x in runs for r in x), Counter(data)
    out = []
    for d, w, r in zip(data, words, runs):
        hit = np.zeros(len(d), bool)
        for i, x in enumerate(r):
            hit[w[i][0]:w[i + 50][1]] |= seen[x] > 1
        hit |= rows[d] > 1 and len(w) > 50
        out.append((len(d), int(hit.sum()), int(np.sum(np.diff(np.concatenate([[0], hit.astype(int)])) == 1)),
                    hashlib.sha256(bytes(b for b, h in zip(d, hit) if not h)).hexdigest()))
    return out


def short_words(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 5))) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_over_50_words_below_400_bytes(spark, seed):
    """Passages of 45 to 60 short words, with other white space, edited words, at the ends, in one text twice."""
    pick = random.Random(seed)
    passages = [short_words(10 * seed + i, pick.randint(45, 60)) for i in range(6)]
    assert all(len(p.encode()) < 400 for p in passages)
    rows = [] if seed else awkward()
    for i in range(40):
        parts = [short_words(1000 + 100 * seed + 3 * i + k, pick.randint(0, 70)) for k in range(3)]
        for k in range(pick.randint(0, 3)):
            p = pick.choice(passages).split(" ")
            if pick.random() < 0.3:
                p[pick.randrange(len(p))] += "x"
            parts.insert(pick.randint(0, len(parts)), pick.choice([" ", "\n", " \t"]).join(p))
        rows.append((100 + i, " ".join(parts)))
    rows += [(500, passages[0] + "\n" + passages[0]), (501, passages[1]), (502, passages[1]), (503, " ".join(["ü"] * 70)), (504, "ab " * 90)]
    out = repeats.repeated_bytes(documents(spark, rows), passages=True).collect()
    want = brute_passages([t for _, t in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == Counter((k, *b) for (k, _), b in zip(rows, want))


def test_without_repeats_cuts_a_short_passage(spark):
    passage = short_words(7, 51)
    rows = [(k, short_words(50 + k, 30) + f"\n{passage} " + short_words(70 + k, 30)) for k in range(3)]
    got = {r.doc_id: r.text for r in repeats.without_repeats(documents(spark, rows), passages=True).collect()}
    assert got == {k: t.replace(passage, "") for k, t in rows} and len(passage.encode()) < 400


def test_empty_table(spark):
    assert repeats.repeated_bytes(documents(spark, awkward()).filter("false")).count() == 0


def test_cuts_depend_on_nearby_bytes_only():
    pick = np.random.default_rng(1)
    middle = pick.integers(97, 107, 400).astype(np.uint8)
    a = repeats.cuts(np.concatenate([pick.integers(97, 107, 500).astype(np.uint8), middle, pick.integers(97, 107, 90).astype(np.uint8)])) - 500
    b = repeats.cuts(np.concatenate([pick.integers(97, 107, 77).astype(np.uint8), middle])) - 77
    zone = lambda x: [int(v) for v in x if repeats.SPAN - 1 <= v <= repeats.LENGTH + 1 - repeats.SPAN - repeats.GRAM]
    assert zone(a) == zone(b) and len(zone(a)) >= 3
    assert np.diff(a).max() <= repeats.SPAN


@pytest.mark.parametrize("seed", range(5))
def test_suffix_names_meet_every_equal_pair(seed):
    """Suffixes with equal needed letters share a name in some list, whatever their places modulo 3."""
    pick = np.random.default_rng(seed)
    letters = pick.integers(0, 3, 300).astype(np.uint64)
    text, at = np.repeat([1, 2, 3], 100).astype(np.uint64), np.tile(np.arange(100), 3)
    need = np.full(300, int(pick.integers(3, 12)))
    named = repeats.suffix_names(text, at, letters, need)
    lists: dict = {}
    for r in named:
        lists.setdefault((int(r["text"]), int(r["at"])), set()).add(int(r["name"]))
    n = int(need[0])
    whole = [(t, i) for t in range(3) for i in range(100 - n + 1)]
    word = {(t, i): tuple(letters[100 * t + i:100 * t + i + n]) for t, i in whole}
    for a in whole[::7]:
        for b in whole:
            if a < b and word[a] == word[b]:
                assert lists[a[0] + 1, a[1]] & lists[b[0] + 1, b[1]]
