"""Counts against plain Python; verdicts on labelled documents."""

import re

import pytest

from tidemark.llm import quality

from .cases import awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def test_counts_equal_plain(spark):
    line = prose(7, 12)
    rows = awkward()[:9] + [(20, "\n".join([line] * 4 + [prose(8, 30)])), (21, "a b c d e f g h a b c d e f g h i"), (22, "| x " * 40)]
    packed = documents(spark, rows).select("doc_id", "text")
    got = sorted(map(str, [tuple(r)[:6] for r in quality.quality_flags(packed, keep=[]).select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]))
    assert got == sorted(str(plain(t)) for _, t in rows)


@pytest.mark.parametrize("text,kept", [
    (prose(1, 100), True), (None, False), ("", False), ("the of and " * 3, False),
    (" ".join(w + "***" for w in prose(2, 100).split()), False), (prose(3, 100).upper().replace(" ", "!! "), False),
    (" | ".join(f"cell{i}" for i in range(80)), False), ("\n".join([prose(4, 9)] * 9), False)])
def test_verdicts(spark, text, kept):
    out = quality.accepted(documents(spark, [(1, text)]))
    assert out.count() == int(kept) and out.columns[:2] == ["doc_id", "text"] and "kept" in out.columns


def test_empty_and_clashes(spark):
    frame = documents(spark, awkward())
    assert quality.accepted(frame).columns == frame.columns
    assert quality.accepted(frame.filter("false")).count() == 0


def test_labelled_documents_agree(spark):
    folder = "/root/testdata/sf0.01"
    flags = quality.quality_flags(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = flags.filter("not base_failed").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.97
    clean = [r.kept for r in rows if r.quality == 1]
    assert sum(clean) / len(clean) > 0.99
