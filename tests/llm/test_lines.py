"""Line dedup against plain Python."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import lines

from .cases import awkward, documents, prose


def plain(rows, min_chars=20, min_documents=3):
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            holders[fold(line)].add(k)
    low = lambda k: (k is not None, k or 0)
    top = {key: max(ids, key=low) for key, ids in holders.items() if len(key) >= min_chars and len(ids) >= min_documents}
    out = []
    for k, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if top.get(fold(x), k) == k]
        out.append((k, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


COMMON = "  A line that Many documents hold\t"
ODD = [(20, "one\n" + COMMON + "\nend"), (21, COMMON.lower() + "\n" + COMMON), (22, "x\n\n" + COMMON + "\n" + COMMON.upper() + "\n"), (23, COMMON),
       (24, "short line\nshort line"), (25, "short line"), (26, "short line"), (27, "\n\n"), (28, "É" * 20 + "\nb"), (29, "É" * 20), (30, "É" * 20 + "\r\nc"),
       (31, "é" * 20), (32, "only twice, but long enough"), (33, "only twice, but long enough"), (None, COMMON + "\nno id"), (None, "third of a kind, no id\nthird of a kind, no id"),
       (34, "third of a kind, no id"), (35, "x\nthird of a kind, no id\ny"), (36, None), (37, ""), (38, "\x0b\x0c" + "w" * 20 + "\x85"), (39, "w" * 20), (22, "x\n\n" + COMMON + "\n" + COMMON.upper() + "\n"),
       (23, "another text of that id\n" + COMMON)]


def run(spark, rows, **more):
    out = lines.deduplicated_lines(documents(spark, rows).repartition(3), **more)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return Counter(map(tuple, out.collect()))


def test_equals_plain(spark):
    rows = ODD + awkward()
    assert run(spark, rows) == Counter(plain(rows))
    assert run(spark, rows, min_chars=5, min_documents=2) == Counter(plain(rows, 5, 2))
    assert run(spark, rows, min_chars=0, min_documents=1) == Counter(plain(rows, 0, 1))


def test_hot_and_cold_names(spark, monkeypatch):
    """A line in a third of the documents goes by broadcast, rare ones by the join; both ways alone give the same."""
    rows = [(i, "\n".join(([COMMON] if i % 3 == 0 else []) + [prose(i // 4, 12), prose(i, 9)])) for i in range(300)]
    want = Counter(plain(rows))
    assert run(spark, rows) == want
    for share in (0, 1):
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        assert run(spark, rows) == want


def test_a_long_text(spark):
    long = "\n".join(prose(i % 3000, 6) + "-" * 20 for i in range(30_000))
    rows = [(1, long), (2, long), (3, long + "\nlast"), (4, "x" * 300_000)]
    assert run(spark, rows) == Counter(plain(rows))


def test_whole_documents(spark):
    frame = documents(spark, ODD)
    out = lines.without_crowded_lines(frame)
    assert out.columns == frame.columns
    assert Counter((r.doc_id, r.text, r.key) for r in out.collect()) == Counter((k, t, "x") for k, _, _, t in plain(ODD))


def test_empty_table(spark):
    assert lines.deduplicated_lines(documents(spark, ODD).filter("false")).count() == 0


def test_query_digest(spark):
    got = lines.deduplicated_lines(documents(spark, ODD)).select("doc_id", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    assert Counter(map(tuple, got.collect())) == Counter((k, hashlib.sha256(t.encode()).hexdigest()) for k, _, _, t in plain(ODD))
