"""Held-out accuracy, leakage and degenerate labels."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import toxicity

from .cases import awkward, documents, prose

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.toxicity_scores(docs, labels, limit=8000).join(labels, "doc_id").collect()


def test_held_out_accuracy(scored):
    rows = [r for r in scored if r.held_out]
    toxic = [r for r in rows if r.toxic == 1]
    flagged = [r for r in rows if r.predicted == 1]
    # A few hundred toxic rows in four languages to learn from; accuracy grows with the labels.
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8
    assert sum(r.toxic for r in flagged) / len(flagged) > 0.9


def test_held_out_rule(scored):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def small(spark, flip=False):
    rows = [(i, prose(i, 20) + (" you idiot, " if i % 2 else " ") + prose(i + 9000, 20)) for i in range(400)]
    labels = [(i, 0, (i % 2) if zlib.crc32(str(i).encode()) % 5 else (1 - i % 2 if flip else i % 2)) for i in range(400)]
    return documents(spark, rows + awkward()[:7] + [(998, prose(7, 6000)), (999, prose(7, 6000) + " you idiot, ")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_labels_are_not_read(spark):
    one, two = (sorted(map(str, toxicity.toxicity_scores(*small(spark, flip)).collect())) for flip in (False, True))
    assert one == two


def test_long_null_and_repeated(spark):
    out = toxicity.toxicity_scores(*small(spark))
    rows = out.collect()
    assert len(rows) == 409 and out.columns == ["doc_id", "held_out", "score", "predicted"]
    score = {r.doc_id: r.score for r in rows}
    assert score[999] > score[998]  # the end of a long text counts
    assert all(r.score is not None for r in rows) and [r.held_out for r in rows if r.doc_id is None] == [False, False]


def test_one_class_none_and_empty(spark):
    docs, labels = small(spark)
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.filter("toxic = 1")).collect()} == {1}
    assert {r.predicted for r in toxicity.toxicity_scores(docs, labels.filter("false")).collect()} == {0}
    assert toxicity.toxicity_scores(docs.filter("false"), labels).count() == 0


def test_chunks_lose_no_gram(monkeypatch):
    text = prose(1, 500).encode()
    whole = set(toxicity.present(text).tolist())
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert set(toxicity.present(text).tolist()) == whole


def test_long_text_lights_no_feature_by_chance():
    """A long text lights the features that it has, however many n-grams it holds."""
    words = [f"idiot{i:04d}"[:8].encode() for i in range(0, 10000, 10)]
    features = np.unique(np.concatenate([toxicity.present(w) for w in words]))
    model = toxicity.Weights(features, np.ones(len(features)), 0.0)
    pick = random.Random(5)
    text = "".join(pick.choice("bcfghjklmnpqrsuvwxyz ") for _ in range(300_000)).encode()
    own = set(toxicity.present(text).tolist())
    assert len(own) > 500_000
    assert set(features[model.lit(text)].tolist()) == own & set(features.tolist())
    assert toxicity.SIZES == (3, 4, 5, 6, 7, 8) and toxicity.MAX_FEATURES == 8000


def test_grams_are_bytes():
    want = {int.from_bytes(b" a\xff\xc3\xa4b "[i:i + k]) for k in range(3, 9) for i in range(8 - k)}
    assert set(toxicity.present("A\0Äb".encode()).tolist()) == want
