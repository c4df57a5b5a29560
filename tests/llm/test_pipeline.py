"""The pipeline's stages against their plain versions, and the entry's guard."""

import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import plans

from .test_decontaminate import plain as plain_hits
from .test_quality import plain as plain_counts
from .test_repeats import brute
from .test_simhash import plain_fingerprint, plain_groups

FOLDER = "/root/testdata/sf0.001"


def test_eleven_queries():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Every stage's input and output, written between stages."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(i)))
        done = spark.read.parquet(str(folder / str(i)))
        out.append((docs, done))
        docs = done
    return out


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"] == before.columns


def test_quality(steps):
    before, after = steps[0]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        if plain_counts(r.text)[-1]:
            assert r.doc_id not in kept
    assert 0.6 * before.count() < len(kept) < before.count()


def test_near_duplicates(steps):
    rows = sorted(steps[1][0].collect(), key=lambda r: r.doc_id)
    groups = plain_groups([plain_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in steps[1][1].collect()) == [rows[g].doc_id for g in sorted(set(groups))]


def test_repeats(steps):
    rows = steps[2][0].collect()
    after = {r.doc_id: r.text for r in steps[2][1].collect()}
    assert len(after) == len(rows)
    for r, (_, removed, _, digest) in zip(rows, brute([r.text for r in rows])):
        left = after[r.doc_id].encode()
        # a span that cuts a character keeps it, so a few bytes may stay
        assert hashlib.sha256(left).hexdigest() == digest or 0 < len(left) - (len(r.text.encode()) - removed) < 8


def test_passages_below_400_bytes(spark, tmp_path):
    """A passage of 51 words and under 400 bytes in many documents is in none of them after the third stage."""
    passage = " ".join(f"w{i}" for i in range(51))
    rows = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.doc_id % 4 == 0]
    planted = [r.asDict() | {"text": f"{r.text}\n{passage}\n"} for r in rows]
    spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "planted"))
    docs = spark.read.parquet(str(tmp_path / "planted"))
    for i, stage in enumerate(f for _, f in corpus_pipeline.STAGES[1:3]):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    left = [r.text for r in docs.collect()]
    assert len(passage) < 400 and len(left) > 20 and not any(passage in t for t in left)


def test_written_texts_are_packed(spark, monkeypatch, tmp_path):
    """The second stage's texts lie beside the third's shuffles, so they are packed more closely than Spark's default."""
    monkeypatch.setattr("tidemark.llm.common.shared_folder", lambda _: str(tmp_path))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    for name in ("one-of-each", "suspects"):
        files = list(tmp_path.glob(f"{name}-*/part-*.parquet"))
        assert files and all(f.name.endswith(".zstd.parquet") for f in files)


def test_decontamination(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r.doc_id for r in steps[3][0].collect() if not plain_hits(r.text, items)[-1]}
    assert {r.doc_id for r in steps[3][1].collect()} == want


def test_pieces_and_run(spark, steps):
    before, after = steps[4]
    assert after.count() == before.count() and after.filter("not lossless").count() == 0
    told = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == told
    run = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, after.collect()))


def test_null_and_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    odd = docs.unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(3))
    odd = odd.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("doc_id")))
    for start, name in ((odd, "odd"), (odd.filter("false"), "none")):
        frame = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            frame.write.parquet(str(tmp_path / f"{name}{i}"))
            frame = stage(spark, spark.read.parquet(str(tmp_path / f"{name}{i}")), FOLDER)
        assert frame.filter("not lossless").count() == 0
