"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark decontamination, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, pieces, quality, repeats, simhash
from tidemark.llm.common import table, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id, without the passages of over 50
    words that are left in several places: shorter ones than 400 bytes pass the next stage.

    Near-duplicates are fingerprints at most four bits apart; near copies further apart stay. The written texts lie beside
    the shuffles of the next stage, so they are packed closely.
    """
    return repeats.without_repeats(written(simhash.one_of_each_group(docs), "one-of-each", "zstd"), passages=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 400 bytes that start anywhere else too."""
    return repeats.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of every document, their digests, and whether they decode to its text."""
    return pieces.round_trips(docs, with_ids=True)


STAGES = [("quality rules", keep_good), ("near-duplicates", drop_near_duplicates), ("repeated passages", cut_repeats),
          ("decontamination", drop_contaminated), ("pieces", to_pieces)]

#: Fingerprints and sampled pieces have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
