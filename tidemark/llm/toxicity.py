"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .decontaminate import slices

SIZES = (3, 4, 5, 6, 7, 8)
#: Bits of the filter that n-grams pass before they are looked up.
FILTER_BITS = 18
#: The classifier is fitted on at most so many labelled rows, the first by hash of the key.
MAX_LABELLED = 8000
#: Features kept: the n-grams whose ratio weighs most.
MAX_FEATURES = 8000
MIN_ROWS = 5
CHUNK = 1 << 20
#: A task's tallies are folded whenever so many n-grams wait.
FLUSH = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Size and n-grams of the lower-cased text, a chunk at a time; chunks overlap, so no n-gram is lost.

    An n-gram is its own bytes in a 64-bit number, so no two share a number; a zero byte counts as 0xFF, which no UTF-8 has.
    """
    low = b" " + text.decode("utf-8", "replace").lower().encode().replace(b"\0", b"\xff") + b" "
    for at in range(0, len(low), CHUNK):
        n = min(CHUNK, len(low) - at)
        eight = np.ndarray((n,), ">u8", low[at:at + n + 7].ljust(n + 7, b"\0"), strides=(1,)).astype(np.uint64)
        for size in SIZES:
            yield size, eight[:max(0, min(n, len(low) - at - size + 1))] >> np.uint64(64 - 8 * size)


def present(text: bytes) -> np.ndarray:
    """The different n-grams of the text."""
    parts: dict[int, list[np.ndarray]] = {size: [] for size in SIZES}
    for size, g in grams(text):
        own = parts[size]
        own.append(np.unique(g))
        while len(own) > 1 and len(own[-2]) <= 2 * len(own[-1]):
            own[-2:] = [np.union1d(own[-2], own[-1])]
    return np.concatenate([np.unique(np.concatenate(own)) if len(own) > 1 else own[0] for own in parts.values()])


def folded(grams: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row an n-gram: the sums of its counts."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    heads = np.nonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))[0] if len(grams) else order
    return grams[heads], *((np.add.reduceat(c[order], heads, dtype=c.dtype) if len(heads) else c) for c in (toxic, n))


def held_out(key: str) -> Column:
    """Whether CRC-32 of the key as text leaves 0 modulo 5; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Weights:
    """The n-grams that are features, in order, their weights and the offset."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, offset: float):
        self.features, self.weights, self.offset = features, weights, offset
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slots(features)] = True

    @staticmethod
    def _slots(grams: np.ndarray) -> np.ndarray:
        return (grams * _MIX) >> np.uint64(64 - FILTER_BITS)

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of the features among the n-grams; whole n-grams are compared."""
        grams = grams[self.filter[self._slots(grams)]]
        at = np.searchsorted(self.features, grams)
        at[at == len(self.features)] = 0
        return at[self.features[at] == grams] if len(self.features) else at[:0]

    def lit(self, text: bytes) -> np.ndarray:
        """Which features the text has."""
        seen = np.zeros(len(self.features), bool)
        for _, g in grams(text):
            seen[self.places(g)] = True
        return seen

    def score(self, text: bytes) -> float:
        z = self.offset + float(self.weights[self.lit(text)].sum())
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def training_rows(documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, limit: int) -> DataFrame:
    """Label and text of at most ``limit`` labelled rows that are not held out."""
    chosen = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
              .select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"))
              .orderBy(F.xxhash64(F.lit(42), "key"), "key").limit(limit))
    chosen = written(chosen, "toxic-labels")
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.join(F.broadcast(chosen), "key").select("label", "text")  # at most ``limit`` rows


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
           limit: int = MAX_LABELLED) -> Weights:
    """Ratios from n-gram counts of both classes, then a logistic regression over the scaled presence features."""
    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def batch_of(held):
            columns = folded(*(np.concatenate(c) for c in zip(*held)))
            return columns, pa.RecordBatch.from_arrays([pa.array(c) for c in (columns[0].view(np.int64), *columns[1:])], names=["gram", "toxic", "n"])

        for batch in batches:
            marks = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1)):
                for mark, text in zip(marks[first:], texts):
                    at = present(text)
                    held.append((at, np.full(len(at), int(mark), np.int32), np.ones(len(at), np.int32)))
                    waiting += len(at)
                    if waiting >= FLUSH:
                        columns, out = batch_of(held)
                        held, waiting = [columns], 0
                        if len(columns[0]) >= FLUSH:
                            yield out
                            held = []
        if held:
            yield batch_of(held)[1]

    rows = written(training_rows(documents, labels, key, text, label, limit), "toxic-texts")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = 0.999 if sizes.get(1.0) else 0.001
        return Weights(np.zeros(0, np.uint64), np.zeros(0), math.log(share / (1 - share)))
    counts = (rows.mapInArrow(tallies, "gram long, toxic int, n int").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
              .filter(F.col("n") >= MIN_ROWS))
    p, q = 1.0 + F.col("toxic"), 1.0 + F.col("n") - F.col("toxic")
    ratio = F.log((p / (1 + sizes[1.0])) / (q / (1 + sizes[0.0])))
    best = (counts.select("gram", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(p)).alias("weight")).filter("weight > 0")
            .orderBy(F.desc("weight"), "gram").limit(MAX_FEATURES).toPandas())  # MAX_FEATURES rows at most
    order = np.argsort(best.gram.to_numpy(np.int64).view(np.uint64))
    features, scale = best.gram.to_numpy(np.int64).view(np.uint64)[order], best.ratio.to_numpy(float)[order]
    found = Weights(features, scale, 0.0)

    @F.udf(VectorUDT())
    def vector(text):
        at = np.nonzero(found.lit((text or "").encode()))[0]
        return Vectors.sparse(len(features), at, scale[at])

    scaled = rows.select("label", vector("text").alias("features"))  # at most ``limit`` rows
    model = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False).fit(scaled)
    return Weights(features, model.coefficients.toArray() * scale, model.intercept)


def toxicity_scores(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    limit: int = MAX_LABELLED) -> DataFrame:
    """``key``, held_out, score and predicted of every row's whole text.

    Labels of held-out keys are never read. Null and empty texts get the score of a text without n-grams; with labels
    of one class only, all scores are near that class. Repeated rows stay, other columns are not looked at, an empty
    table gives no rows.
    """
    model = fitted(documents, labels, key, text, label, limit)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # fixed size: MAX_FEATURES numbers and the filter
    rows = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(t) for _, texts in slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=[key, "score"])

    scored = rows.mapInArrow(score, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))
    return scored.select(F.col(f"`{key}`"), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
