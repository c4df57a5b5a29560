"""Source divergence: smoothed term shares of sources, compared over run-length columns of their counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import no_null, written
from .decontaminate import slices

MIN_DOCUMENTS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: A task's term counts go on when they hold so many entries.
HELD_TERMS = 300_000
#: Nonzero counts and terms of one chunk of vocabulary.
CHUNK_CELLS, CHUNK_TERMS = 1 << 17, 1 << 16
SALTS = 32
#: Term bytes (letters A-Z lower-cased, all bytes of other scripts); anything else becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTIAL = "lang string, source string, term string, n long, documents long"


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms a group: occurrences and documents, folded in the task up to a bound on what it holds."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def folded() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in groups.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                                              pa.array(terms, pa.binary()).cast(pa.string()), pa.array([n[t] for t in terms], pa.int64()),
                                              pa.array([documents[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "documents"])
        groups.clear()

    since = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, texts in slices(batch.column(2)):
            for i, text in enumerate(texts, first):
                terms = text.translate(_FOLD).split()
                n, documents = groups.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                n.update(terms)
                documents.update(set(terms))
                since += len(text)
                if since > 1 << 20:
                    since = 0
                    if sum(len(x) for x, _ in groups.values()) > HELD_TERMS:
                        yield from folded()
    yield from folded()


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / total), exactly: the product is a decimal of 38 digits."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def exact_shares(n: np.ndarray, total: int) -> np.ndarray:
    """The same in 64 bits: the unit is multiplied in by thousands, with the remainder carried on."""
    whole, rest = np.divmod(n.astype(np.int64) + SMOOTH, total)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return whole + 1


def vocabulary(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang``, ``term``, ``total`` and the counts by source (``per``) of every term in ``min_documents`` of its language's rows.

    Counts are folded in the tasks before the one shuffle, which is by language and term: a word that is everywhere costs
    a row a task and source.
    """
    rows = documents.select(*[no_null(F.col(c)).alias(c) for c in ("lang", "source", "text")])
    partial = rows.mapInArrow(_count_terms, _PARTIAL).repartition("lang", "term")
    counts = partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"),
                                               F.sort_array(F.collect_list(F.struct("source", "n"))).alias("per"))
    return terms.filter(F.col("documents") >= min_documents).select("lang", "term", "total", "per")


def group_sizes(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurring (lang, source) with N (its count over kept terms), the language's V and N (``all_n``); 0 without terms."""
    groups = documents.select(no_null("lang").alias("lang"), no_null("source").alias("source")).distinct()
    own = terms.select("lang", F.explode("per").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all_n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("all_n"))


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of the ordered vocabulary as run-length columns: a source's counts and how many terms each holds for."""
    kind = pa.list_(pa.struct([("source", pa.string()), ("counts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]))
    lang, first, held, cells, terms = None, None, [], 0, 0

    def chunk() -> pa.RecordBatch:
        names: dict[str, int] = {}
        code = np.array([names.setdefault(s, len(names)) for sources, _, _ in held for s in sources], np.int64)
        place, n = np.concatenate([p for _, p, _ in held]), np.concatenate([c for _, _, c in held])
        order, runs = np.argsort(code, kind="stable"), []
        for source, own in zip(names, np.split(order, np.cumsum(np.bincount(code))[:-1])):
            dense = np.zeros(terms, np.int64)
            dense[place[own]] = n[own]
            heads = np.concatenate([[0], np.nonzero(np.diff(dense))[0] + 1])
            runs.append({"source": source, "counts": dense[heads], "lengths": np.diff(np.append(heads, terms))})
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([first]), pa.array([terms], pa.int64()), pa.array([runs], kind)], names=["lang", "first", "terms", "runs"])

    for batch in batches:
        langs, words = batch.column("lang").to_pylist(), batch.column("term").to_pylist()
        per = batch.column("per")
        ends = per.offsets.to_numpy() - per.offsets[0].as_py()
        flat = per.flatten()
        names, counts = flat.field("source").to_pylist(), flat.field("n").to_numpy()
        at = 0
        while at < batch.num_rows:
            if terms and (langs[at] != lang or cells >= CHUNK_CELLS or terms >= CHUNK_TERMS):
                yield chunk()
                held, cells, terms = [], 0, 0
            if not terms:
                lang, first = langs[at], words[at]
            stop = at
            while stop < batch.num_rows and langs[stop] == lang and cells < CHUNK_CELLS and terms + stop - at < CHUNK_TERMS:
                cells += int(ends[stop + 1] - ends[stop])
                stop += 1
            a, b = ends[at], ends[stop]
            held.append((names[a:b], np.repeat(np.arange(terms, terms + stop - at), np.diff(ends[at:stop + 1])), counts[a:b]))
            terms += stop - at
            at = stop
    if terms:
        yield chunk()


def run_distance(ends_a: np.ndarray, a: np.ndarray, ends_b: np.ndarray, b: np.ndarray) -> int:
    """Sum of |a - b| over two run-length columns: run ends are intersected, each difference counts as long as both runs last."""
    ends = np.union1d(ends_a, ends_b)
    return int((np.abs(a[np.searchsorted(ends_a, ends)] - b[np.searchsorted(ends_b, ends)]) * np.diff(ends, prepend=0)).sum())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk and pair of sources the sum of f over the chunk's terms; a chunk of no terms names the pairs with 0."""
    found: dict[tuple[str, str, str], int] = {}

    def out() -> pa.RecordBatch:
        keys = list(found)
        made = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(found.values()), pa.int64())],
                                          names=["lang", "source", "item", "value"])
        found.clear()
        return made

    for batch in batches:
        for row in batch.to_pylist():
            runs = {r["source"]: r for r in row["runs"]}
            columns = []
            for s in row["sources"]:
                r = runs.get(s["source"], {"counts": [0], "lengths": [row["terms"]]})
                n = np.array(r["counts"], np.int64)
                columns.append((s["source"], np.cumsum(r["lengths"]), exact_shares(n, s["n"] + SMOOTH * row["v"]) if row["terms"] else n))
            for i, (a, ends_a, p) in enumerate(columns):
                for b, ends_b, q in columns[i + 1:]:
                    key = (row["lang"], a, b)
                    found[key] = found.get(key, 0) + (run_distance(ends_a, p, ends_b, q) if row["terms"] else 0)
                if len(found) > HELD_TERMS:
                    yield out()
    yield out()


def pair_divergence(terms: DataFrame, groups: DataFrame, salts: int = SALTS) -> DataFrame:
    """``lang``, ``source``, ``item`` and ``value`` for every two sources of a language, both ways.

    Terms are ordered by their counts, so that equal counts stand together, and cut into chunks; chunks meet the sources of their
    language under salted keys, and every chunk's pairs are summed where it lies.
    """
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("sources"), F.first("v").alias("v"))
    copies = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    shape = "lang string, first string, terms long, runs array<struct<source:string,counts:array<long>,lengths:array<long>>>"
    # Short keys, as the driver samples them; equal columns of counts have equal hashes.
    order = ["lang", "total", F.xxhash64("per"), "term"]
    chunks = terms.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_encode, shape)
    empty = langs.select("lang", F.lit("").alias("first"), F.lit(0).cast("long").alias("terms"), F.array().cast(shape.split("runs ")[1]).alias("runs"))
    salted = chunks.unionByName(empty).withColumn("salt", F.pmod(F.xxhash64("first"), F.lit(salts)).cast("int"))
    met = salted.join(copies, ["lang", "salt"]).select("lang", "terms", "runs", "sources", "v")
    half = met.mapInArrow(_pairs, "lang string, source string, item string, value long")
    half = half.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return half.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def leading_terms(terms: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms of every group by how far their share is above the language's, with ``rank``."""
    single = terms.select("lang", "term", "total", F.explode("per").alias("x")).select("lang", "term", "total", "x.source", F.col("x.n").alias("own"))
    met = single.join(groups, ["lang", "source"])
    value = share(F.col("own"), F.col("n") + SMOOTH * F.col("v")) - share(F.col("total"), F.col("all_n") + SMOOTH * F.col("v"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (met.select("lang", "source", F.col("term").alias("item"), value.alias("value")).filter("value > 0")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))


def source_divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``: how sources of a language differ.

    Null text, lang and source are ''. Every row is a document, so repeated rows count each. A group without words, or
    a language without kept terms, still has its pairs (0 where there are no terms). An empty table gives no rows; other
    columns are not looked at. Arithmetic is in whole numbers.
    """
    terms = written(vocabulary(documents, min_documents), "terms")
    groups = written(group_sizes(documents, terms), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergence(terms, groups).withColumn("rank", F.row_number().over(order))
    columns = lambda frame, part: frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(leading_terms(terms, groups, top), "term"))
