"""Benchmark decontamination: a broadcast hash set of test n-grams, verified hits, spans or documents removed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, no_null

WINDOW = 13
#: A benchmark of at most so many words is broadcast (about 100 bytes a word); a larger one is joined.
MAX_BROADCAST_WORDS = 500_000
SLICE_BYTES = 2 << 20
#: Word bytes (digits, letters, all bytes of non-ASCII characters) lower-cased; anything else becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class NgramIndex:
    """The windows of all items: word numbers, a sorted array of window hashes, and the exact windows behind them."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list]] = {}
        for item, text in items:
            words = words_of(text)
            n = min(len(words), window)
            if not n:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            held = self.windows.setdefault(n, {})
            for i in range(len(ids) - n + 1):
                held.setdefault(ids[i:i + n].tobytes(), []).append(item)
        self.hashes = {n: np.unique(self._hash(np.concatenate([np.frombuffer(k, np.int64) for k in held]), np.arange(len(held)) * n, n))
                       for n, held in self.windows.items()}

    @staticmethod
    def _hash(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for k in range(n):
            out = out * _BASE + ids[starts + k].astype(np.uint64)
        return out

    def hits(self, documents: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """Per document the word spans of verified windows, in order, and the items they belong to."""
        spans: list[list[tuple[int, int]]] = [[] for _ in documents]
        items: list[set] = [set() for _ in documents]
        known = self.vocabulary.get
        ids = np.array([known(w, -1) for words in documents for w in words], np.int64)
        if not len(ids) or not self.windows:
            return spans, items
        ends = np.cumsum([len(w) for w in documents])
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for n, held in self.windows.items():
            if len(ids) < n:
                continue
            starts = np.nonzero(unknown[n:] == unknown[:-n])[0]
            at = np.searchsorted(ends, starts, "right")
            starts, at = (x[starts + n <= ends[at]] for x in (starts, at))
            found = np.isin(self._hash(ids, starts, n), self.hashes[n])
            for i, d in zip(starts[found].tolist(), at[found].tolist()):
                owners = held.get(ids[i:i + n].tobytes())
                if owners:
                    first = i - (int(ends[d - 1]) if d else 0)
                    spans[d].append((first, first + n))
                    items[d].update(owners)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """A string column as lists of UTF-8 bytes (null: empty) of about ``limit`` bytes, with the first row's number."""
    held, size, first = [], 0, 0
    for i, value in enumerate(column.cast(pa.large_binary())):
        held.append(value.as_py() or b"")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def is_contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def benchmark_index(documents: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
                    max_words: int = MAX_BROADCAST_WORDS):
    """The broadcast index, or None where the benchmark has more than ``max_words`` words."""
    items = benchmark.select(F.col(f"`{item}`").cast("long").alias("item"), no_null(F.col(f"`{text}`")).alias("text"))
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0]
    if (size or 0) > max_words:
        return None
    rows = [(r["item"], r["text"].encode()) for r in items.collect()]
    return documents.sparkSession.sparkContext.broadcast(NgramIndex(rows))


_HITS = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                   ("items", pa.list_(pa.int64()))])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
                   max_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """``key``, n_words, merged hit ``spans`` of word numbers and the sorted ``items`` whose windows occur, a row a row.

    Null texts have no words; empty items have no window; equal items are all reported. Repeated rows stay, other
    columns are not looked at, an empty benchmark hits nothing. Null item ids count as no item but their words as hit.
    Documents are scanned once, without a shuffle, against the broadcast index; a benchmark above ``max_words`` words is
    joined on its windows instead.
    """
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    index = benchmark_index(documents, benchmark, max_words=max_words)
    if index is None:
        return _joined_hits(rows, benchmark).withColumnRenamed("key", key)
    kind = T.StructType([rows.schema["key"]])
    out = T.StructType([*kind.fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string(
        "spans array<struct<start:long,end:long>>, items array<long>").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words = [words_of(t) for t in texts]
                spans, items = index.value.hits(words)
                found = pa.Table.from_pylist([{"n_words": len(w), "spans": [{"start": a, "end": b} for a, b in merged(s)],
                                               "items": sorted(x for x in i if x is not None)}
                                              for w, s, i in zip(words, spans, items)], schema=_HITS)
                keys = pa.table([batch.column(0).slice(first, len(texts))], names=["key"])
                for c in _HITS.names:
                    keys = keys.append_column(c, found[c])
                yield from keys.combine_chunks().to_batches()

    return rows.mapInArrow(scan, out).withColumnRenamed("key", key)


def _joined_hits(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same by joining the windows of documents and items; for benchmarks too large to broadcast."""
    words = lambda c: F.filter(F.split(ascii_lower(c), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")
    items = (benchmark.select(F.col("item_id").cast("long").alias("item"), words(no_null("text")).alias("words"))
             .filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(WINDOW))))
    grams = lambda frame: frame.select("*", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))).alias("at", "gram"))
    wanted = grams(items).select("n", "gram", "item").distinct()
    lengths = items.select("n").distinct()
    numbered = rows.select("key", words(no_null("text")).alias("words"), F.monotonically_increasing_id().alias("row"))
    sized = numbered.join(F.broadcast(lengths), F.size("words") >= F.col("n"))  # 13 lengths at most
    met = grams(sized.select("row", "words", "n")).join(wanted, ["n", "gram"])
    found = met.groupBy("row").agg(F.collect_set(F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.col("n")).cast("long").alias("end"))).alias("raw"),
                                   F.sort_array(F.collect_set("item")).alias("items"))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.get(acc, F.size(acc) - 1)["end"]),
                                 F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                                     F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                                     F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate(F.sort_array("raw"), F.array().cast("array<struct<start:long,end:long>>"), step)
    return numbered.join(found, "row", "left").select(
        "key", F.size("words").cast("long").alias("n_words"),
        F.coalesce(spans, F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def report(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The hit spans as counts, a digest of the items and the contamination rule: a twentieth of the words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(F.col(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(listed.cast("binary"), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join(out) + text[last:]


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "documents",
                   max_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """The documents with all their columns, without the contaminated ones, or (``spans``) without the hit words.

    Other documents stay as they are. A benchmark beyond the broadcast bound is joined in either mode, with the same result.
    """
    index = benchmark_index(documents, benchmark, max_words=max_words)
    names = documents.columns
    place = names.index(text)
    if index is None:
        packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("key"), F.col(f"`{text}`").alias("text"))
        hits = _joined_hits(packed, benchmark)
        if mode == "documents":
            return report(hits, "key").filter("not contaminated").select("key.*")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns, old = batch.column(0).flatten(), batch.column(0).field(place)
                new = [_without((t or "").encode(), [(s["start"], s["end"]) for s in spans]).decode() if spans else t
                       for t, spans in zip(old.to_pylist(), batch.column(1).to_pylist())]
                columns[place] = pa.array(new, old.type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return hits.select("key", "spans").mapInArrow(cut, documents.schema)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts_out = [], []
            for _, texts in slices(batch.column(place)):
                words = [words_of(t) for t in texts]
                for t, w, s in zip(texts, words, index.value.hits(words)[0]):
                    spans = merged(s)
                    kept.append(mode == "spans" or not is_contaminated(len(w), sum(b - a for a, b in spans)))
                    texts_out.append(_without(t, spans) if mode == "spans" and spans else None)
            if mode == "spans":
                old = batch.column(place)
                new = pc.coalesce(pa.array([None if t is None else t.decode() for t in texts_out], old.type), old)
                batch = batch.set_column(place, batch.schema.field(place), new)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(clean, documents.schema)


def items_digest(items) -> str:
    """What ``report`` gives for a set of item ids; for tests and other engines."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
