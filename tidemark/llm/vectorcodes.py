"""Vector codes: product codebooks by Lloyd rounds over partition-local cover trees that assign whole subtrees at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one block, whose trees are built together; fewer where vectors are long (BLOCK_NUMBERS components at most).
BLOCK, BLOCK_NUMBERS = 8192, 1 << 21
#: Points a leaf holds on average.
LEAF = 8
#: Copies of each label's sum in the last join, so that a hot label is spread over as many tasks.
SALTS = 16
#: Distances rounded in floating point are told apart with this relative margin; closer ones are ambiguous and go down.
MARGIN = 1e-9

NODE = np.dtype([("first", "<i4"), ("last", "<i4"), ("center", "<i4"), ("low", "<i4"), ("high", "<i4"), ("radius", "<f8")])


def whole_components(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; raises where squared distances would leave 63 bits."""
    out = np.floor(values.astype(np.float64) * scale)
    width = values.shape[-1] if values.ndim else 1
    if out.size and np.abs(out).max() > 2.0**30 / math.sqrt(max(width, 1)):
        raise OverflowError(f"components beyond {2.0**30 / math.sqrt(max(width, 1)) / scale:.6g} have no 64-bit squared distances")
    return out.astype(np.int64)


def squared(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points (rows) to all entries (columns), as float64 where those are exact, else int64."""
    most = max((int(np.abs(x).max()) for x in (points, book) if x.size), default=0)
    if 4 * most * most * max(points.shape[1], 1) < 1 << 53:
        a, b = points.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in book], axis=1)


def _gaps(points: np.ndarray):
    """A function of a row's number: exact squared distances of all rows to it; one product where floats are exact."""
    most = int(np.abs(points).max(initial=0))
    if 4 * most * most * max(points.shape[1], 1) >= 1 << 53:
        return lambda i: ((points - points[i]) ** 2).sum(axis=1)
    exact = points.astype(np.float64)
    norms = (exact * exact).sum(axis=1)
    return lambda i: norms - 2 * (exact @ exact[i]) + norms[i]


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The points in tree order, and the nodes level by level.

    Centers are taken farthest first, so those taken while the distance exceeds R are more than R apart and cover every
    point within R: the levels R, R/2, R/4, ... of that order are nested, covering and separated, as a cover tree's are.
    A center's parent is the nearest center one level up. The last level has a center for about ``leaf`` points, or one
    for each different point. Points are put in order of their ancestors, so that a node is a range, its sum a difference
    of cumulative sums, and its children a range of nodes. ``radius`` is the exact largest distance to a point below.
    """
    n = len(points)
    gaps = _gaps(points)
    near, owner = gaps(0), np.zeros(n, np.int64)
    chosen, snapshots, taken = [0], [owner.copy()], 1
    reach = int(near.max())
    most = max(1, n // leaf)
    while True:
        far = int(near.argmax())
        distance = int(near[far])
        full = len(chosen) >= most or distance == 0
        if full or 4 * distance <= reach:
            if len(chosen) > taken:
                snapshots.append(owner.copy())
                taken = len(chosen)
            if full:
                break
            while 4 * distance <= reach:
                reach //= 4
        own = gaps(far)
        closer = own < near
        near[closer], owner[closer] = own[closer], len(chosen)
        chosen.append(far)
    centers = np.array(chosen)
    ancestors = [snapshots[-1]]
    for up in snapshots[-2::-1]:
        ancestors.append(up[centers[ancestors[-1]]])
    ancestors.reverse()
    order = np.lexsort(ancestors[::-1])
    levels, base = [], 0
    for level in (a[order] for a in ancestors):
        fresh = np.concatenate([[True], level[1:] != level[:-1]])
        if levels:
            fresh |= above
        above = fresh
        first = np.nonzero(fresh)[0]
        node = np.zeros(len(first), NODE)
        node["first"], node["last"], node["center"] = first, np.append(first[1:], n), centers[level[first]]
        gap = ((points[order] - points[centers[level]]) ** 2).sum(axis=1)
        node["radius"] = np.sqrt(np.maximum.reduceat(gap, first))
        if levels:
            up = levels[-1]
            up["low"] = base + np.searchsorted(first, up["first"])
            up["high"] = base + np.searchsorted(first, up["last"])
        base += len(first)
        levels.append(node)
    nodes = np.concatenate(levels)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    nodes["center"] = place[nodes["center"]]
    return order, nodes


class CoveredPart:
    """The points of one part position of one block, with their tree and cumulative sums."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray):
        self.order, self.nodes, self.points = order, nodes, points[order]
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ranges (first, last, entry) of subtrees settled whole, and the places of single points with their entries.

        An entry farther from a center than its nearest entry by more than twice the radius is no point's nearest below:
        by the triangle inequality it is then farther from each. A node with one entry left is settled; others go down,
        and points of leaves meet the entries left, exactly, ties to the lower index.
        """
        settled, places, entries = [], [], []
        live, allowed = np.array([0]), np.ones((1, len(book)), bool)
        while len(live):
            node = self.nodes[live]
            gap = np.sqrt(squared(self.points[node["center"]], book).astype(np.float64))
            gap[~allowed] = np.inf
            bound = gap.min(axis=1) + 2 * node["radius"]
            allowed = gap <= (bound * (1 + MARGIN) + MARGIN)[:, None]
            sole = allowed.sum(axis=1) == 1
            settled.append(np.stack([node["first"][sole], node["last"][sole], allowed[sole].argmax(axis=1)], axis=1))
            node, allowed = node[~sole], allowed[~sole]
            leaf = node["low"] == node["high"]
            if leaf.any():
                sizes = node["last"][leaf] - node["first"][leaf]
                own = np.arange(sizes.sum()) + np.repeat(node["first"][leaf] - (np.cumsum(sizes) - sizes), sizes)
                mask = np.repeat(np.nonzero(leaf)[0], sizes)
                for a in range(0, len(own), 4096):
                    exact = squared(self.points[own[a:a + 4096]], book)
                    exact[~allowed[mask[a:a + 4096]]] = exact.dtype.type(2**62)
                    places.append(own[a:a + 4096])
                    entries.append(exact.argmin(axis=1))
            node, allowed = node[~leaf], allowed[~leaf]
            sizes = node["high"] - node["low"]
            live = np.arange(sizes.sum()) + np.repeat(node["low"] - (np.cumsum(sizes) - sizes), sizes)
            allowed = np.repeat(allowed, sizes, axis=0)
        ranges = np.concatenate(settled)
        none = np.zeros(0, np.int64)
        return ranges[:, :2], ranges[:, 2], np.concatenate([none, *places]), np.concatenate([none, *entries])

    def add_to(self, sums: np.ndarray, counts: np.ndarray, book: np.ndarray) -> None:
        """Add the points of each entry to its sum and count; a settled subtree adds one difference of cumulative sums."""
        ranges, whole, places, entries = self.assigned(book)
        np.add.at(sums, whole, self.sums[ranges[:, 1]] - self.sums[ranges[:, 0]])
        np.add.at(counts, whole, ranges[:, 1] - ranges[:, 0])
        np.add.at(sums, entries, self.points[places])
        np.add.at(counts, entries, 1)

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point and its squared distance, in the block's order."""
        ranges, whole, places, entries = self.assigned(book)
        code = np.zeros(len(self.order), np.int64)
        sizes = ranges[:, 1] - ranges[:, 0]
        code[np.arange(sizes.sum()) + np.repeat(ranges[:, 0] - (np.cumsum(sizes) - sizes), sizes)] = np.repeat(whole, sizes)
        code[places] = entries
        out, error = np.empty_like(code), np.empty_like(code)
        out[self.order] = code
        error[self.order] = ((self.points - book[code]) ** 2).sum(axis=1)
        return out, error


def kept_vectors(embeddings: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key``, ``label`` and ``vector`` of the rows whose vector is there and holds finite numbers only."""
    infinite = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    rows = embeddings.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", fine))


def seed_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the ``entries`` vectors with the smallest keys (equal keys: the lesser vector; no key: last)."""
    rows = vectors.select("key", "vector").orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return []
    width = len(rows[0]["vector"])
    if width % parts or any(len(r["vector"]) != width for r in rows):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    seeds = whole_components(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), width), scale)
    return list(np.ascontiguousarray(seeds.reshape(len(rows), parts, width // parts).transpose(1, 0, 2)))


def covered_blocks(vectors: DataFrame, parts: int, width: int, scale: int) -> DataFrame:
    """A row a block: keys, labels, whole components, and the tree order and nodes of each part, as a written table.

    Trees are built once; each round reads them again, so a lost executor costs its blocks' reading, not their building.
    """
    size = max(1, min(BLOCK, BLOCK_NUMBERS // max(width, 1)))
    names = ["keys", "labels", "numbers", "trees"]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = rows["vector"].chunk(0)
        if rows.num_rows * width != len(flat.flatten()) or (np.diff(flat.offsets.to_numpy()) != width).any():
            raise ValueError(f"vectors must have one length; the seeds have {width}")
        numbers = whole_components(flat.flatten().to_numpy().reshape(rows.num_rows, width), scale)
        own = numbers.reshape(rows.num_rows, parts, width // parts)
        trees = [cover_tree(np.ascontiguousarray(own[:, p])) for p in range(parts)]
        ends = pa.array([0, rows.num_rows], pa.int32())
        packed = pa.array([[{"order": o.astype("<i4").tobytes(), "nodes": x.tobytes()} for o, x in trees]],
                          pa.list_(pa.struct([("order", pa.binary()), ("nodes", pa.binary())])))
        columns = [pa.ListArray.from_arrays(ends, rows[c].chunk(0)) for c in ("key", "label")]
        return pa.RecordBatch.from_arrays([*columns, pa.array([numbers.astype("<i4").tobytes()], pa.binary()), packed], names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - count)
                batch = batch.slice(part.num_rows)
                held.append(part)
                count += part.num_rows
                if count == size:
                    yield block(held)
                    held, count = [], 0
        if count:
            yield block(held)

    kinds = T.StructType([T.StructField("keys", T.ArrayType(vectors.schema["key"].dataType)), T.StructField("labels", T.ArrayType(vectors.schema["label"].dataType)),
                          T.StructField("numbers", T.BinaryType()), *T._parse_datatype_string("trees array<struct<order:binary,nodes:binary>>").fields])
    return written(vectors.mapInArrow(build, kinds), "blocks")


def _parts(numbers: bytes, trees: list[dict], parts: int, width: int) -> Iterator[CoveredPart]:
    own = np.frombuffer(numbers, "<i4").astype(np.int64)
    count = len(np.frombuffer(trees[0]["order"], "<i4"))
    own = own.reshape(count, parts, width // parts)
    for p, tree in enumerate(trees):
        yield CoveredPart(np.ascontiguousarray(own[:, p]), np.frombuffer(tree["order"], "<i4").astype(np.int64), np.frombuffer(tree["nodes"], NODE))


def lloyd_round(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of its parts' mean, entries without parts as they were.

    A task folds its blocks to one sum an entry and component, Spark adds those up, and the driver gets parts * entries
    rows of sums, whose count does not depend on the table.
    """
    parts, width = len(books), books[0].shape[1] * len(books)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for numbers, trees in zip(batch.column(0), batch.column(1)):
                for p, part in enumerate(_parts(numbers.as_py(), trees.as_py(), parts, width)):
                    part.add_to(sums[p], counts[p], books[p])
        index = np.array([(p, e, k) for p, b in enumerate(books) for e in range(len(b)) for k in range(-1, b.shape[1])], np.int32)
        value = np.concatenate([np.concatenate([c[:, None], s], axis=1).ravel() for c, s in zip(counts, sums)])
        some = value != 0
        yield pa.RecordBatch.from_arrays([*(pa.array(index[some, i]) for i in range(3)), pa.array(value[some])], names=["part", "entry", "place", "value"])

    folded = blocks.select("numbers", "trees").mapInArrow(fold, "part int, entry int, place int, value long")
    total = folded.groupBy("part", "entry", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums = {(r["part"], r["entry"], r["place"]): int(r["value"]) for r in total}
    out = []
    for p, book in enumerate(books):
        fresh = book.copy()
        for e in range(len(book)):
            n = sums.get((p, e, -1), 0)
            if n:
                fresh[e] = [sums.get((p, e, k), 0) // n for k in range(book.shape[1])]
        out.append(fresh)
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``key``, ``label``, ``code`` (two hex digits a part) and ``error`` of every kept row, and the final codebooks.

    Rows whose vector is null, or holds null or non-finite components, are left out. Components are floor(scale * x);
    vectors are cut into ``parts`` equal parts; each part's codebook starts as that part of the ``entries`` vectors with
    the smallest keys and moves ``rounds`` times to the floored means. Fewer rows than entries: a book of that many.
    Rows without key never come before others as seeds; of equal keys the lesser vector is first; repeated rows are
    coded each, an empty table gives no rows and no books. Other columns are not looked at. Vectors of unlike lengths
    raise, as do components whose squared distances leave 64 bits.
    """
    vectors = kept_vectors(embeddings, key, vector, label)
    books = seed_books(vectors, parts, entries, scale)
    named = [T.StructField("key", vectors.schema["key"].dataType), T.StructField("label", vectors.schema["label"].dataType)]
    out = T.StructType([*named, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books:
        return embeddings.sparkSession.createDataFrame([], out).withColumnsRenamed({"key": key, "label": label}), books
    width = books[0].shape[1] * parts
    blocks = covered_blocks(vectors, parts, width, scale)
    for _ in range(rounds):
        books = lloyd_round(blocks, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = [p.codes(b) for p, b in zip(_parts(batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), parts, width), books)]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, e in found)
                texts = codes.tobytes().hex()
                step = 2 * parts
                keys, labels = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                yield pa.RecordBatch.from_arrays([keys, labels, pa.array([texts[k:k + step] for k in range(0, len(texts), step)], pa.string()), pa.array(error, pa.int64())],
                                                 names=out.names)

    return blocks.mapInArrow(code, out).withColumnsRenamed({"key": key, "label": label}), books


def with_label_errors(coded: DataFrame, key: str = "vec_id", label: str = "label", salts: int = SALTS) -> DataFrame:
    """The coded rows with ``label_error``, the error summed over equal labels (nulls together); a hot label is salted."""
    coded = written(coded, "codes")
    sums = coded.groupBy(F.col(label).alias("own")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    copies = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = coded.withColumn("at", F.pmod(F.xxhash64(key, "code"), F.lit(salts)).cast("int"))
    return rows.join(copies, F.col(label).eqNullSafe(F.col("own")) & (F.col("at") == F.col("salt"))).drop("own", "salt", "at")
