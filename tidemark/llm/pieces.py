"""SentencePiece encoding by sampling: forward filtering and backward sampling over the piece lattice; lossless decoding."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: 0: all segmentations alike; 1: as likely as the product of their pieces; large: the best one.
ALPHA = 0.5
#: A worker's store holds at most so many bytes before it starts afresh; what counts is named in ``PieceLattice.held``.
STORE_BYTES = 64 << 20
#: Bytes of a stored unit besides its edges: its string, its place in the dictionary and its number.
UNIT_BYTES = 220
#: Units that are looked up, stored and sampled at once.
SPAN_UNITS = 1 << 15
#: Units up to this length are filtered many at once.
PLAIN = 40
SLICE_BYTES = 1 << 20
#: No piece holds a blank after another character, nor a line feed: between these units every segmentation has a cut.
_UNIT = re.compile(r" *[^ \n]+|\n| +")
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a counter as independent bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def row_seed(key: int | None, seed: int) -> int:
    """Seed of a row: its key's, mixed with the run's; null keys share one."""
    start = np.array([((key if key is not None else -(1 << 62)) + seed * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64)
    return int(_mix(_mix(start) + _STEP)[0])


def draw(row: np.ndarray, unit: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Uniform number in [0, 1) for a row's seed, the unit's number in the row and the lattice node in the unit."""
    bits = _mix(row + _STEP * (unit.astype(np.uint64) * np.uint64(1 << 20) + node.astype(np.uint64)))
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53


class PieceLattice:
    """Lattices of text units under one model: nodes are places between characters, edges are pieces.

    A piece weighs ``rank ** -alpha`` by Zipf's law of its place in the vocabulary. A character outside the vocabulary is
    a chain of its bytes' pieces, and so is a literal U+2581, so that decoding gives back the text. Forward filtering
    gives each node the sum of all ways that reach it and each incoming edge its share of it.
    """

    def __init__(self, model: str = MODEL, alpha: float = ALPHA):
        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        self.alpha = alpha
        self.vocabulary: dict[str, tuple[int, float]] = {}
        self.bytes_at = {}
        self.surface: list[bytes] = []
        for i in range(processor.get_piece_size()):
            piece = processor.id_to_piece(i)
            if processor.is_byte(i):
                self.bytes_at[int(piece[1:-1], 16)] = i
                self.surface.append(bytes([int(piece[1:-1], 16)]))
            elif processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i):
                self.surface.append(b"")
            else:
                self.vocabulary[piece.replace("▁", " ")] = (i, -alpha * math.log(i + 1))
                self.surface.append(piece.replace("▁", " ").encode())
        self.longest = max(map(len, self.vocabulary))
        self.single = {p for p in self.vocabulary if len(p) == 1}
        self.weight = np.zeros(len(self.surface))
        self.hashed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [(p, i, w) for p, (i, w) in self.vocabulary.items() if len(p) == n]
            codes = np.array([[ord(c) for c in p] for p, _, _ in own], np.uint64).reshape(len(own), n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * _STEP + codes[:, k] + np.uint64(1)
            order = np.argsort(h)
            self.hashed[n] = h[order], np.array([i for _, i, _ in own], np.int32)[order]
            for _, i, w in own:
                self.weight[i] = math.exp(w)
        self.rare = -alpha * math.log(processor.get_piece_size())
        self.clear()

    def clear(self) -> None:
        """An empty store: unit to number, by number its nodes, by node its first edge, and the edges."""
        self.at: dict[str, int] = {}
        self.low, self.high = np.empty(0, np.int32), np.empty(0, np.int32)
        self.first = np.empty(0, np.int32)
        self.share, self.token, self.back = np.empty(0, np.float32), np.empty(0, np.int32), np.empty(0, np.int16)
        self.nodes = self.edges = 0

    @property
    def held(self) -> int:
        """Bytes of the store: 10 an edge, 4 a node, 8 and UNIT_BYTES a unit."""
        return 10 * self.edges + 4 * self.nodes + (8 + UNIT_BYTES) * len(self.at)

    def lattice(self, unit: str) -> list[list[tuple[float, int, int]]]:
        """Per node its incoming edges (running share up to 1, piece, nodes to go back); byte chains add inner nodes."""
        n, find, longest = len(unit), self.vocabulary.get, self.longest
        node_of, reach, out = [0] * (n + 1), [0.0] * (n + 1), [[]]
        for j in range(1, n + 1):
            ways = []
            for i in range(max(0, j - longest), j):
                piece = find(unit[i:j])
                if piece:
                    ways.append((reach[i] + piece[1], i, piece[0]))
            chain = None
            if not find(unit[j - 1]):
                chain = unit[j - 1].encode()
                ways.append((reach[j - 1] + len(chain) * self.rare, j - 1, -1))
                for k, b in enumerate(chain[:-1]):
                    out.append([(1.0, self.bytes_at[b], len(out) - node_of[j - 1] if k == 0 else 1)])
            top = max(w[0] for w in ways)
            total = sum(math.exp(w[0] - top) for w in ways)
            reach[j], node_of[j] = top + math.log(total), len(out)
            edges, run = [], 0.0
            for weight, i, piece in ways:
                run += math.exp(weight - top) / total
                if piece < 0:
                    back = len(out) - node_of[j - 1] if len(chain) == 1 else 1
                    edges.append((run, self.bytes_at[chain[-1]], back))
                else:
                    edges.append((run, piece, len(out) - node_of[i]))
            edges[-1] = (2.0, *edges[-1][1:])
            out.append(edges)
        return out

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if at + len(values) > len(array):
            wider = np.empty((at + len(values)) * 5 // 4 + 1024, array.dtype)
            wider[:at] = array[:at]
            array = wider
            setattr(self, name, array)
        array[at:at + len(values)] = values

    def _append(self, units: list[str], nodes: np.ndarray, first: np.ndarray, share: np.ndarray, token: np.ndarray, back: np.ndarray) -> None:
        """Add lattices to the store: node counts of the units, first edge of each node, and the edges by node."""
        ends = self.nodes + np.cumsum(nodes)
        own = len(self.at)
        self.at.update(zip(units, range(own, own + len(units))))
        for name, values, at in (("low", ends - nodes, own), ("high", ends - 1, own), ("first", first + self.edges, self.nodes),
                                 ("share", share, self.edges), ("token", token, self.edges), ("back", back, self.edges)):
            self._put(name, at, values)
        self.nodes += len(first)
        self.edges += len(share)

    def _store(self, units: list[str]) -> None:
        plain = [u for u in units if len(u) <= PLAIN and self.single.issuperset(u)]
        if plain:
            self._store_plain(plain)
        skip = set(plain)
        for unit in units:
            if unit in skip:
                continue
            made = self.lattice(unit)
            flat = [e for incoming in made for e in incoming]
            sizes = np.array([len(x) for x in made])
            self._append([unit], np.array([len(made)]), np.cumsum(sizes) - sizes, *(np.array(c) for c in zip(*flat)))

    def _store_plain(self, units: list[str]) -> None:
        """The same as ``lattice`` for many short units at once, for those without byte chains."""
        sizes = np.array(list(map(len, units)))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(units)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        h, live = np.zeros(len(codes), np.uint64), np.arange(len(codes))
        starts, lengths, tokens = [], [], []
        for n in range(1, self.longest + 1):
            live = live[left[live] >= n]
            if not len(live):
                break
            h[live] = h[live] * _STEP + codes[live + n - 1] + np.uint64(1)
            known, ids = self.hashed[n]
            at = np.minimum(np.searchsorted(known, h[live]), len(known) - 1)
            ok = known[at] == h[live]
            starts.append(live[ok])
            lengths.append(np.full(int(ok.sum()), n))
            tokens.append(ids[at[ok]])
        start, length, token = map(np.concatenate, (starts, lengths, tokens))
        source = start + unit[start]
        node = source + length
        order = np.argsort(node * 32 - length, kind="stable")
        source, node, length, token = source[order], node[order], length[order], token[order]
        total = len(codes) + len(units)
        origin = np.cumsum(sizes + 1) - sizes - 1
        depth = node - np.repeat(origin, sizes + 1)[node]
        weight, reach, part = self.weight[token], np.zeros(total), np.zeros(len(node))
        reach[origin] = 1.0
        levels = np.argsort(depth, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(depth))])
        for a, b in zip(bounds[:-1], bounds[1:]):
            e = levels[a:b]
            if len(e):
                part[e] = reach[source[e]] * weight[e]
                heads = np.concatenate([[True], node[e][1:] != node[e][:-1]])
                reach[node[e[heads]]] = np.bincount(np.cumsum(heads) - 1, part[e])
        edges = np.bincount(node, minlength=total)
        first = np.cumsum(edges) - edges
        share = part / reach[node]
        for rank in range(1, int(edges.max(initial=1))):  # sums in edge order, so they don't depend on the neighbours
            e = first[edges > rank] + rank
            share[e] += share[e - 1]
        share[(first + edges - 1)[edges > 0]] = 2.0
        self._append(units, sizes + 1, first, share, token, length)

    def sample(self, texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and the count of each text; SPAN_UNITS units at a time, so that the
        store's bound holds in a text of any length."""
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        units = [u for s in split for u in s]
        counts = np.array([len(s) for s in split], np.int64)
        if not units:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        row = np.repeat(np.array(seeds, np.uint64), counts)
        number = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
        done = [self._sample_span(units[a:a + SPAN_UNITS], row[a:a + SPAN_UNITS], number[a:a + SPAN_UNITS]) for a in range(0, len(units), SPAN_UNITS)]
        size = np.concatenate([n for _, n in done])
        per_text = np.add.reduceat(np.append(size, 0), np.minimum(np.cumsum(counts) - counts, len(size))) * (counts > 0)
        return np.concatenate([ids for ids, _ in done]), per_text

    def _sample_span(self, units: list[str], row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all units and the count of each; ``row`` and ``number`` decide the draws."""
        if self.held > STORE_BYTES:
            self.clear()
        self._store([u for u in dict.fromkeys(units) if u not in self.at])
        own = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        start, node = self.low[own].astype(np.int64), self.high[own].astype(np.int64)
        live, steps = np.arange(len(units)), []
        while len(live):
            here = node[live]
            u = draw(row[live], number[live], here - start[live]).astype(np.float32)
            edge = self.first[here]
            ahead = np.nonzero(self.share[edge] <= u)[0]
            while len(ahead):
                edge[ahead] += 1
                ahead = ahead[self.share[edge[ahead]] <= u[ahead]]
            steps.append((live, self.token[edge]))
            node[live] = here - self.back[edge]
            live = live[node[live] > start[live]]
        size = np.zeros(len(units), np.int64)
        for live, _ in steps:
            size[live] += 1
        end = np.cumsum(size)
        ids = np.empty(end[-1], np.int32)
        for k, (live, tokens) in enumerate(steps):
            ids[end[live] - 1 - k] = tokens
        return ids, size

    def decode(self, ids: list[int]) -> bytes:
        """The text's bytes: the pieces' surfaces without the blank put before the first."""
        return b"".join(map(self.surface.__getitem__, ids))[1:]


_HELD: dict[tuple[str, float], PieceLattice] = {}


def lattice_of(model: str, alpha: float) -> PieceLattice:
    """One lattice store a worker process; tasks that follow find it filled."""
    if (model, alpha) not in _HELD:
        _HELD.clear()
        _HELD[model, alpha] = PieceLattice(model, alpha)
    return _HELD[model, alpha]


def _encoded(batches: Iterator[pa.RecordBatch], model: str, alpha: float, seed: int):
    """Per slice of a batch: its keys, the texts, the ids in a row and the count of each text."""
    lattice = lattice_of(model, alpha)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        for first, texts in slices(batch.column(1), SLICE_BYTES):
            part = keys[first:first + len(texts)]
            ids, counts = lattice.sample([t.decode() for t in texts], [row_seed(k, seed) for k in part])
            yield part, texts, ids, counts


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = 42) -> DataFrame:
    """``key`` (a whole number) and ``ids``, one sampled segmentation of every row's whole text.

    Each draw depends on the seed, the row's key, and the place in its text alone: any run, order or partitioning gives
    the same ids; rows with one key and text get the same ids, null keys share a seed. Null and empty texts have no ids.
    """
    rows = documents.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, ids, counts in _encoded(batches, model, alpha, seed):
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), lists], names=[key, "ids"])

    return rows.mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``key`` and the ``text`` of the pieces; no or null ids: the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, ALPHA)
        for batch in batches:
            texts = [lattice.decode(x or []).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = encoded.select(key, ids)
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("text", T.StringType())]))


def round_trips(documents: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = 42,
                with_ids: bool = False) -> DataFrame:
    """``key``, n_pieces, SHA-256 of the ids (little-endian 32 bits each), SHA-256 of the decoded bytes, and whether they
    are the text's; ids are made as in ``encode`` and read as in ``decode`` within one pass. ``with_ids`` adds the ``ids``."""
    rows = documents.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`"))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
    names = [key, "n_pieces", "ids_sha256", "decoded_sha256", "lossless", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(model, alpha)
        for part, texts, ids, counts in _encoded(batches, model, alpha, seed):
            out, at = [], 0
            for k, t, n in zip(part, texts, counts.tolist()):
                own = ids[at:at + n]
                at += n
                back = lattice.decode(own.tolist())
                out.append((k, n, hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, f"`{key}` long, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids)
