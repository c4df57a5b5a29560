"""Repeated byte strings: a distributed difference-cover order of phrase suffixes, then an exact check of the windows.

Passages of words take the same way from their texts and back: their windows meet under least grams of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import no_null, written
from .decontaminate import slices

LENGTH = 400
#: A cut is a smallest hash of GRAM bytes among SPAN neighbours; see ``cuts``.
SPAN, GRAM = 64, 12
#: Bytes after a window's first settled cut in which cuts depend on the window alone, whichever of its windows it is.
ZONE = LENGTH + 1 - SPAN - GRAM - 2 * (SPAN - 1)
#: Bytes around a cut that all its windows share: CORE_LEFT before it, CORE_RIGHT after it.
CORE_LEFT, CORE_RIGHT = SPAN - 1, LENGTH - 2 * (SPAN - 1)
SIDE = SPAN - 1
FLUSH = 1_000_000
#: A passage of over 50 words; the least hash of GRAM_WORDS words in each window of PASSAGE words names it.
PASSAGE, GRAM_WORDS = 51, 13
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

PHRASE = np.dtype([("name", "<u8"), ("text", "<u8"), ("at", "<u4"), ("need", "u1")])
SUFFIX = np.dtype([("name", "<u8"), ("text", "<u8"), ("at", "<u4")])
PLACE = np.dtype([("text", "<u8"), ("at", "<u4")])
CONTEXT = np.dtype([("core", "V16"), ("low", "u1"), ("high", "u1"), ("side", f"V{2 * SIDE}"), ("row", "<i8"), ("cut", "<u4"), ("known", "u1")])


def _mix(*parts) -> np.ndarray:
    """One 64-bit name of several: equal parts, equal name."""
    out = np.uint64(len(parts))
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * _A
        out = out ^ (out >> np.uint64(29))
    out = out * _B
    return out ^ (out >> np.uint64(32))


def cuts(data: np.ndarray) -> np.ndarray:
    """Content-defined cuts: places whose hash of GRAM bytes is the least of some SPAN neighbouring places.

    Any SPAN places in a row have a cut, and whether a place is one depends on the bytes from SPAN - 1 before it to
    SPAN + GRAM - 2 after it only. So in equal windows the cuts between are equal, wherever the windows stand.
    """
    n = len(data) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint32) + np.uint32(1)
    m = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in range(5)]
    two = x[:-1] * m[1] + x[1:]
    four = two[:-2] * m[2] + two[2:]
    eight = four[:-4] * m[4] + four[4:]
    h = eight[:n] * m[4] + four[8:8 + n]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    low = h
    step = 1
    while step < SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    high = np.concatenate([np.zeros(SPAN - 1, np.uint32), low, np.zeros(SPAN - 1, np.uint32)])
    step = 1
    while step < SPAN:
        high = np.maximum(high[:-step], high[step:])
        step *= 2
    return np.nonzero(h == high)[0]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_POWER = {"up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _named(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit name of the entries from each first to before its last."""
    n = len(data)
    if len(_POWER["up"]) < n:
        _POWER["up"], _POWER["down"] = _powers(2 * n, int(_A)), _powers(2 * n, pow(int(_A), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWER["up"][:n])])
    raw = (sums[last] - sums[first]) * _POWER["down"][first]
    return _mix(raw, last - first)


def phrases(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit name of the bytes between each cut and the next."""
    return _named(data, places[:-1], places[1:])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; words are what white space separates."""
    inside = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13)), [False]])
    edges = np.nonzero(inside[1:] != inside[:-1])[0]
    return edges[::2], edges[1::2]


def word_windows(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all grams and of all windows of PASSAGE words, and the least gram name in each window.

    Equal windows have an equal least gram, so windows with a twin have a least gram that occurs elsewhere too.
    """
    first, last = word_bounds(data)
    n = len(first)
    if n < PASSAGE:
        return (np.zeros(0, np.uint64),) * 3
    words = _mix(_named(data, first, last))
    at = np.arange(n)
    grams = _mix(_named(words, at[:n - GRAM_WORDS + 1], at[:n - GRAM_WORDS + 1] + GRAM_WORDS))
    whole = _named(words, at[:n - PASSAGE + 1], at[:n - PASSAGE + 1] + PASSAGE)
    low, step, span = grams, 1, PASSAGE - GRAM_WORDS + 1
    while step < span:
        more = min(step, span - step)
        low = np.minimum(low[:-more], low[more:])
        step += more
    return grams, whole, low


def text_number(text: bytes) -> int:
    return int.from_bytes(hashlib.md5(text).digest()[:8], "big", signed=True)


def _blobs(kind: int, entries: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entries as one binary a bucket: what is shuffled are a few rows a task, not one row an entry."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    heads = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else []
    ends = np.append(heads[1:], len(bucket)) if len(bucket) else []
    if len(bucket):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array(np.full(len(heads), kind, np.int32)),
                                          pa.array([entries[a:b].tobytes() for a, b in zip(heads, ends)], pa.large_binary())],
                                         names=["bucket", "kind", "entries"])


def _gathered(batches: Iterator[pa.RecordBatch], *kinds: np.dtype) -> list[np.ndarray]:
    parts: list[list[bytes]] = [[] for _ in kinds]
    for batch in batches:
        for k, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            parts[k].append(e)
    return [np.frombuffer(b"".join(p), t) for p, t in zip(parts, kinds)]


def _twins(entries: np.ndarray) -> np.ndarray:
    """Of entries sorted by name: which share it with an entry of another place (adjacent comparison)."""
    if not len(entries):
        return np.zeros(0, bool)
    same = entries["name"][1:] == entries["name"][:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _own(entries: np.ndarray) -> np.ndarray:
    """Sorted by name, text and place, each place once."""
    order = np.lexsort((entries["at"], entries["text"], entries["name"]))
    out = entries[order]
    if len(out):
        fresh = (out["name"][1:] != out["name"][:-1]) | (out["text"][1:] != out["text"][:-1]) | (out["at"][1:] != out["at"][:-1])
        out = out[np.concatenate([[True], fresh])]
    return out


def _sent(entries: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries to the bucket of their name. Names that meet here already are known to repeat: one entry of each travels
    by name, all of them as known, spread by text; so a hot name costs a row a task."""
    entries = _own(entries)
    twin = _twins(entries)
    head = np.concatenate([[True], entries["name"][1:] != entries["name"][:-1]]) if len(entries) else twin
    yield from _blobs(0, entries[head], entries["name"][head] % np.uint64(buckets))
    yield from _blobs(1, entries[twin], entries["text"][twin] % np.uint64(buckets))


def _phrase_stage(buckets: int):
    """Texts to phrases: name, text number, place, and how many phrases the zone behind the cut holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    if len(text) < LENGTH or (number := text_number(text)) in seen:
                        continue
                    seen.add(number)
                    data = np.frombuffer(text, np.uint8)
                    places = cuts(data)
                    own = np.zeros(max(0, len(places) - 1), PHRASE)
                    if not len(own):
                        continue
                    own["name"], own["text"], own["at"] = phrases(data, places), np.int64(number).view(np.uint64), np.arange(len(own))
                    own["need"] = np.searchsorted(places, places[:-1] + ZONE, "right") - 1 - np.arange(len(own))
                    held.append(own)
                    size += len(own)
                    if size >= FLUSH:
                        yield from _sent(np.concatenate(held), buckets)
                        held, size = [], 0
        if held:
            yield from _sent(np.concatenate(held), buckets)
        _POWER["up"], _POWER["down"] = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # a worker lives longer than its longest text

    return run


def _gram_stage(buckets: int):
    """Texts to the grams that are least in a window of PASSAGE words: name, text number, place.

    Of a gram's places in one text two are enough to know that it repeats.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                for text in texts:
                    if len(text) < 2 * PASSAGE - 1 or (number := text_number(text)) in seen:
                        continue
                    seen.add(number)
                    grams, _, low = word_windows(np.frombuffer(text, np.uint8))
                    if not len(low):
                        continue
                    at = np.nonzero(np.isin(grams, low))[0]
                    order = at[np.argsort(grams[at], kind="stable")]
                    third = np.concatenate([[False, False], grams[order][2:] == grams[order][:-2]])[:len(order)]
                    at = order[~third]
                    own = np.zeros(len(at), SUFFIX)
                    own["name"], own["text"], own["at"] = grams[at], np.int64(number).view(np.uint64), at
                    held.append(own)
                    size += len(own)
                    if size >= FLUSH:
                        yield from _sent(np.concatenate(held), buckets)
                        held, size = [], 0
        if held:
            yield from _sent(np.concatenate(held), buckets)
        _POWER["up"], _POWER["down"] = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    return run


def _repeated_stage(buckets: int):
    """Phrases that occur at two places or more go back to their text; a phrase that occurs once is in no repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, known = _gathered(batches, PHRASE, PHRASE)
        fresh = _own(fresh)
        out = np.concatenate([fresh[_twins(fresh)], known])
        yield from _blobs(0, out, out["text"] % np.uint64(buckets))

    return run


def suffix_names(text: np.ndarray, at: np.ndarray, letter: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Names of phrase suffixes by a difference cover modulo 3, in a string sorted by text and place.

    Sampled are the places 1 and 2 modulo 3. A triple of letters gets a name, and so does a triple of names that stand
    3, 9, ... places apart: after r rounds a name stands for 3**r letters. A suffix of ``need`` letters is named by the
    longest such name inside it. Two suffixes of which one is not sampled are compared one or two letters further on,
    where both are: places 0 and 1 by their first letter and the name behind it, places 0 and 2 by two letters and the
    name behind them; where ``need`` is too short for that, by three letters. Every pair of equal suffixes so gets an
    equal name in one of these four lists. Only suffixes whose needed letters all repeat are named.
    """
    n = len(at)
    out: list[np.ndarray] = []
    if not n:
        return np.zeros(0, SUFFIX)
    broken = np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    heads = np.nonzero(broken)[0]
    end = np.append(heads[1:], n)[np.cumsum(broken) - 1]
    place, mod = np.arange(n), at % 3
    names, sampled = [], np.nonzero((mod != 0) & (place + 2 < end))[0]
    first = np.zeros(n, np.uint64)
    first[sampled] = _mix(letter[sampled], letter[sampled + 1], letter[sampled + 2])
    names.append(first)
    step = 3
    while step * 3 <= int(need.max()):
        sampled = sampled[sampled + 3 * step - 1 < end[sampled]]
        longer = np.zeros(n, np.uint64)
        longer[sampled] = _mix(names[-1][sampled], names[-1][sampled + step], names[-1][sampled + 2 * step])
        names.append(longer)
        step *= 3
    table = np.stack(names)
    whole = place + need <= end

    def depth(letters: np.ndarray) -> np.ndarray:
        return np.searchsorted(3 ** np.arange(1, len(names) + 1), letters, "right") - 1

    def put(tag: int, chosen: np.ndarray, skip: int) -> None:
        i = np.nonzero(chosen & whole)[0]
        own = np.zeros(len(i), SUFFIX)
        tail = table[depth(need[i] - skip), i + skip] if skip < 3 else letter[i + 2]
        own["name"] = _mix(np.full(len(i), tag), need[i], tail, *[letter[i + k] for k in range(min(skip, 2))])
        own["text"], own["at"] = text[i], at[i]
        out.append(own)

    put(0, (mod != 0) & (need >= 3), 0)
    put(1, (mod != 2) & (need >= 4), 1)
    put(2, (mod != 1) & (need >= 5), 2)
    put(3, (need >= 3) & (need <= 4), 3)
    return np.concatenate(out)


def _suffix_stage(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own,) = _gathered(batches, PHRASE)
        order = np.lexsort((own["at"], own["text"]))
        own = own[order]
        if len(own):
            own = own[np.concatenate([[True], (own["text"][1:] != own["text"][:-1]) | (own["at"][1:] != own["at"][:-1])])]
        yield from _sent(suffix_names(own["text"], own["at"].astype(np.int64), own["name"], own["need"].astype(np.int64)), buckets)

    return run


def _adjacent_stage(buckets: int):
    """Suffixes in order of their names; the places of those equal to a neighbour go back to their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, known = _gathered(batches, SUFFIX, SUFFIX)
        fresh = _own(fresh)
        out = np.concatenate([fresh[_twins(fresh)], known])
        places = np.zeros(len(out), PLACE)
        places["text"], places["at"] = out["text"], out["at"]
        yield from _blobs(0, places, places["text"] % np.uint64(buckets))

    return run


def _places_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text: its suspect places."""
    (out,) = _gathered(batches, PLACE)
    out = out[np.lexsort((out["at"], out["text"]))]
    if len(out):
        heads = np.nonzero(np.concatenate([[True], out["text"][1:] != out["text"][:-1]]))[0]
        ends = np.append(heads[1:], len(out))
        yield pa.RecordBatch.from_arrays([pa.array(out["text"][heads].view(np.int64)),
                                          pa.array([np.unique(out["at"][a:b]).astype("<u4").tobytes() for a, b in zip(heads, ends)], pa.binary())],
                                         names=["number", "places"])


def _removed(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    digest, last = hashlib.sha256(), 0
    view = memoryview(text)
    for a, b in spans:
        digest.update(view[last:a])
        last = b
    digest.update(view[last:])
    return sum(b - a for a, b in spans), len(spans), digest.hexdigest()


_MET = ("row long, n_bytes long, settled boolean, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, "
        "kept_text string, body binary, places binary")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _kept_text(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the whole characters inside the spans; a character that a span cuts stays."""
    out, last = [], 0
    inside = lambda i: i < len(text) and 0x80 <= text[i] < 0xC0
    for a, b in spans:
        while a < b and inside(a):
            a += 1
        while b > a and inside(b):
            b -= 1
        out.append(text[last:a])
        last = b
    return (b"".join(out) + text[last:]).decode()


def _as_structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _met_stage(batches: Iterator[pa.RecordBatch], with_text: bool, passages: bool) -> Iterator[pa.RecordBatch]:
    """Whole texts with their suspect places; a text that occurs twice, or has no such place, is settled here."""
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string(), pa.binary(), pa.binary())
    for batch in batches:
        rows, places, copied = (batch.column(c).to_pylist() for c in ("row", "places", "copied"))
        for first, texts in slices(batch.column("body")):
            out = []
            for i, text in enumerate(texts, first):
                long_enough = bool(places[i] or copied[i]) and (len(text.split()) >= PASSAGE if passages else len(text) >= LENGTH)
                found = (places[i] or b"") if long_enough else b""
                whole = long_enough and hashlib.md5(text).hexdigest() in (copied[i] or ())
                settled = whole or not found
                spans = [(0, len(text))] if whole else []
                result = (*_removed(text, spans), _as_structs(spans), _kept_text(text, spans) if with_text else None) if settled else (None,) * 5
                out.append((rows[i], len(text), settled, *result, text if found else None, found or None))
            columns = [batch.column("key").slice(first, len(texts)), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *(x.split()[0] for x in _MET.split(", "))])


def contexts(row: int, text: bytes, places: np.ndarray) -> np.ndarray:
    """Around each suspect cut: a digest of what all its windows share, and the bytes on both sides of that.

    A window belongs to its first cut at SPAN - 1 bytes or more from its start. Window j of a cut starts j bytes before
    the core, so it has j bytes of the left side and SIDE - j of the right.
    """
    data = np.frombuffer(text, np.uint8)
    at = cuts(data)
    n = len(text)
    places = places[places < len(at)]
    cut = at[places]
    before = np.where(places > 0, at[places - 1], -1 - n)
    low, high = np.maximum(0, before - SIDE + 1), np.minimum(cut - SIDE, n - LENGTH)
    ok = high >= low
    cut, low, high = cut[ok], low[ok], high[ok]
    out = np.zeros(len(cut), CONTEXT)
    if not len(cut):
        return out
    side = np.zeros((len(cut), 2 * SIDE), np.uint8)
    offset = np.arange(SIDE)
    left = cut[:, None] - CORE_LEFT - 1 - offset  # nearest first
    right = cut[:, None] + CORE_RIGHT + offset
    in_left, in_right = left >= low[:, None], right < (high + LENGTH)[:, None]
    side[:, :SIDE][in_left] = data[left[in_left]]
    side[:, SIDE:][in_right] = data[right[in_right]]
    blake = hashlib.blake2b
    out["core"] = [blake(text[c - CORE_LEFT:c + CORE_RIGHT], digest_size=16).digest() for c in cut.tolist()]
    out["low"], out["high"] = cut - SIDE - high, cut - SIDE - low
    out["side"] = np.ascontiguousarray(side).view(f"V{2 * SIDE}").ravel()
    out["row"], out["cut"] = row, cut
    return out


_FACE = CONTEXT.fields["row"][1]


SPREAD = np.dtype([("row", "<i8"), ("first", "<u4"), ("last", "<u4")])


def _by_face(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by face, and the number of each entry's face in that order; faces are compared through two hashes."""
    raw = np.frombuffer(entries.tobytes(), np.uint8).reshape(len(entries), CONTEXT.itemsize)[:, :_FACE]
    words = np.zeros((len(entries), -(-_FACE // 8) * 8), np.uint8)
    words[:, :_FACE] = raw
    words = words.view(np.uint64)
    one, two = np.zeros(len(entries), np.uint64), np.zeros(len(entries), np.uint64)
    for k in range(words.shape[1]):
        one, two = _mix(one, words[:, k]), _mix(words[:, k], two, np.uint64(k))
    core = words[:, 0]
    order = np.lexsort((two, one, words[:, 1], core))
    fresh = np.ones(len(entries), bool)
    if len(entries):
        a, b = order[1:], order[:-1]
        fresh[1:] = (one[a] != one[b]) | (two[a] != two[b]) | (core[a] != core[b]) | (words[a, 1] != words[b, 1])
    return order, np.cumsum(fresh) - 1


def _starts(entries: np.ndarray) -> np.ndarray:
    """All window starts of the entries as ranges."""
    out = np.zeros(len(entries), SPREAD)
    out["row"] = entries["row"]
    out["first"] = entries["cut"] - SIDE - entries["high"]
    out["last"] = entries["cut"] - SIDE - entries["low"]
    return out


def _context_stage(buckets: int):
    """Contexts to the bucket of their core; equal ones that meet here are hits, and one of them travels."""
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate(held)
        order, face = _by_face(entries)
        entries = entries[order]
        many = np.bincount(face, minlength=1)[face] > 1 if len(face) else np.zeros(0, bool)
        head = np.concatenate([[True], face[1:] != face[:-1]]) if len(face) else many
        hits = _starts(entries[many])
        entries["known"] = many
        travel = entries[head]
        core = np.frombuffer(travel["core"].tobytes(), "<u8")[::2]
        yield from _blobs(0, travel, core % np.uint64(buckets))
        yield from _blobs(1, hits, hits["row"] % buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(contexts(row, text, np.unique(np.frombuffer(places, "<u4")).astype(np.int64)))
                size += len(held[-1])
                if size >= FLUSH // 8:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    return run


def equal_windows(entries: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Ranges of window starts that occur elsewhere too, among the contexts of one bucket."""
    if not len(entries):
        return np.zeros(0, SPREAD)
    order, face = _by_face(entries)
    entries = entries[order]
    out = []
    counts = np.bincount(face)
    whole = (counts[face] > 1) | (entries["known"] > 0)
    whole = (np.bincount(face, whole) > 0)[face]
    out.append(_starts(entries[whole]))
    heads = np.nonzero(np.concatenate([[True], face[1:] != face[:-1]]))[0]
    one, done = entries[heads], whole[heads]
    core = np.frombuffer(one["core"].tobytes(), "<u8").reshape(-1, 2)
    group = np.cumsum(np.concatenate([[True], (core[1:] != core[:-1]).any(axis=1)])) - 1
    # A group needs a look if it has several contexts and one of them that is no hit as a whole.
    look = ((np.bincount(group) > 1) & (np.bincount(group, ~done) > 0))[group]
    one, done, group = one[look], done[look], group[look]
    edges = [0]
    while edges[-1] < len(one):
        stop = min(len(one), edges[-1] + chunk)
        if stop < len(one):
            tail = np.searchsorted(group, group[stop], "left")
            stop = int(tail) if tail > edges[-1] else int(np.searchsorted(group, group[stop], "right"))
        edges.append(stop)
    power = _powers(SIDE, int(_A))
    for a, b in zip(edges[:-1], edges[1:]):
        part = one[a:b]
        side = np.frombuffer(part["side"].tobytes(), np.uint8).reshape(len(part), 2 * SIDE).astype(np.uint64) + np.uint64(1)
        zero = np.zeros((len(part), 1), np.uint64)
        left = np.concatenate([zero, np.cumsum(side[:, :SIDE] * power, axis=1)], axis=1)
        right = np.concatenate([zero, np.cumsum(side[:, SIDE:] * power, axis=1)], axis=1)
        j = np.arange(SIDE + 1)
        valid = (j >= part["low"][:, None]) & (j <= part["high"][:, None])
        which, step = np.nonzero(valid)
        value = _mix(group[a:b][which], step, left[which, step], right[which, SIDE - step])
        sort = np.argsort(value, kind="stable")
        same = value[sort][1:] == value[sort][:-1]
        twin = np.zeros(len(value), bool)
        twin[sort[1:][same]] = True
        twin[sort[:-1][same]] = True
        hit = twin & ~done[a:b][which]
        which, step = which[hit], step[hit]
        start = part["cut"][which].astype(np.int64) - SIDE - step
        found = np.zeros(len(which), SPREAD)
        found["row"], found["first"], found["last"] = part["row"][which], start, start
        out.append(found)
    return np.concatenate(out)


def _window_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh, known = _gathered(batches, CONTEXT, SPREAD)
    yield from _ranges(np.concatenate([equal_windows(fresh), known]))


def _joined(found: np.ndarray) -> np.ndarray:
    """Neighbouring starts of a row become one range."""
    found = found[np.lexsort((found["first"], found["row"]))]
    if not len(found):
        return found
    apart = (found["row"][1:] != found["row"][:-1]) | (found["first"][1:].astype(np.int64) > found["last"][:-1].astype(np.int64) + 1)
    heads = np.nonzero(np.concatenate([[True], apart]))[0]
    out = found[heads]
    out["last"] = np.maximum.reduceat(found["last"], heads)
    return out


def _ranges(found: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = _joined(found)
    if len(out):
        yield pa.RecordBatch.from_arrays([pa.array(out["row"]), pa.array(out["first"].astype(np.int64)), pa.array(out["last"].astype(np.int64))],
                                         names=["row", "first", "last"])


def _word_starts(entries: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entries), SPREAD)
    out["row"], out["first"], out["last"] = entries["text"].view(np.int64), entries["at"], entries["at"]
    return _joined(out)


def _passage_stage(buckets: int):
    """Word windows with a suspect least gram to the bucket of their name; equal ones that meet here are hits, one of them travels."""
    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = _own(np.concatenate(held))
        head = np.concatenate([[True], entries["name"][1:] != entries["name"][:-1]])
        hits = _word_starts(entries[_twins(entries)])
        yield from _blobs(0, entries[head], entries["name"][head] % np.uint64(buckets))
        yield from _blobs(1, hits, hits["row"] % buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                places = np.frombuffer(places, "<u4")
                grams, whole, low = word_windows(np.frombuffer(text, np.uint8))
                at = np.nonzero(np.isin(low, grams[places[places < len(grams)]]))[0]
                own = np.zeros(len(at), SUFFIX)
                own["name"], own["text"], own["at"] = whole[at], np.int64(row).view(np.uint64), at
                held.append(own)
                size += len(own)
                if size >= FLUSH:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)
        _POWER["up"], _POWER["down"] = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    return run


def _equal_passage_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh, known = _gathered(batches, SUFFIX, SPREAD)
    fresh = _own(fresh)
    yield from _ranges(np.concatenate([_word_starts(fresh[_twins(fresh)]), known]))


def _covered(text: bytes, starts: list[tuple[int, int]], passages: bool) -> list[tuple[int, int]]:
    """The bytes that ranges of window starts cover, as disjoint spans in order."""
    if passages:
        begin, end = word_bounds(np.frombuffer(text, np.uint8))
    spans: list[tuple[int, int]] = []
    for first, last in sorted(starts):
        a, b = (int(begin[first]), int(end[last + PASSAGE - 1])) if passages else (first, last + LENGTH)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _final_stage(batches: Iterator[pa.RecordBatch], with_text: bool, passages: bool) -> Iterator[pa.RecordBatch]:
    """Cover the hit windows of each text and digest what is left."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS, pa.string())
    for batch in batches:
        starts, out = batch.column("starts").to_pylist(), []
        for i, body in enumerate(batch.column("body")):
            text = body.as_py()
            spans = _covered(text, [(s["first"], s["last"]) for s in starts[i] or ()], passages)
            out.append((len(text), *_removed(text, spans), _as_structs(spans), _kept_text(text, spans) if with_text else None))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                                             names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"])


_ROWS = "bucket int, kind int, entries binary"


def repeated_bytes(documents: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False, passages: bool = False) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans, kept_sha256 and the removed ``spans`` (byte ranges) of every row.

    ``with_text`` adds ``kept_text``, what is left with whole characters; the key may be a struct of any columns.

    A byte is removed if a string of LENGTH bytes over it starts anywhere else, in this text or another. Null texts are
    empty; texts below LENGTH bytes keep all; of equal texts of LENGTH bytes or more all are removed whole, and so are
    repeated rows. Null keys are keys like others; other columns are not looked at; an empty table gives no rows.

    1. Texts are cut into phrases by content, and phrases that occur once in the corpus are dropped: no repeat holds one.
    2. Over the strings of phrases that are left, a difference cover modulo 3 names suffixes: triples at sampled
       places, triples of names, and the other places by a letter or two and a sampled name.
    3. The names are sorted, bucket by bucket, and neighbours compared: a place whose suffix equals no other's is out.
    4. Windows at the places left are compared byte for byte over the core that they share and hashed over its two sides.

    A name, phrase or context that a third of all rows share costs a row a task, since each task sends it once.

    With ``passages`` the windows are PASSAGE consecutive words in place of LENGTH bytes, however many bytes they have:
    removed are their words and the white space between, and equal texts of PASSAGE words or more go whole. The grams
    that are least in some window take the place of steps 1 and 2, and windows are compared by a 64-bit hash of all words.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{key}`").alias("key"), F.encode(no_null(F.col(f"`{text}`")), "UTF-8").alias("body"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def dealt(frame: DataFrame, stage, schema: str) -> DataFrame:
        return frame.repartitionById(buckets, "bucket").mapInArrow(stage, schema)

    if passages:
        suffixes = rows.select("body").mapInArrow(_gram_stage(buckets), _ROWS)
    else:
        names = rows.select("body").mapInArrow(_phrase_stage(buckets), _ROWS)
        repeated = dealt(names, _repeated_stage(buckets), _ROWS)
        suffixes = dealt(repeated, _suffix_stage(buckets), _ROWS)
    suspects = dealt(dealt(suffixes, _adjacent_stage(buckets), _ROWS), _places_stage, "number long, places binary")

    digest = F.md5("body")
    number = lambda c: F.conv(F.substring(c, 1, 16), 16, -10).cast("long")
    least = 2 * PASSAGE - 1 if passages else LENGTH
    twice = (rows.filter(F.octet_length("body") >= least).groupBy(digest.alias("digest")).agg(F.count("*").alias("n")).filter("n > 1")
             .groupBy(number("digest").alias("number")).agg(F.collect_list("digest").alias("copied")))
    known = suspects.join(twice, "number", "full")
    numbered = rows.select("key", F.monotonically_increasing_id().alias("row"), "body", number(digest).alias("number"))
    kind = numbered.schema["key"].dataType.simpleString()
    met = written(numbered.join(known, "number", "left").select("key", "row", "body", "places", "copied")
                  .mapInArrow(lambda b: _met_stage(b, with_text, passages), f"key {kind}, {_MET}"), "suspects", "zstd" if passages else None)

    around, meet = (_passage_stage, _equal_passage_stage) if passages else (_context_stage, _window_stage)
    sent = met.filter("places is not null").select("row", "body", "places").mapInArrow(around(buckets), _ROWS)
    hits = dealt(sent, meet, "row long, first long, last long")
    starts = hits.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    fields = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    open_rows = (met.filter("not settled").select("key", "row", "body").join(starts, "row", "left").select("key", "body", "starts")
                 .mapInArrow(lambda b: _final_stage(b, with_text, passages), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                             "spans array<struct<start:long,end:long>>, kept_text string"))
    out = met.filter("settled").select("key", *fields).unionByName(open_rows).drop(*([] if with_text else ["kept_text"]))
    return out.withColumnRenamed("key", key)


def without_repeats(documents: DataFrame, text: str = "text", passages: bool = False) -> DataFrame:
    """The documents with all their columns and no repeated string of LENGTH bytes in their texts; no row goes.

    With ``passages`` no repeated run of PASSAGE words instead. Null texts become empty. A column ``n_chars`` of whole
    numbers follows the text that is left.
    """
    others = [c for c in documents.columns if c != text]
    keyed = documents.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("key"), F.col(f"`{text}`").alias("text"))
    out = repeated_bytes(keyed, "key", "text", with_text=True, passages=passages)
    columns = [F.col("kept_text").alias(c) if c == text else F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(f"key.`{c}`")
               for c in documents.columns]
    return out.select(*columns)
