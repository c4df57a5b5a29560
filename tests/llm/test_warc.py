"""Round trips of archives: bytes, digests, revisits, chunks."""

import hashlib
import gzip
from collections import Counter
from pathlib import Path

import pytest

from tidemark.llm import warc

from .cases import prose

END = b"\r\n\r\n"


def pages(spark, rows, extra=True):
    schema = "page_id long, url string, html string" + (", key string, digest string, chunk string, body string, size long" if extra else "")
    return spark.createDataFrame([(*r, *(("x",) * 4 + (1,) if extra else ())) for r in rows], schema)


ROWS = [(1, "http://a/\r\nX: y", prose(1, 400)), (2, None, prose(1, 400)), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
        (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n" * 60), (8, "u", "\r\n\r\n" * 400), (9, "u", "é" * 90_000), (9, "u", "é" * 90_000),
        (None, "u", prose(1, 400)), (None, "u", prose(2, 400)), (10, "u", "x" * 999), (11, "u", "x" * 999), (12, "u", "y" * 1000), (13, "u", "y" * 1000)]


def expected():
    data = [(k, (h or "").encode()) for k, _, h in ROWS]
    out = []
    for k, b in data:
        keys = [x for x, c in data if c == b and x is not None]
        first = max(keys) if keys and len(b) >= 1000 else None
        revisit = first is not None and (k is None or k < first)
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


def test_round_trip(spark, tmp_path):
    out = warc.archive_round_trip(pages(spark, ROWS), str(tmp_path / "w"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()]
    assert Counter(got) == Counter(expected())


def test_chunks_and_running_digests(spark, tmp_path):
    warc.write_warc(warc.chunk_table(pages(spark, ROWS), chunk_bytes=1000), str(tmp_path / "w"))
    rows = warc.read_warc(spark, str(tmp_path / "w")).filter("page_key = '7'").orderBy("chunk_no").collect()
    payload = ROWS[6][2].encode()
    assert len(rows) == -(-len(payload) // 1000) and b"".join(bytes(r.chunk) for r in rows) == payload
    for i, r in enumerate(rows):
        assert r.running_digest == hashlib.sha1(payload[:(i + 1) * 1000]).hexdigest() and r.last == (i == len(rows) - 1)


def test_files_are_warc(spark, tmp_path):
    warc.write_warc(warc.chunk_table(pages(spark, ROWS[:3], extra=False)), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("*.gz"))
    count = 0
    while data:
        head, _, rest = data.partition(END)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"\r\nX: y" not in head
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[size:size + 4] == END
        data = rest[size + 4:]
        count += 1
    assert count == 3


def test_empty_table(spark, tmp_path):
    assert warc.archive_round_trip(pages(spark, ROWS).filter("false"), str(tmp_path / "w")).count() == 0


def test_payloads_and_cuts_that_end_in_line_ends(spark, tmp_path):
    ends = ["\r\n", "\r", "\n", "\r\n\r", "\r\n\r\n", "\r\n" * 3, "\r\r\n", "\n\r\n"]
    rows = [(i, "u", "</html>" * (i % 3) + e) for i, e in enumerate(ends * 3)]
    want = {(k, len(h), hashlib.sha1(h.encode()).hexdigest()) for k, _, h in rows}
    for parts in (1, len(rows)):  # many records a file, and each the last of its file
        folder = str(tmp_path / f"w{parts}")
        warc.write_warc(warc.chunk_table(pages(spark, rows)).repartition(parts), folder)
        out = warc.archived_records(spark, folder).collect()
        assert len(out) == len(rows) and {(r.page_id, r.payload_bytes, r.payload_digest) for r in out} == want
    long = [(1, "u", "a\r\nb\r\n\r\n\rc\n" * 40), (2, "u", "\r\n" * 300)]
    for size in (1, 2, 3, 4, 5, 7):
        folder = str(tmp_path / f"c{size}")
        warc.write_warc(warc.chunk_table(pages(spark, long), chunk_bytes=size), folder)
        chunks = warc.read_warc(spark, folder).collect()
        for k, _, h in long:
            own = sorted((r.chunk_no, bytes(r.chunk)) for r in chunks if r.page_key == str(k))
            assert [c for _, c in own] == [h.encode()[a:a + size] for a in range(0, len(h), size)]


def test_lost_bytes_are_told(spark, tmp_path):
    warc.write_warc(warc.chunk_table(pages(spark, ROWS[2:3])), str(tmp_path / "w"))
    (file,) = [p for p in Path(tmp_path / "w").glob("*.gz")]
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "x.txt.gz").write_bytes(gzip.compress(gzip.decompress(file.read_bytes())[:-6]))
    with pytest.raises(Exception, match="the archive ends inside record"):
        warc.read_warc(spark, str(tmp_path / "short")).collect()
