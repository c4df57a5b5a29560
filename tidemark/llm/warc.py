"""WARC archives as a chunked record table: written by Spark's text writer, read back piece by piece."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_folder

CHUNK_BYTES = 64 << 10
REVISIT_FROM = 1000
SALTS = 32
END = "\r\n\r\n"
CHUNKS = pa.schema([("page_key", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()),
                    ("payload_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk_no", pa.int32()),
                    ("chunk", pa.binary()), ("running_digest", pa.string()), ("last", pa.bool_())])
_SCHEMA = ("page_key string, record_type string, refers_to string, url string, payload_bytes long, declared_digest string, "
           "chunk_no int, chunk binary, running_digest string, last boolean")


def _with_first(records: DataFrame) -> DataFrame:
    """``first``: the largest key among the records of equal payload, for payloads of REVISIT_FROM bytes and more.

    Records of one payload are spread over SALTS keys, so a payload that a third of all records share is no hot key.
    """
    large = records.filter(F.col("size") >= REVISIT_FROM).select("digest", "size", "key", "salt")
    part = large.groupBy("digest", "size", "salt").agg(F.max("key").alias("key"))
    first = (part.groupBy("digest", "size").agg(F.max("key").alias("first"), F.collect_set("salt").alias("salts"))
             .select("digest", "size", "first", F.explode("salts").alias("salt")))
    return records.join(first, ["digest", "size", "salt"], "left")


def chunk_table(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row a chunk in record order: record fields, ``chunk_no`` from 0 and the ``chunk`` bytes.

    Null payloads are empty. Records with equal payloads of at least 1000 bytes: those that hold the largest key are
    responses, the others revisits without bytes that refer to it (rows that repeat the largest key are all responses;
    a null key is below any other). A record of no bytes has one empty chunk.
    """
    data = F.encode(F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), data.alias("data"))
    # The payload itself does not travel: digests find the first record, then the bytes are cut in place.
    records = base.withColumns({"digest": F.sha1("data"), "size": F.octet_length("data").cast("long")})
    firsts = _with_first(records.select("digest", "size", "key", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")))
    revisits = (firsts.filter("first is not null and (key is null or key < first)")
                .groupBy(F.col("key").alias("r_key"), F.col("digest").alias("r_digest"), F.col("size").alias("r_size"))
                .agg(F.max("first").alias("first")))
    told = records.join(revisits, F.col("key").eqNullSafe(F.col("r_key")) & (F.col("digest") == F.col("r_digest"))
                        & (F.col("size") == F.col("r_size")), "left").select("key", "url", "data", "digest", "size", "first")
    body = F.when(F.col("first").isNull(), F.col("data")).otherwise(F.lit(b""))
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(chunk_bytes)).cast("int"))
    return (told.withColumn("body", body).withColumn("pieces", pieces)
            .select("key", "url", "digest", "size", "first", "body", "pieces",
                    F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("chunk_no"))
            .select("key", "url", "digest", "size", "first", "chunk_no", "pieces",
                    F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk")))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(chunks: DataFrame, folder: str) -> None:
    """Write the chunk table as gzipped WARC files: the first chunk as response or revisit, the rest as continuations."""
    uri = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("none")), F.lit(">"))
    first, many = F.col("chunk_no") == 0, F.col("pieces") > 1
    kind = F.when(~first, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")
    header = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(first, uri(F.col("key"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(":part:"), F.col("chunk_no").cast("string"), F.lit(">")))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.when(first, F.regexp_replace("url", r"[\r\n]", " "))),
        _line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        _line("X-Payload-Length", F.when(first, F.col("size").cast("string"))),
        _line("WARC-Refers-To", F.when(first & F.col("first").isNotNull(), uri(F.col("first")))),
        _line("WARC-Segment-Number", F.when(many, (F.col("chunk_no") + 1).cast("string"))),
        _line("WARC-Segment-Origin-ID", F.when(~first, uri(F.col("key")))),
        _line("WARC-Segment-Total-Length", F.when(many & (F.col("chunk_no") == F.col("pieces") - 1), F.col("size").cast("string"))),
        _line("Content-Length", F.octet_length("chunk").cast("string")), F.lit("\r\n"))
    record = F.concat(F.encode(header, "UTF-8"), "chunk").cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(folder)


def _fields(head: bytes | bytearray) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        out[name] = value
    return out


def _page(uri: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return found[1] if found else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records cut by their declared lengths; holds one chunk, its head and a running digest at a time.

    The text reader splits at every ``\\r\\n\\r\\n``, two bytes early where a chunk ends in CR LF; so its pieces are joined
    again and nothing rests on where they were split.
    """
    end = END.encode()
    head: dict | None = None
    buffer = bytearray()
    origin, digest, seen = {}, hashlib.sha1(), 0
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            buffer += piece
            buffer += end
            while buffer:
                if head is None:
                    raw, _, buffer = buffer.partition(end)
                    if not raw.startswith(b"WARC/"):
                        raise ValueError(f"no record head: {bytes(raw[:80])!r}")
                    head = _fields(raw)
                    if head.get("WARC-Type") != "continuation":
                        origin, digest, seen = head, hashlib.sha1(), 0
                size = int(head["Content-Length"])
                if len(buffer) < size + len(end):
                    break
                chunk = bytes(buffer[:size])
                if buffer[size:size + len(end)] != end:
                    raise ValueError(f"no separator after record {head['WARC-Record-ID']}")
                del buffer[:size + len(end)]
                if buffer == end:  # a file that ends in such an early split has the rest, CR LF, as its last piece
                    buffer.clear()
                digest.update(chunk)
                part = int(head.get("WARC-Segment-Number", 1))
                seen += len(chunk)
                total = int(origin["X-Payload-Length"])
                last = origin["WARC-Type"] == "revisit" or seen == total
                out.append((_page(origin["WARC-Record-ID"]), origin["WARC-Type"], _page(origin.get("WARC-Refers-To")),
                            origin.get("WARC-Target-URI"), total, origin["WARC-Payload-Digest"].removeprefix("sha1:"), part - 1,
                            chunk, digest.copy().hexdigest(), last))
                held += len(chunk)
                head = None
            if held >= 4 << 20 or len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), CHUNKS)], schema=CHUNKS)
                out, held = [], 0
    if head is not None:
        raise ValueError(f"the archive ends inside record {head['WARC-Record-ID']}")
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), CHUNKS)], schema=CHUNKS)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk table of archives that ``write_warc`` wrote: record fields, chunk bytes and the SHA-1 so far.

    Gzipped files are not split, so a task reads its records in order; Spark's text reader streams the pieces between
    blank lines, so what a task holds is bounded by a chunk and a batch, not by a record or a file.
    """
    pieces = spark.read.option("lineSep", END).text(folder).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_parsed, _SCHEMA)


def archived_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: type, what it refers to, and the size and digest of its full payload.

    A response's are those of the bytes read (its last chunk's running digest); a revisit has no bytes, so its are the
    ones that its record declares.
    """
    last = read_warc(spark, folder).filter("last")
    revisit = F.col("record_type") == "revisit"
    return last.select(F.col("page_key").cast("long").alias("page_id"), "url", "payload_bytes",
                       F.when(revisit, F.col("declared_digest")).otherwise(F.col("running_digest")).alias("payload_digest"),
                       "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def archive_round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write every row as a WARC record and read the archives back; an empty table writes no record and gives no rows."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    write_warc(chunk_table(pages, **columns), folder)
    return archived_records(spark, folder)
