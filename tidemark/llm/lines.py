"""Line dedup: normalised lines are hashed, documents counted a hash, crowded lines dropped and the rest put together by place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, no_null, written

MIN_CHARS = 20
MIN_DOCUMENTS = 3
#: A key with more than this share of all counted lines is hot. At most 1 / HOT_SHARE keys can be, so they are broadcast.
HOT_SHARE = 1 / 2000
#: Fixed value: the white space stripped from both ends of a line.
_ENDS = " \t\n\x0b\x0c\r"
#: The first input of each of the two 64-bit hashes that name a line or a text.
_SEEDS = (1, 2)


def _names(value, prefix: str) -> list:
    """Two 64-bit hashes with unlike seeds: one 128-bit name."""
    return [F.xxhash64(F.lit(s), value).alias(f"{prefix}{s}") for s in _SEEDS]


def line_places(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row a line whose key has ``min_chars`` code points: ``doc``, the text's name (t1, t2), the key's name (h1, h2)
    and ``places``, the numbers of its lines in the text. The key is the line without white space at its ends, A-Z lower-cased."""
    # The text is named before it is exploded; beside the explode it would be named once a line.
    named = documents.select(F.col(f"`{key}`").alias("doc"), *_names(no_null(f"`{text}`"), "t"), F.split(ascii_lower(no_null(f"`{text}`")), "\n", -1).alias("lines"))
    rows = named.select("doc", "t1", "t2", F.posexplode("lines").alias("place", "line"))
    stripped = rows.withColumn("line", F.btrim("line", F.lit(_ENDS))).filter(F.char_length("line") >= min_chars)
    return stripped.select("doc", "t1", "t2", *_names(F.col("line"), "h"), "place")


def crowded_lines(places: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Names of lines found in ``min_documents`` documents or more, with the largest document (``top``) and the line count.

    Rows with one id are one document, null ids too; null is less than any id. The lines of a document fold before those
    of a name, so that a hot line is spread by document and then costs a row a task.
    """
    a_document = places.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n"))
    return (a_document.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.max("doc").alias("top"))
            .filter(F.col("documents") >= min_documents).select("h1", "h2", "top", "n"))


def dropped_places(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                   min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc``, t1, t2 and the sorted ``dropped`` line numbers of every text that loses lines.

    Hot names, of which there are 1 / HOT_SHARE at most, are met by broadcast where the lines are; all others by a join
    on the name, in which no name then has more than HOT_SHARE of the lines.
    """
    places = written(line_places(documents, key, text, min_chars), "lines")
    crowded = written(crowded_lines(places, min_documents), "crowded")
    total = places.count()
    hot = F.col("n") > total * HOT_SHARE
    goes = lambda met: met.filter(~F.col("doc").eqNullSafe(F.col("top"))).select("doc", "t1", "t2", "place")
    marked = places.join(F.broadcast(crowded.filter(hot).select("h1", "h2", "top", F.lit(True).alias("hot"))), ["h1", "h2"], "left")
    cold = marked.filter("hot is null").drop("top", "hot").join(crowded.filter(~hot), ["h1", "h2"])
    lost = goes(marked.filter("hot")).unionByName(goes(cold))
    return lost.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("dropped"))


def _left(body, dropped):
    """The text put together from the places that are not dropped. ``array_except`` hashes, so this is linear in the lines
    however many are dropped; the lines are bound once, as a lambda would split the text again at every place."""
    kept = let(F.split(body, "\n", -1), lambda own: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own) - 1), dropped), lambda i: F.get(own, i)))
    return F.when(dropped.isNull(), body).otherwise(F.array_join(kept, "\n"))


def deduplicated_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                       min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``key``, n_lines (before dropping), n_dropped and ``kept`` (the text that is left) of every row.

    Texts are split at line feeds; null and empty texts are one empty line. A key of ``min_chars`` code points or more
    that ``min_documents`` documents hold loses its lines everywhere but in the largest document that holds it, where
    all of them stay. Rows with one id are one document (so are rows without id, which come before any id); each row
    stays a row, and rows that share id and text share the result. If all lines go the text is empty. Other columns are
    not looked at; an empty table gives no rows.

    Texts are met with their dropped places by id and 128-bit name, so no row numbers have to hold between jobs.
    """
    lost = dropped_places(documents, key, text, min_chars, min_documents).select(
        F.col("doc").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "dropped")
    rows = documents.select(F.col(f"`{key}`").alias("doc"), no_null(f"`{text}`").alias("body"))
    rows = rows.select("doc", "body", *_names(F.col("body"), "t"))
    met = rows.join(lost, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    return met.select(
        F.col("doc").alias(key), F.size(F.split("body", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), _left(F.col("body"), F.col("dropped")).alias("kept"))


def without_crowded_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                          min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with all their columns and the crowded lines gone from their texts; no row goes, null becomes empty."""
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("record"))
    keyed = packed.select(F.col(f"record.`{key}`").alias("doc"), F.col(f"record.`{text}`").alias("body"), "record")
    lost = dropped_places(keyed, "doc", "body", min_chars, min_documents).select(
        F.col("doc").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "dropped")
    rows = keyed.select("record", "doc", no_null("body").alias("body")).select("record", "doc", "body", *_names(F.col("body"), "t"))
    met = rows.join(lost, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    return met.select(*[_left(F.col("body"), F.col("dropped")).alias(c) if c == text else F.col(f"record.`{c}`") for c in documents.columns])
