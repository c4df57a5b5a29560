"""Range joins by bucket, merges with provenance, set-style joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import names


def _bucket(c, days):
    """Time bucket; below one day it is cut from the instant instead of the date."""
    if days < 1:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / int(days * 86400))
    return F.floor(F.unix_date(c.cast("date")) / days)


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, by=(), *, bucket_days: float = 30,
               open_end: bool = False, how: str = "inner") -> DataFrame:
    """Points inside [start, end] (``open_end``: [start, end), missing end = no end).

    A span is copied to every bucket it touches and meets points by equality on (by, bucket),
    so the work is proportional to the matches. An endless span is closed at the last point.
    """
    by = names(by)
    right = [c for c in spans.columns if c not in by]
    stop = F.col(end)
    if open_end:
        stop = F.coalesce(stop, points.agg(F.max(point)).scalar())
    lo, hi = _bucket(F.col(start), bucket_days), _bucket(stop, bucket_days)
    s = spans.filter(lo <= hi).withColumn("_bkt", F.explode(F.sequence(lo, hi))).select(*by, "_bkt", *right)
    p = points.withColumn("_bkt", _bucket(F.col(point), bucket_days))
    s = s.withColumnsRenamed({b: f"_s_{b}" for b in [*by, "_bkt"]})
    keys = [F.col(b) == F.col(f"_s_{b}") for b in [*by, "_bkt"]]
    before = F.col(end).isNull() | (F.col(point) < F.col(end)) if open_end else F.col(point) <= F.col(end)
    on = (F.col(point) >= F.col(start)) & before
    for k in keys:
        on = on & k
    joined = p.join(s, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bkt")
    return joined.drop("_bkt", *[f"_s_{b}" for b in [*by, "_bkt"]])


def prefer_left(a: DataFrame, b: DataFrame, key, value: str, *, scale=1.0, tags=("first", "second")) -> DataFrame:
    """Full outer merge: the first series wins, the second fills gaps times ``scale``; provenance kept."""
    key = names(key)
    left = a.select(*key, F.col(value).alias("_a"))
    right = b.select(*key, F.col(value).alias("_b"))
    scale = scale if not isinstance(scale, (int, float)) else F.lit(float(scale))
    return left.join(right, key, "full").select(
        *key,
        F.coalesce(F.col("_a"), F.col("_b") * scale).alias(value),
        F.when(F.col("_a").isNotNull(), tags[0]).otherwise(tags[1]).alias("origin"),
    )


def combine_first(fresh: DataFrame, archive: DataFrame, key, columns=None) -> DataFrame:
    """Cell by cell: the fresh value where present, else the archived one; columns of either side are kept."""
    key = names(key)
    columns = columns or sorted((set(fresh.columns) | set(archive.columns)) - set(key))
    f = fresh.withColumnsRenamed({c: f"_f_{c}" for c in columns if c in fresh.columns})
    o = archive.withColumnsRenamed({c: f"_o_{c}" for c in columns if c in archive.columns})
    have = lambda c: [F.col(p + c) for p, d in (("_f_", fresh), ("_o_", archive)) if c in d.columns]
    return f.join(o, key, "full").select(*key, *[F.coalesce(*have(c)).alias(c) for c in columns])


def keep_common(df: DataFrame, date, member: str, members: int) -> DataFrame:
    """Rows on dates where all ``members`` distinct members are present."""
    date = names(date)
    full = df.groupBy(*date).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") == members).select(*date)
    return df.join(full, date, "left_semi")


def append_first(existing: DataFrame, new: DataFrame, key="record_id", order=()) -> DataFrame:
    """The rows of ``new`` that may be appended: one per key, key not present yet."""
    from .frames import pick_first

    fresh = pick_first(new, key, [*order]) if order else new.dropDuplicates(names(key))
    return fresh.join(existing.select(*names(key)), names(key), "left_anti")
