"""As-of joins without a nested loop and without one task per key.

Both sides are unioned and split into (key, time chunk) partitions, where a running ``last`` finds the match. A chunk
also receives the last right row of the chunks before it, from a table of one row per (key, chunk). So each side is
shuffled once, and a key holding a third of all rows is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import names


def _chunk(time: str, days: int) -> Column:
    return F.floor(F.unix_date(F.col(time).cast("date")) / days)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by=(),
    values=(),
    *,
    strict: bool = False,
    forward: bool = False,
    tolerance_days: int | None = None,
    chunk_days: int = 90,
) -> DataFrame:
    """Attach the last right row at or before (``strict``: before) each left row.

    ``forward`` looks ahead instead. The tolerance is inclusive. ``values`` may name
    ``right_time`` itself when the match date is wanted.
    """
    by, values = names(by), names(values)
    payload = F.struct(F.col(right_time).alias("_at"), *[F.col(v) for v in values])
    r = right.filter(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), payload.alias("_p"))
    l = left.select(*by, F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_row"))
    # Inclusive matching puts the right row first on equal times, strict the left row.
    right_first = 0 if not strict else 1
    if forward:
        right_first = 1 - right_first
    union = (
        l.withColumn("_side", F.lit(1 - right_first))
        .unionByName(r.withColumn("_side", F.lit(right_first)), allowMissingColumns=True)
        .withColumn("_c", _chunk("_t", chunk_days))
    )
    edges = r.withColumn("_c", _chunk("_t", chunk_days)).groupBy(*by, "_c").agg((F.min if forward else F.max)("_p").alias("_p"))
    order = Window.partitionBy(*by).orderBy("_c") if by else Window.partitionBy(F.lit(1)).orderBy("_c")
    reach = None if tolerance_days is None else tolerance_days // chunk_days + 1
    if forward:
        stop = F.lag("_c").over(order)
        far = l.select(F.min(_chunk("_t", chunk_days))).scalar() if reach is None else F.col("_c") - reach
        lo = F.coalesce(stop, far) if reach is None else F.greatest(far, F.coalesce(stop, far))
        ok = F.col("_lo") <= F.col("_c") - 1
        edges = edges.withColumn("_lo", lo)
        span = F.sequence(F.col("_lo"), F.col("_c") - 1)
    else:
        stop = F.lead("_c").over(order)
        far = l.select(F.max(_chunk("_t", chunk_days))).scalar() if reach is None else F.col("_c") + reach
        hi = F.coalesce(stop, far) if reach is None else F.least(far, F.coalesce(stop, far))
        edges = edges.withColumn("_hi", hi)
        span = F.sequence(F.col("_c") + 1, F.col("_hi"))
        ok = F.col("_c") + 1 <= F.col("_hi")
    carried = edges.filter(ok).withColumn("_c", F.explode(span)).select(*by, "_c", "_p")
    both = union.unionByName(carried, allowMissingColumns=True)
    # A carried row has no time of its own: it sorts before the chunk (after it when looking ahead).
    w = Window.partitionBy(*by, "_c")
    if forward:
        here = F.first("_p", ignorenulls=True).over(
            w.orderBy(F.col("_t").asc_nulls_last(), "_side", "_p").rowsBetween(0, Window.unboundedFollowing))
    else:
        here = F.last("_p", ignorenulls=True).over(
            w.orderBy(F.col("_t").asc_nulls_first(), "_side", "_p").rowsBetween(Window.unboundedPreceding, 0))
    matched = both.withColumn("_m", here).filter(F.col("_row").isNotNull())
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col("_t").cast("date"), F.col("_m._at").cast("date")))
        matched = matched.withColumn("_m", F.when(gap <= tolerance_days, F.col("_m")))
    kept = [F.col(f"_row.{c}").alias(c) for c in left.columns]
    return matched.select(*kept, *[F.col(f"_m.{v}").alias(v) for v in values])


def asof_backward(left, right, left_time, right_time, by, value, *, lag_days=1, tolerance_days=7, strict=False,
                  chunk_days=90):
    """Value and source date known at each left date: right date + lag <= left date, within the tolerance."""
    shifted = right.filter(F.col(value).isNotNull()).select(
        *names(by),
        F.date_add(F.col(right_time), lag_days).alias("_avail"),
        F.col(right_time).alias("source_date"),
        F.col(value).alias(value),
    )
    return asof_join(left, shifted, left_time, "_avail", by, [value, "source_date"], strict=strict,
                     tolerance_days=tolerance_days, chunk_days=chunk_days)


def asof_with_expiry(left, right, left_time, available, expires, by, values, chunk_days=365):
    """As-of join whose right rows stop counting after their own expiry date."""
    joined = asof_join(left, right, left_time, available, by, [*names(values), expires], chunk_days=chunk_days)
    alive = F.col(left_time) <= F.col(expires)
    return joined.select(*left.columns, *[F.when(alive, F.col(v)).alias(v) for v in names(values)])


def version_spans(versions: DataFrame, key, observed: str, chunk_days: int = 365) -> DataFrame:
    """Bitemporal rows with the time the next version replaced them (exclusive; missing for the newest)."""
    later = versions.select(*names(key), F.col(observed).alias("valid_to"))
    return asof_join(versions, later, observed, "valid_to", key, ["valid_to"], strict=True, forward=True, chunk_days=chunk_days)


def known_sweep(versions: DataFrame, key, period: str, observed: str, value: str, chunk_days: int = 365) -> DataFrame:
    """What is known of each key from each observation on: one row per (key, ``observed``), no row per period.

    ``newest`` is the latest version of the latest period seen so far (period, observed_at, value), ``known`` the number of
    periods seen, ``total`` the sum of their values as last revised. A version adds its change of value, and one to the count
    if its period is new, so each is a running sum or maximum over observation time. The sweep is cut into time chunks: a
    chunk runs by itself and starts from what earlier chunks of its key add up to, so no key is one task.
    """
    key = names(key)
    w = Window.partitionBy(*key, period).orderBy(observed)
    steps = versions.select(*key, F.col(observed).alias("_t"), F.struct(F.col(period).alias(period), F.col(observed).alias(observed), F.col(value).alias(value)).alias("_n"),
                            (F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))).alias("_d"), F.when(F.lag(observed).over(w).isNull(), 1).otherwise(0).cast("bigint").alias("_k"))
    moments = steps.groupBy(*key, "_t").agg(F.max("_n").alias("_n"), F.sum("_d").alias("_d"), F.sum("_k").alias("_k")).withColumn("_c", _chunk("_t", chunk_days))
    run = Window.partitionBy(*key, "_c").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    own = moments.select(*key, "_c", "_t", F.max("_n").over(run).alias("_n"), F.sum("_d").over(run).alias("_d"), F.sum("_k").over(run).alias("_k"))
    before = Window.partitionBy(*key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = moments.groupBy(*key, "_c").agg(F.max("_n").alias("_n"), F.sum("_d").alias("_d"), F.sum("_k").alias("_k"))
    carried = chunks.select(*key, "_c", F.max("_n").over(before).alias("_cn"), F.sum("_d").over(before).alias("_cd"), F.sum("_k").over(before).alias("_ck"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.join(carried, [*key, "_c"]).select(*key, F.col("_t").alias(observed), F.greatest("_n", F.coalesce("_cn", "_n")).alias("newest"),
                                                  (F.col("_k") + zero("_ck")).alias("known"), (F.col("_d") + zero("_cd")).alias("total"))


def _grid(versions: DataFrame, decisions: DataFrame, key, decision: str) -> DataFrame:
    """Every key at every decision time: the shape of the answer. Decision times are a calendar and ride along as an array."""
    times = decisions.agg(F.array_sort(F.collect_set(decision))).scalar()
    return versions.select(*names(key)).distinct().withColumn(decision, F.explode(times))


def known_at(versions: DataFrame, decisions: DataFrame, key, observed: str, decision: str, chunk_days: int = 365) -> DataFrame:
    """For every decision and key, the version that was newest then; later revisions never leak back."""
    values = [c for c in versions.columns if c not in names(key)]
    met = asof_join(_grid(versions, decisions, key, decision), versions, decision, observed, key, values, chunk_days=chunk_days)
    return met.filter(F.col(observed).isNotNull())


def known_state(versions: DataFrame, decisions: DataFrame, key, period: str, observed: str, decision: str, value: str, chunk_days: int = 365) -> DataFrame:
    """Per decision and key what was known of all its periods (see ``known_sweep``): nothing grows with decision times period."""
    swept = known_sweep(versions, key, period, observed, value, chunk_days)
    met = asof_join(_grid(versions, decisions, key, decision), swept, decision, observed, key, ["newest", "known", "total"], chunk_days=chunk_days)
    return met.filter("newest is not null")
