"""Window helpers: full-window guards, neighbours, islands.

A series here is one row per (key, session or month), so a window partition is bounded by
the calendar (about 250 sessions a year), never by the tick volume behind the bars.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def series(by, order):
    """Ordered window of one series."""
    return Window.partitionBy(*names(by)).orderBy(*names(order))


def rows(by, order, lo: int | None, hi: int | None):
    """Row frame; None means unbounded on that side."""
    lo = Window.unboundedPreceding if lo is None else lo
    hi = Window.unboundedFollowing if hi is None else hi
    return series(by, order).rowsBetween(lo, hi)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def guarded(agg, x, frame, least: int) -> Column:
    """``agg`` over the frame, only once ``least`` values are present."""
    x = col(x)
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def rolling(agg, x, by, order, n: int, *, shift: int = 0, least: int | None = None) -> Column:
    """Trailing n-row statistic ending ``shift`` rows ago; missing until ``least`` (default n) values exist."""
    return guarded(agg, x, rows(by, order, -(n - 1) - shift, -shift), n if least is None else least)


def prev(x, by, order, k: int = 1) -> Column:
    return F.lag(col(x), k).over(series(by, order))


def nxt(x, by, order, k: int = 1) -> Column:
    return F.lead(col(x), k).over(series(by, order))


def ratio(a, b) -> Column:
    """a / b, missing when b is zero."""
    return F.try_divide(col(a), col(b))


def change(x, by, order, k: int = 1) -> Column:
    """x over its value k rows ago, minus one."""
    return ratio(col(x), prev(x, by, order, k)) - 1


def median(x) -> Column:
    return F.percentile(col(x), F.lit(0.5))


def finite(x) -> Column:
    """NaN and infinities become missing."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def add_streak(df, flag: str, by, order: str, out: str):
    """Length of the current run of equal ``flag`` values (gaps and islands)."""
    w = series(by, order)
    turned = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    island = F.sum("_turn").over(rows(by, order, None, 0))
    return (
        df.withColumn("_turn", turned)
        .withColumn("_island", island)
        .withColumn(out, F.row_number().over(Window.partitionBy(*names(by), "_island").orderBy(*names(order))))
        .drop("_turn", "_island")
    )


def pick_first(df, keys, order):
    """One row per key, the first in ``order`` (which must end in a unique column)."""
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def numbered(df, by, time: str, tie=(), out: str = "number", chunk_days: int = 365):
    """Row number per key without one task per key: numbers inside (key, chunk) plus the rows of earlier chunks."""
    by = names(by)
    f = df.withColumn("_c", F.floor(F.unix_date(F.col(time).cast("date")) / chunk_days))
    sizes = f.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_off", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_c").orderBy(time, *names(tie)))
    return f.withColumn("_in", inside).join(offsets, [*by, "_c"]).withColumn(out, F.col("_off") + F.col("_in")).drop("_c", "_off", "_in")
