"""Exact ranks and quantiles of large groups without sorting a group in one task.

Values are first folded into a histogram (map-side combine), the histogram is cut into
ranges by approximate quantiles, and only the per-range totals (a few hundred rows per
group) are accumulated in one window. The result is exact; the approximate cut points only
decide how the work is spread. They depend on the order in which partial results arrive, so
the histogram is written once with its ranges: both of its readers see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .frames import names

RANGES = 128


def value_ranks(df: DataFrame, by, value: str, extra: dict | None = None, ranges: int = RANGES) -> DataFrame:
    """One row per (by, value): ``cnt``, ``below`` (rows strictly smaller), ``total``, ``avg_rank`` (ties share).

    ``extra`` adds aggregates to the histogram, so that a caller needs no second pass over the rows.
    """
    by = names(by)
    more = [c.alias(k) for k, c in (extra or {}).items()]
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("cnt"), *more)
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = hist.groupBy(*by).agg(
        F.percentile_approx(value, cuts, 1000).alias("_edges"), F.sum("cnt").alias("total"))
    cut = cut_lineage(hist.join(edges, by).withColumn(
        "_r", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges"))
    per_range = cut.groupBy(*by, "_r").agg(F.sum("cnt").alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_range.withColumn("_before", before).drop("_n")
    inside = F.coalesce(F.sum("cnt").over(
        Window.partitionBy(*by, "_r").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        cut.withColumn("_inside", inside).join(offsets, [*by, "_r"])
        .withColumn("below", F.col("_before") + F.col("_inside"))
        .withColumn("avg_rank", F.col("below") + (F.col("cnt") + 1) / 2.0)
        .select(*by, value, "cnt", "below", "total", "avg_rank", *(extra or {}))
    )


def quantiles(df: DataFrame, by, value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group."""
    by = names(by)
    table = value_ranks(df, by, value)
    exprs, outs = [], []
    for name, q in wanted.items():
        pos = F.lit(q) * (F.col("total") - 1)
        for part, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below") <= at) & (at < F.col("below") + F.col("cnt"))
            exprs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{part}"))
        frac = F.lit(q) * (F.col("_total") - 1) - F.floor(F.lit(q) * (F.col("_total") - 1))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * frac).alias(name))
    return table.groupBy(*by).agg(F.first("total").alias("_total"), *exprs).select(*by, *outs)


def auc(df: DataFrame, by, score: str, positive: str, least: int = 30) -> DataFrame:
    """Area under the curve by average ranks; missing under ``least`` rows or with one class only."""
    by = names(by)
    rows = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull())
    table = value_ranks(rows, by, score, {"_p": F.sum(F.col(positive).cast("int"))})
    total = table.groupBy(*by).agg(F.sum(F.col("avg_rank") * F.col("_p")).alias("_s"), F.sum("_p").alias("n_pos"), F.sum("cnt").alias("n"))
    n1, n0 = F.col("n_pos"), F.col("n") - F.col("n_pos")
    ok = (F.col("n") >= least) & (n1 > 0) & (n0 > 0)
    value = F.when(ok, (F.col("_s") - n1 * (n1 + 1) / 2.0) / F.when(ok, n1 * n0))
    return total.select(*by, "n", "n_pos", value.alias("auc"))
