"""Sinks that survive a restarted batch: every micro-batch owns one partition, named by its id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import quotes as Q
from ..operators import settle as T
from ..operators.sets import archive_versions


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def read_mart(spark: SparkSession, path: str, schema) -> DataFrame:
    """The mart so far; empty with the right columns before the first batch."""
    if _exists(spark, path):
        return spark.read.parquet(path).drop("batch")
    return spark.createDataFrame([], schema)


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Replace the partition of this batch, so a repeated batch leaves the mart as it was."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def earlier(spark: SparkSession, path: str, schema, batch: int) -> DataFrame:
    """Rows written by batches before this one (a repeated batch must not see its own output)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).filter(F.col("batch") < batch).drop("batch")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run everything available through ``each`` and stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals_sink(path: str):
    """Counts per page of each batch; the running total is the sum over batches."""
    def each(rows: DataFrame, batch: int) -> None:
        write_batch(rows.groupBy("page").agg(F.count(F.lit(1)).alias("n")), path, batch)
    return each


def running_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("page").agg(F.sum("n").alias("total"))


def append_sink(path: str, key: str = "record_id"):
    """Append rows whose key no earlier batch wrote."""
    def each(rows: DataFrame, batch: int) -> None:
        known = earlier(rows.sparkSession, path, rows.schema, batch)
        write_batch(rows.dropDuplicates([key]).join(known.select(key), key, "left_anti"), path, batch)
    return each


def versions_sink(path: str, key, observed: str, values):
    """Late or corrected observations become new versions; nothing is overwritten."""
    key = [key] if isinstance(key, str) else list(key)

    def each(rows: DataFrame, batch: int) -> None:
        known = earlier(rows.sparkSession, path, rows.schema, batch)
        touched = known.join(rows.select(*key).distinct(), key, "left_semi")
        newest = touched.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), observed).alias("r")).select("r.*")
        both = newest.unionByName(rows.dropDuplicates([*key, observed]))
        fresh = archive_versions(both, key, observed, values).select(*rows.columns)
        write_batch(fresh.join(known.select(*key, observed), [*key, observed], "left_anti"), path, batch)
    return each


def scores_sink(path: str, ledger: DataFrame, bars: Callable[[], DataFrame], now: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """Grade all forecasts of the instruments in a batch whose target session has come and that have no grade yet.

    A forecast that cannot be graded now, because its deadline or its reference bar is still to come, stays due and is
    looked at again with every later batch of its instrument, by the clock of that batch. Grades are never undone.
    """
    def each(arrived: DataFrame, batch: int) -> None:
        landed, at = bars(), now()
        newest = landed.join(arrived.select("instrument").distinct(), "instrument", "left_semi").groupBy("instrument").agg(F.max("session").alias("_newest"))
        due = ledger.join(newest, "instrument").filter(F.col("target_date") <= F.col("_newest")).drop("_newest")
        if _exists(arrived.sparkSession, path):
            graded = arrived.sparkSession.read.parquet(path).filter(F.col("batch") < batch).select("record_id")
            due = due.join(graded, "record_id", "left_anti")
        write_batch(L.score_forecasts(due, landed, at).filter("status = 'scored'"), path, batch)
    return each


def observations_sink(path: str, key) -> Callable[[DataFrame, int], None]:
    """Observations of actual values as a versioned mart: a batch owns its partition, nothing is overwritten or merged."""
    key = [key] if isinstance(key, str) else list(key)

    def each(rows: DataFrame, batch: int) -> None:
        write_batch(rows.select(*key, "observed_at", "kind", "value").distinct(), path, batch)
    return each


def settled_forecasts(spark: SparkSession, path: str, forecasts: DataFrame, key, point: str = "point", by_time=None) -> DataFrame:
    """Forecasts against all batches of the mart; batches that came twice or in another order give the same rows."""
    return T.settled(forecasts, spark.read.parquet(path).drop("batch"), key, point, by_time)


def quotes_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Per batch and quote the earliest arrival and the range of its values: what can be merged in any order."""
    def each(rows: DataFrame, batch: int) -> None:
        write_batch(Q.partial_quotes(rows), path, batch)
    return each


def intake(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The first value of every quote over all batches, and beside it the quotes that a later arrival contradicted."""
    merged = Q.merged_quotes(spark.read.parquet(path).drop("batch"))
    return merged.drop("low", "high"), merged.filter("conflict").select("instrument", "ts", "source", "price", "low", "high")
