"""Two-pass external shuffle of records into shards of equal row counts, without user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_folder

BUCKET_BYTES = 16 << 20
#: The manifest is broadcast up to so many buckets, and joined beyond.
MAX_BROADCAST_BUCKETS = 100_000


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffled_shards(records: DataFrame, shards: int = 8, text: str = "text", seed: int = 42,
                    bucket_bytes: int = BUCKET_BYTES, folder: str | None = None) -> DataFrame:
    """Shuffle all records and deal them to ``shards`` shards whose row counts differ by one at most.

    First pass: a seeded hash of a record's place in the input scatters the records evenly over
    ``total size / bucket_bytes`` buckets, so no key, text or null can make a bucket hot. Second pass: each bucket,
    which fits in a task's memory, is put in input order, permuted by Spark's ``shuffle`` (a Fisher-Yates shuffle with
    a seed) and written under ``folder``. The buckets then follow one another; shard s holds the places
    ``ceil(s N / shards)`` up to the next shard's, so a shard is a run of whole buckets but for its two ends.

    Returns the columns ``record`` (a struct of all input columns, whatever their names), ``shard`` int and ``slot`` long
    (gapless from 0 in each shard), read back from the written buckets. Nulls in any column are records like others;
    repeated rows stay repeated; an empty table gives no rows and empty shards. The order depends on the seed and on
    the input's layout; the written buckets fix it.
    """
    spark = records.sparkSession
    folder = folder or fresh_folder(spark, "shards")
    total = records.agg(F.sum(record_size(text))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    placed = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"),
                            F.monotonically_increasing_id().alias("place"))
    scattered = placed.select(F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(buckets)).alias("bucket"),
                              F.struct("place", "record").alias("entry"))
    gathered = (scattered.repartition(int(buckets), "bucket").groupBy("bucket")
                .agg(F.sort_array(F.collect_list("entry")).alias("entries")))
    permuted = gathered.select("bucket", F.shuffle("entries", F.lit(seed)).alias("entries"))
    (permuted.select("bucket", F.posexplode("entries").alias("at", "entry"))
     .select("bucket", "at", "entry.record").write.parquet(folder))
    return read_shards(spark, folder, shards)


def read_shards(spark: SparkSession, folder: str, shards: int = 8) -> DataFrame:
    """The written buckets with their shard and slot; the manifest has one row a bucket."""
    rows = spark.read.parquet(folder)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    manifest = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                             F.sum("n").over(everything).alias("total"))
    if (rows.agg(F.max("bucket")).first()[0] or 0) < MAX_BROADCAST_BUCKETS:
        manifest = F.broadcast(manifest)  # so many rows of three numbers at most
    placed = rows.join(manifest, "bucket").withColumn("place", F.col("start") + F.col("at"))
    shard = F.expr(f"cast(place * {shards} div total as int)")
    return (placed.withColumn("shard", shard)
            .select("record", "shard", F.expr(f"place - (shard * total + {shards - 1}) div {shards}").alias("slot")))
