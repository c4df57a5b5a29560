"""Writing marts: content hash of inputs, append-only ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import append_first


def snapshot_hash(df: DataFrame) -> DataFrame:
    """Order-free content hash: row hashes folded by xor and sum, with the row count."""
    h = F.xxhash64(*sorted(df.columns))
    g = df.agg(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1000003))).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("n", F.sha2(F.concat_ws("|", F.col("x").cast("string"), F.col("s").cast("string"), F.col("n").cast("string")), 256).alias("snapshot"))


def content_id(df: DataFrame, out: str = "record_id") -> DataFrame:
    """Missing ids get a hash of the row's content."""
    rest = [c for c in sorted(df.columns) if c != out]
    made = F.left(F.sha2(F.to_json(F.struct(*rest)), 256), F.lit(24))
    return df.withColumn(out, F.coalesce(F.col(out), made) if out in df.columns else made)


def append_ledger(new: DataFrame, path: str, existing: DataFrame, month: str = "target_month", key: str = "record_id") -> None:
    """Append the rows whose id is not in the ledger yet, one folder per target month."""
    append_first(existing, new, key).write.mode("append").partitionBy(month).parquet(path)
