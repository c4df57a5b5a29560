"""Files: bars, monthly tables, landed JSON, XML and CSV, with explicit schemas (inference reads 2026.06 as a number)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frames import pick_first

BARS = "date date, open double, high double, low double, close double, adj_close double, volume double, instrument string, adjustment string"


def snake(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def clean_bars(raw: DataFrame, order: str = "row_no") -> DataFrame:
    """Unadjusted rows only, one per (instrument, session): the last in load order."""
    f = snake(raw).filter(F.coalesce(F.col("adjustment"), F.lit("unadjusted")) == "unadjusted")
    f = f.withColumn("session", F.col("date").cast("date"))
    return pick_first(f, ["instrument", "session"], [F.col(order).desc(), F.col("close")]).drop("date", "adjustment", order)


def monthly_close(bars: DataFrame, complete_before) -> DataFrame:
    """Last positive close of each month that ended before a date."""
    f = bars.filter("close > 0").groupBy("instrument", F.trunc("session", "MM").alias("month")).agg(F.max_by("close", "session").alias("value"))
    return f.filter(F.last_day("month") < complete_before)


def missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is there, and not for any other reason."""
    return error.getCondition() == "PATH_NOT_FOUND"


def read_bars(spark: SparkSession, folder: str) -> DataFrame:
    """OHLCV snapshots: Parquet where present, else CSV."""
    try:
        return spark.read.schema(BARS).parquet(f"{folder}/*.parquet")
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return spark.read.schema(BARS).option("header", True).csv(f"{folder}/*.csv")


def read_xml_items(spark: SparkSession, path: str, fields, row_tag: str = "item") -> DataFrame:
    """XML elements as text columns."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, payload), for one JSON document per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def read_stat_csv(spark: SparkSession, path: str) -> DataFrame:
    cols = T.StructType([T.StructField(c, T.StringType()) for c in ("REF_AREA", "TIME_PERIOD", "OBS_VALUE")])
    return spark.read.option("header", True).schema(cols).csv(path)


def source_priority(candidates: list[tuple[str, DataFrame]], key) -> DataFrame:
    """Rows of the first source that has each key; the chosen source stays as a column."""
    out = None
    for rank, (name, df) in enumerate(candidates):
        part = df.withColumn("source", F.lit(name)).withColumn("_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in key and c != "_rank"]
    return out.groupBy(*key).agg(F.min_by(F.struct(*rest), "_rank").alias("r")).select(*key, "r.*")


def load_series(load, fallback: DataFrame, key) -> DataFrame:
    """Fresh rows from a caller's loader first, the archive for keys it lacks; the archive alone where the loader finds
    no file or reaches no host. Any other failure of the loader is raised."""
    try:
        fresh = load()
    except (FileNotFoundError, ConnectionError):
        return source_priority([("archive", fallback)], key)
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return source_priority([("archive", fallback)], key)
    return source_priority([("fresh", fresh), ("archive", fallback)], key)
