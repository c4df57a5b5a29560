"""Helpers shared by the operators: written tables, row bounds, SQL-side `let`."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Fixed value: the white space that separates words (space, tab, line feed, vertical tab, form feed, carriage return).
SPACE = r"[\x20\x09-\x0D]+"
#: Fixed value: the letters that ASCII lower-casing changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed table. On a local master the workers are told where this package lies, wherever they were started; a
    cluster has it installed or shipped."""
    context = spark.sparkContext
    if context.master.startswith("local["):
        context.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The frame as a written table: later reads do not recompute it when an executor is lost. ``codec``: another
    compression than the session's."""
    path = fresh_folder(frame.sparkSession, name)
    frame.write.parquet(path, compression=codec)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it under a name inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def no_null(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
