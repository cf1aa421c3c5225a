"""The write-ahead log: segments by bytes, replay from a watermark, truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versionlog.functions.encoding import log_length
from versionlog.functions.hashing import record_crc
from versionlog.operators.merge import latest
from versionlog.operators.numbering import numbered
from versionlog.schema import RECORD


def append(records: DataFrame, path: str) -> None:
    """Appends records with their checksum."""
    records.withColumn("crc", record_crc(F.col("key"), F.col("value"))).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All log records whose checksum holds; others are left to ``integrity.corrupt``."""
    rows = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("crc", T.LongType())])).parquet(path)
    return rows.filter(record_crc(F.col("key"), F.col("value")) == F.col("crc")).drop("crc")


def segments(log: DataFrame, segment_bytes: int, hour: int = 3_600_000_000) -> DataFrame:
    """``log`` with ``start``, the record's byte offset in the log, and the segments it begins and ends in."""
    size = log_length(F.col("key"), F.col("value"))
    placed = numbered(log, F.floor(F.col("ts") / hour), ["ts", "seq"], size=size, name="n").drop("n")
    return placed.withColumn("segment", F.floor(F.col("start") / segment_bytes).cast("long")).withColumn("last_segment", F.floor((F.col("start") + size - 1) / segment_bytes).cast("long"))


def replay(log: DataFrame, watermark: int, segment_bytes: int) -> DataFrame:
    """Latest records of what begins at byte ``watermark`` or later; applying it twice changes nothing."""
    return latest(segments(log, segment_bytes).filter(F.col("start") >= watermark))


def truncate(log: DataFrame, watermark: int, segment_bytes: int) -> DataFrame:
    """What is left when whole segments before the watermark's are removed."""
    placed = segments(log, segment_bytes)
    return placed.filter(F.col("last_segment") >= watermark // segment_bytes).select(*log.columns)
