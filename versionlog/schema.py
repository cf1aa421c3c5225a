"""The changelog: one row per put or delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Value of a tombstone is empty.  ``seq`` orders records of equal ``ts``.
RECORD = T.StructType([
    T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False), T.StructField("ts", T.LongType(), False),
    T.StructField("seq", T.LongType(), False), T.StructField("tombstone", T.BooleanType(), False)])

#: Kinds of stored sketches and state; keys that begin so are not the user's.
RESERVED = ("bloomFilter", "countMinSketch", "hyperLogLog", "simhash", "tokenBucket")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def changelog(df: DataFrame, key: Column, value: Column, ts: Column, seq: Column, tombstone: Column) -> DataFrame:
    """``df`` as put and delete records; a delete has an empty value."""
    dead = F.coalesce(tombstone, F.lit(False))
    return df.select(
        key.cast("string").alias("key"), F.when(dead, F.lit("")).otherwise(F.coalesce(value.cast("string"), F.lit(""))).alias("value"),
        ts.cast("long").alias("ts"), seq.cast("long").alias("seq"), dead.alias("tombstone"))


def puts(df: DataFrame, key: Column, value: Column, ts: Column, seq: Column) -> DataFrame:
    return changelog(df, key, value, ts, seq, F.lit(False))


def deletes(df: DataFrame, key: Column, ts: Column, seq: Column) -> DataFrame:
    return changelog(df, key, F.lit(""), ts, seq, F.lit(True))


def unreserved(df: DataFrame, key: str = "key") -> DataFrame:
    """Records whose keys are the user's own."""
    return df.filter(~F.col(key).rlike("^(" + "|".join(RESERVED) + ")"))
