"""The key dictionary as a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save(ids: DataFrame, path: str) -> None:
    ids.select("key", "id").write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, id long").parquet(path)
