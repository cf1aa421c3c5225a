"""Named sketches, kept in long form by kind and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versionlog.operators.scan import prefix_scan
from versionlog.schema import RESERVED

#: How the cells of each kind combine when elements are added.
COMBINE = {"bloomFilter": lambda c: F.max(c), "countMinSketch": lambda c: F.sum(c), "hyperLogLog": lambda c: F.max(c), "simhash": lambda c: F.max(c)}


def sketch_key(kind: str, name: Column) -> Column:
    if kind not in RESERVED:
        raise ValueError(f"unknown kind: {kind}")
    return F.concat_ws("_", F.lit(kind), name)


def create(kind: str, name: str, cells: DataFrame) -> DataFrame:
    """``(sketch, row, col, n)`` rows of a new sketch from ``cells(row, col, n)``."""
    return cells.select(sketch_key(kind, F.lit(name)).alias("sketch"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("n").cast("long"))


def insert(catalog: DataFrame, kind: str, name: str, cells: DataFrame) -> DataFrame:
    """The catalog after ``cells`` were merged into the sketch; others are unchanged."""
    key = f"{kind}_{name}"
    old = catalog.filter(F.col("sketch") == key).unionByName(create(kind, name, cells))
    merged = old.groupBy("sketch", "row", "col").agg(COMBINE[kind]("n").alias("n"))
    return catalog.filter(F.col("sketch") != key).unionByName(merged)


def delete(catalog: DataFrame, kind: str, name: str) -> DataFrame:
    return catalog.filter(F.col("sketch") != f"{kind}_{name}")


def cells_of(catalog: DataFrame, kind: str, name: str) -> DataFrame:
    return catalog.filter(F.col("sketch") == f"{kind}_{name}").drop("sketch")


def list_sketches(log: DataFrame, kind: str) -> DataFrame:
    """Live keys of the kind in a changelog."""
    return prefix_scan(log, kind).select("key")
