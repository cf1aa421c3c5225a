"""Sorted runs as Parquet, and the manifest that says which runs make up which level.

A run is written once under a new id and never renamed.  A manifest version is one small JSON file;
readers take the last version, so a run that no version names is as if it were not there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.operators.merge import latest
from versionlog.schema import RECORD


def write_run(records: DataFrame, root: str, files: int | None = None) -> str:
    """Writes the latest record of each key as a new run sorted by key; returns the run's id.

    Ranges of keys go to files, sorted, with a bloom filter on the key: file and row-group bounds and
    the filter are what point and range reads are pruned by.
    """
    run = uuid.uuid4().hex
    merged = latest(records)
    ranged = merged.repartitionByRange(files, "key") if files else merged.repartitionByRange("key")
    (ranged.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", "0.001").parquet(f"{root}/runs/{run}"))
    return run


def read_runs(spark: SparkSession, root: str, runs: list[str]) -> DataFrame:
    """Records of the runs; predicates on ``key`` reach the scan."""
    return spark.read.schema(RECORD).parquet(*[f"{root}/runs/{r}" for r in runs]) if runs else spark.createDataFrame([], RECORD)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_runs(spark: SparkSession, root: str) -> list[str]:
    """Ids of all complete runs on disk."""
    fs, p = _fs(spark, f"{root}/runs")
    if not fs.exists(p):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(hadoop(s.getPath(), "_SUCCESS")))


def delete_run(spark: SparkSession, root: str, run: str) -> None:
    """Removes a run's files; take it out of the manifest first."""
    fs, p = _fs(spark, f"{root}/runs/{run}")
    fs.delete(p, True)


def save_manifest(spark: SparkSession, root: str, levels: list[list[str]]) -> int:
    """Commits a new version of the levels; returns its number.  Creating an existing version fails."""
    version = (last_version(spark, root) or 0) + 1
    fs, p = _fs(spark, f"{root}/manifest/{version:08d}.json")
    out = fs.create(p, False)
    out.write(bytearray(json.dumps([x or None for x in levels]).encode()))
    out.close()
    return version


def last_version(spark: SparkSession, root: str) -> int | None:
    fs, p = _fs(spark, f"{root}/manifest")
    if not fs.exists(p):
        return None
    return max((int(s.getPath().getName()[:8]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=None)


def load_manifest(spark: SparkSession, root: str, depth: int = 7) -> list[list[str]]:
    """The levels of the last version; with no manifest all runs are on level 0."""
    version = last_version(spark, root)
    if version is None:
        return [list_runs(spark, root)] + [[] for _ in range(depth - 1)]
    text = spark.read.option("wholetext", True).text(f"{root}/manifest/{version:08d}.json").first()[0]
    return [x or [] for x in json.loads(text)]


def parse_manifest(text: DataFrame, col: str = "value") -> DataFrame:
    """``(level, pos, run)`` of manifests in JSON; null levels have no rows."""
    levels = text.select(F.posexplode(F.from_json(col, "array<array<string>>")).alias("level", "runs"))
    return levels.select("level", F.posexplode("runs").alias("pos", "run"))
