"""A store in one folder: log, runs, manifest and sketches, behind put, delete, get, scan and compact.

    store = Store(spark, "/data/users")
    store.put(df)                       # df(key, value)
    store.get("42").show()
    store.page(store.range("10", "20"), 1, 100).show()
    store.flush()                       # log -> run on level 0, then compaction where levels are overfull

Every write is a new file; a manifest version commits it.  What a crash leaves uncommitted is not
read, and a log batch that was flushed but not yet removed is merged again without effect.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from versionlog.config import Config
from versionlog.functions.hashing import record_crc
from versionlog.operators import catalog, integrity, merge, scan, sketches
from versionlog.operators.compaction import capacity
from versionlog.schema import RECORD, RESERVED, changelog
from versionlog.sources import runs


class RateLimited(Exception):
    """The bucket is empty; a pause of the reset interval fills it."""


class TokenBucket:
    """Full again after a pause of ``interval`` seconds; a request that is turned away ends a pause too."""

    def __init__(self, tokens: int, interval: int, clock: Callable[[], float] = time.time):
        self.tokens, self.interval, self.clock = tokens, interval, clock
        self.left, self.last = tokens, int(clock())

    def take(self) -> None:
        now = int(self.clock())
        if now - self.last >= self.interval:
            self.left = self.tokens
        self.last = now
        if self.left <= 0:
            raise RateLimited
        self.left -= 1


class Store:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.config, self.clock = spark, root.rstrip("/"), config or Config(), clock
        self.bucket = TokenBucket(self.config.number_of_tokens, self.config.token_reset_interval, clock)

    # Files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        """Complete tables in a folder."""
        fs, p = self._path(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(hadoop(s.getPath(), "_SUCCESS"))) if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    # Writes

    def _append(self, records: DataFrame) -> None:
        number = int((self._names("log") or ["0"])[-1]) + 1
        records.withColumn("crc", record_crc(F.col("key"), F.col("value"))).write.parquet(f"{self.root}/log/{number:012d}")

    def _stamped(self, df: DataFrame, value, tombstone: bool) -> DataFrame:
        now = F.lit(int(self.clock() * 1_000_000))
        return changelog(df, F.col("key"), value, now, F.monotonically_increasing_id(), F.lit(tombstone))

    @staticmethod
    def _own(keys: DataFrame) -> None:
        if not keys.filter(F.col("key").rlike("^(" + "|".join(RESERVED) + ")")).isEmpty():
            raise ValueError("reserved key")

    def put(self, df: DataFrame) -> None:
        """Puts ``df(key, value)``; a reserved key fails the call.  One request, whatever the rows."""
        self.bucket.take()
        self._own(df)
        self._append(self._stamped(df, F.col("value"), False))

    def delete(self, df: DataFrame) -> None:
        """Deletes the keys of ``df(key)``; a reserved key fails the call."""
        self.bucket.take()
        self._own(df)
        self._append(self._stamped(df, F.lit(""), True))

    # Reads

    def levels(self) -> list[list[str]]:
        return runs.load_manifest(self.spark, self.root, self.config.lsm_tree_max_depth)

    def log(self) -> DataFrame:
        """Records that were not flushed; those with a wrong checksum are passed over."""
        names = self._names("log")
        if not names:
            return self.spark.createDataFrame([], RECORD)
        rows = self.spark.read.parquet(*[f"{self.root}/log/{n}" for n in names])
        return rows.filter(record_crc(F.col("key"), F.col("value")) == F.col("crc")).select(*RECORD.names)

    def records(self) -> DataFrame:
        """All versions in the log and in all runs."""
        every = [r for level in self.levels() for r in level]
        return self.log().unionByName(runs.read_runs(self.spark, self.root, every))

    def get(self, key: str) -> DataFrame:
        self.bucket.take()
        if key.startswith(RESERVED):
            raise ValueError("reserved key")
        return scan.get(self.records(), key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        self.bucket.take()
        return scan.multi_get(self.records(), keys)

    def range(self, low: str, high: str) -> DataFrame:
        return scan.range_scan(self.records(), low, high)

    def prefix(self, prefix: str) -> DataFrame:
        return scan.prefix_scan(self.records(), prefix)

    page = staticmethod(scan.page)

    def iterate(self, records: DataFrame) -> Iterator[Row]:
        return scan.iterate(records)

    # Runs and levels

    def _write(self, records: DataFrame) -> str:
        run = runs.write_run(records, self.root)
        self._leaves(run).write.parquet(f"{self.root}/merkle/{run}")
        return run

    def _leaves(self, run: str) -> DataFrame:
        """Leaves in (ts, seq) order; a stored run's own order does not matter to them."""
        return integrity.merkle_leaves(runs.read_runs(self.spark, self.root, [run]))

    def flush(self) -> None:
        """The log as a run on level 0; then levels that hold more runs than they may are compacted."""
        names = self._names("log")
        if names:
            levels = self.levels()
            levels[0].append(self._write(self.log()))
            runs.save_manifest(self.spark, self.root, levels)
            for n in names:
                self._remove(f"log/{n}")
        self.compact()

    def compact(self) -> None:
        c, at = self.config, 0
        leveled = c.lsm_compaction_type == "leveled"
        levels = self.levels()
        while at < len(levels) - 1:
            most = self.spark.range(1).select(capacity(F.lit(at), c.lsm_first_level_size, c.lsm_growth_factor, leveled)).first()[0]
            if len(levels[at]) <= most:
                at += 1
                continue
            above = levels[at][:1] if leveled else levels[at]
            below = self._overlapping(above[0], levels[at + 1]) if leveled else []
            merged = merge.latest(runs.read_runs(self.spark, self.root, above + below))
            if at + 1 == len(levels) - 1 and (leveled or not levels[at + 1]):
                merged = merged.filter(~F.col("tombstone"))
            new = [] if merged.isEmpty() else [self._write(merged)]
            levels[at] = [r for r in levels[at] if r not in above]
            levels[at + 1] = [r for r in levels[at + 1] if r not in below] + new
            runs.save_manifest(self.spark, self.root, levels)
            for r in above + below:
                runs.delete_run(self.spark, self.root, r)
                self._remove(f"merkle/{r}")
            at = 0

    def _overlapping(self, run: str, others: list[str]) -> list[str]:
        def span(r: str) -> Row:
            return runs.read_runs(self.spark, self.root, [r]).agg(F.min("key"), F.max("key")).first()

        low, high = span(run)
        return [r for r in others if (s := span(r))[0] <= high and s[1] >= low]

    def validate(self, run: str) -> DataFrame:
        """``(idx, change)`` of the run's records that differ from what was written."""
        return integrity.merkle_diff(self.spark.read.parquet(f"{self.root}/merkle/{run}"), self._leaves(run))

    # Sketches

    def save_sketch(self, kind: str, name: str, cells: DataFrame) -> None:
        """Adds ``cells(row, col, n)`` to the sketch, creating it if need be."""
        self.bucket.take()
        key, old = f"{kind}_{name}", self._names(f"sketches/{kind}_{name}")
        new = catalog.create(kind, name, cells)
        if old:
            held = self.spark.read.parquet(f"{self.root}/sketches/{key}/{old[-1]}")
            new = catalog.insert(held, kind, name, cells)
        number = int((old or ["0"])[-1]) + 1
        new.write.parquet(f"{self.root}/sketches/{key}/{number:012d}")
        for o in old:
            self._remove(f"sketches/{key}/{o}")

    def sketch(self, kind: str, name: str) -> DataFrame:
        self.bucket.take()
        old = self._names(f"sketches/{kind}_{name}")
        if not old:
            return self.spark.createDataFrame([], "row long, col long, n long")
        return self.spark.read.parquet(f"{self.root}/sketches/{kind}_{name}/{old[-1]}").drop("sketch")

    def delete_sketch(self, kind: str, name: str) -> None:
        self.bucket.take()
        self._remove(f"sketches/{kind}_{name}")

    def list_sketches(self, kind: str) -> list[str]:
        fs, p = self._path("sketches")
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(kind)) if fs.exists(p) else []

    def add_to_bloom(self, name: str, df: DataFrame, key: str, n: int, p: float) -> None:
        m, k = sketches.bloom_size(n, p)
        bits = sketches.bloom_build(df, key, m, k)
        self.save_sketch("bloomFilter", name, bits.select(F.lit(0).alias("row"), F.col("bit").alias("col"), F.lit(1).alias("n")))

    def add_to_count_min(self, name: str, df: DataFrame, key: str, epsilon: float, delta: float) -> None:
        self.save_sketch("countMinSketch", name, sketches.cms_build(df, key, *sketches.cms_size(epsilon, delta)))

    def add_to_hll(self, name: str, df: DataFrame, key: str, p: int) -> None:
        registers = sketches.hll_build(df, key, p)
        self.save_sketch("hyperLogLog", name, registers.select(F.lit(0).alias("row"), F.col("bucket").alias("col"), F.col("rank").alias("n")))
