"""The store end to end: writes, reads, flushes, both compactions, checks, sketches, rate limit."""

import pytest
from pyspark.sql import functions as F

from versionlog.config import Config
from versionlog.operators import sketches
from versionlog.sources import runs
from versionlog.store import RateLimited, Store


class Clock:
    now = 1000.0

    def __call__(self):
        self.now += 0.5
        return self.now


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


@pytest.mark.parametrize("kind", ["sizetiered", "leveled"])
def test_reads_agree_with_a_dict_through_flushes(spark, tmp_path, kind):
    s, want = Store(spark, str(tmp_path), Config(lsm_first_level_size=1, lsm_growth_factor=1, lsm_tree_max_depth=3, lsm_compaction_type=kind), Clock()), {}
    for step in range(5):
        new = {f"k{i:02d}": f"v{step}-{i}" for i in range(step * 3, step * 3 + 8)}
        s.put(rows(spark, list(new.items())))
        want |= new
        s.delete(keys(spark, f"k{step * 3:02d}"))
        want.pop(f"k{step * 3:02d}")
        if step % 2 == 0:
            s.flush()
        assert {r["key"]: r["value"] for r in s.range("", "z").collect()} == want
    assert s.get("k00").count() == 0 and s.get("k19").first()["value"] == want["k19"]
    assert [r["key"] for r in s.page(s.prefix("k"), 2, 3).collect()] == sorted(want)[3:6]
    assert [r["key"] for r in s.iterate(s.range("k05", "k09"))] == [k for k in sorted(want) if "k05" <= k <= "k09"]
    assert {r["key"] for r in s.multi_get(keys(spark, "k19", "nope")).collect()} == {"k19"}
    s.flush()
    assert s.log().count() == 0 and any(s.levels()[1:])
    again = Store(spark, str(tmp_path), s.config, Clock())
    assert {r["key"]: r["value"] for r in again.range("", "z").collect()} == want


def test_reserved_keys_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).put(rows(spark, [("simhash_x", "1")]))


def test_a_changed_run_is_found(spark, tmp_path):
    s = Store(spark, str(tmp_path), clock=Clock())
    s.put(rows(spark, [("a", "1"), ("b", "2"), ("c", "3")]))
    s.flush()
    (run,) = s.levels()[0]
    assert s.validate(run).count() == 0
    changed = runs.read_runs(spark, str(tmp_path), [run]).withColumn("value", F.when(F.col("key") == "b", "x").otherwise(F.col("value")))
    rows_ = changed.collect()
    spark.createDataFrame(rows_, changed.schema).write.mode("overwrite").parquet(f"{tmp_path}/runs/{run}")
    assert [r["change"] for r in s.validate(run).collect()] == ["changed"]


def test_sketches(spark, tmp_path):
    s = Store(spark, str(tmp_path), clock=Clock())
    for part in ("abc", "cde"):
        s.add_to_count_min("letters", keys(spark, *part), "key", 0.01, 0.01)
    m, k = sketches.cms_size(0.01, 0.01)
    got = sketches.cms_estimate(s.sketch("countMinSketch", "letters"), keys(spark, *"acz"), "key", m, k)
    assert {r["key"]: r["estimate"] for r in got.collect()} == {"a": 1, "c": 2, "z": 0}
    s.add_to_hll("users", keys(spark, *"abcdefgh"), "key", 6)
    s.add_to_bloom("seen", keys(spark, *"xyz"), "key", 10, 0.01)
    assert s.list_sketches("bloomFilter") == ["bloomFilter_seen"] and s.sketch("hyperLogLog", "users").count() > 0
    s.delete_sketch("bloomFilter", "seen")
    assert s.list_sketches("bloomFilter") == [] and s.sketch("bloomFilter", "seen").count() == 0


def test_rate_limit(spark, tmp_path):
    clock = Clock()
    s = Store(spark, str(tmp_path), Config(number_of_tokens=2, token_reset_interval=10), clock)
    s.put(rows(spark, [("a", "1")]))
    s.get("a")
    with pytest.raises(RateLimited):
        s.get("a")
    assert s.range("a", "b").count() == 1
    clock.now += 11
    assert s.get("a").count() == 1


def test_reserved_keys_fail_every_call(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    with pytest.raises(ValueError):
        s.get("bloomFilter_x")
    with pytest.raises(ValueError):
        s.delete(spark.createDataFrame([("simhash_x",)], "key string"))
