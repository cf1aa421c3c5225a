"""Sketches, trees, buckets, caches, runs, levels and streams."""

import hashlib
import json
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from versionlog.config import Config
from versionlog.functions import encoding
from versionlog.operators import catalog, compaction, indexing, integrity, merge, numbering, ratelimit, simhash, sketches
from versionlog.operators.cache import lru_hits
from versionlog.schema import RECORD
from versionlog.sources import dictionary, runs
from versionlog.sources import log as wal
from versionlog.streaming import flush
from versionlog.streaming import ratelimit as stream_ratelimit


def records(spark, n, keys=20, start=0):
    return spark.createDataFrame([(str(i % keys), f"v{i}", i, i, i % 13 == 0) for i in range(start, start + n)], RECORD)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"memtable_size": 7, "LSMFirstLevelSize": 4, "unknown": 1}))
    c = Config.load(tmp_path / "c.json")
    assert (c.memtable_size, c.lsm_first_level_size, c.index_degree) == (7, 4, 5)


def test_bloom_has_no_false_negatives_and_merges(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("key"))
    m, k = sketches.bloom_size(300, 0.01)
    a, b = (sketches.bloom_build(df.filter(F.col("key").cast("int") % 2 == r), "key", m, k) for r in (0, 1))
    bits = sketches.bloom_merge(a, b)
    assert sketches.bloom_probe(bits, df, "key", m, k).filter(~F.col("found")).count() == 0
    other = spark.range(1000, 3000).select(F.col("id").cast("string").alias("key"))
    assert sketches.bloom_probe(bits, other, "key", m, k).filter("found").count() < 80
    assert sketches.bloom_probe(bits.limit(0), df, "key", m, k).filter("found").count() == 0


def test_count_min_never_underestimates(spark):
    df = spark.range(2000).select((F.col("id") % (F.col("id") % 17 + 1)).cast("string").alias("key"))
    m, k = sketches.cms_size(0.05, 0.1)
    got = sketches.cms_estimate(sketches.cms_build(df, "key", m, k), df, "key", m, k).join(df.groupBy("key").count(), "key")
    assert got.filter(F.col("estimate") < F.col("count")).count() == 0
    absent = spark.createDataFrame([("nothing",)], "key string")
    assert sketches.cms_estimate(sketches.cms_build(df.limit(0), "key", m, k), absent, "key", m, k).first()["estimate"] == 0


def test_hll_of_nothing_and_of_long_keys(spark):
    empty = spark.createDataFrame([], "key string")
    assert sketches.hll_estimate(sketches.hll_build(empty, "key", 8), 8).first()[0] == 0
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("key"))
    assert abs(sketches.hll_estimate(sketches.hll_build(df, "key", 10), 10).first()[0] / 3000 - 1) < 0.15


def test_sketch_catalog(spark):
    cells = spark.createDataFrame([(0, 1, 2)], "row long, col long, n long")
    cat = catalog.insert(catalog.create("countMinSketch", "a", cells), "countMinSketch", "a", cells)
    cat = catalog.insert(cat, "bloomFilter", "b", cells)
    assert catalog.cells_of(cat, "countMinSketch", "a").first()["n"] == 4
    assert catalog.delete(cat, "bloomFilter", "b").count() == 1
    with pytest.raises(ValueError):
        catalog.create("other", "a", cells)


def test_simhash_edges_and_near_pairs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, None), (4, "a bc"), (5, "delta epsilon")], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in simhash.fingerprints(docs).collect()}
    assert f[1] == f[2] and f[3] == f[4] == 0
    prints = spark.createDataFrame([(1, 0), (2, 0b111), (3, -1), (4, (1 << 63) - 1), (5, 0)], "doc_id long, fingerprint long")
    assert sorted(map(tuple, simhash.near(prints).collect())) == [(1, 2, 3), (1, 5, 0), (3, 4, 1)]
    with pytest.raises(ValueError):
        simhash.near(prints, 4)


def tree(leaves):
    pad, level = hashlib.sha1(b"").digest(), list(leaves)
    first = True
    while len(level) > 1 or first:
        level = [hashlib.sha1(level[i] + (level[i + 1] if i + 1 < len(level) else pad)).digest() for i in range(0, len(level), 2)]
        first = False
    return level[0].hex()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 1023, 1024, 1025, 3000])
def test_merkle_root(spark, n):
    leaves = spark.range(n).select(F.col("id").alias("idx"), F.sha1(F.col("id").cast("string").cast("binary")).alias("hash"))
    want = tree(hashlib.sha1(str(i).encode()).digest() for i in range(n))
    assert integrity.merkle_root(leaves, n).first()["hash"] == want
    if n < 6:
        assert integrity.merkle_levels(leaves, n).orderBy(F.desc("level")).first()["hash"] == want


def test_merkle_diff_finds_what_changed(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "idx long, hash string")
    b = spark.createDataFrame([(0, "x"), (1, "Y"), (3, "w")], "idx long, hash string")
    assert sorted(map(tuple, integrity.merkle_diff(a, b).collect())) == [(1, "changed"), (2, "removed"), (3, "added")]


def bucket(rows, capacity, interval):
    last, left, out = None, capacity, []
    for t in rows:
        left = capacity if last is not None and t - last >= interval else left
        last = t
        out.append(left > 0)
        left -= left > 0
    return out


def test_token_bucket(spark, tmp_path):
    times = [0, 1, 2, 3, 10, 12, 13, 14, 14, 30, 37, 44]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, t long, seq long")
    want = bucket(times, 2, 7)
    assert [r["allowed"] for r in ratelimit.token_bucket(df, 2, 7).orderBy("seq").collect()] == want
    for i, part in enumerate((times[:5], times[5:])):
        spark.createDataFrame([("k", t, i * 5 + j) for j, t in enumerate(part)], "key string, t long, seq long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_ratelimit.token_bucket(stream, 2, 7).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["seq"]: r["allowed"] for r in spark.table("bucket").collect()}
    assert [got[i] for i in range(len(times))] == want


def test_lru(spark):
    rows = [(i % 2, (i * i) % 7, i) for i in range(200)]
    got = {r["seq"]: r["hit"] for r in lru_hits(spark.createDataFrame(rows, "shard long, key long, seq long"), 3, order=("seq",)).collect()}
    for s in (0, 1):
        held = OrderedDict()
        for shard, k, i in rows:
            if shard == s:
                assert got[i] == (k in held)
                held[k] = 1
                held.move_to_end(k)
                if len(held) > 3:
                    held.popitem(last=False)


def test_runs_and_manifest(spark, tmp_path):
    root = str(tmp_path)
    a, b = runs.write_run(records(spark, 50), root, 2), runs.write_run(records(spark, 30, start=50), root)
    assert runs.load_manifest(spark, root)[0] == sorted([a, b])
    assert runs.save_manifest(spark, root, [[a], [b], []]) == 1
    assert runs.save_manifest(spark, root, [[a, b], [], []]) == 2
    assert runs.load_manifest(spark, root) == [[a, b], [], []]
    assert runs.read_runs(spark, root, [a]).count() == 20
    assert sorted(map(tuple, merge.latest(runs.read_runs(spark, root, [a, b])).collect())) == sorted(map(tuple, merge.latest(records(spark, 80)).collect()))
    runs.delete_run(spark, root, b)
    assert runs.list_runs(spark, root) == [a]
    assert runs.read_runs(spark, root, []).count() == 0


def test_log(spark, tmp_path):
    path = str(tmp_path / "wal")
    df = records(spark, 40)
    wal.append(df, path)
    assert wal.read(spark, path).count() == 40
    whole = sorted(map(tuple, merge.latest(df).collect()))
    assert sorted(map(tuple, wal.replay(df, 0, 100).collect())) == whole
    assert wal.truncate(df, 500, 100).count() < 40
    last = wal.segments(df, 100).filter("start >= 500")
    assert wal.replay(df, 500, 100).count() == last.select("key").distinct().count()


def test_dictionary(spark, tmp_path):
    df = spark.createDataFrame([("b", 0), ("a", 1), ("c", 0), ("b", 1)], "key string, batch long")
    ids = indexing.dictionary(df)
    assert {r["key"]: r["id"] for r in ids.collect()} == {"b": 0, "c": 1, "a": 2}
    dictionary.save(ids, str(tmp_path / "d"))
    coded = spark.createDataFrame([(0,), (9,)], "id long")
    assert {r["id"]: r["key"] for r in indexing.decode(coded, dictionary.load(spark, str(tmp_path / "d"))).collect()} == {0: "b", 9: None}


def test_index_finds_the_block(spark):
    df = spark.createDataFrame([(0, f"k{i:02d}", "v", i, i, False) for i in range(12)], "run long, key string, value string, ts long, seq long, tombstone boolean")
    index = indexing.sparse_index(df, 5)
    assert [(r["key"], r["offset"]) for r in index.orderBy("key").collect()] == [("k00", 0), ("k05", 165), ("k10", 330)]
    got = {r["probe"]: (r["start"], r["end"]) for r in indexing.floor_lookup(index, ["k07", "k11", "a", "k05"]).collect()}
    assert got == {"k07": (165, 330), "k11": (330, 0), "k05": (165, 330)}


def test_compaction_keeps_tombstones_above_the_bottom(spark):
    cols = "level int, run long, key string, value string, ts long, seq long, tombstone boolean"
    df = spark.createDataFrame([(0, 0, "a", "1", 1, 1, False), (0, 1, "a", "", 2, 2, True), (0, 1, "b", "2", 1, 3, False), (1, 2, "a", "0", 0, 0, False), (1, 3, "x", "9", 0, 4, False)], cols)
    assert {(r["key"], r["tombstone"]) for r in compaction.size_tiered(df, 0, 7).collect()} == {("a", True), ("b", False)}
    assert {(r["key"], r["tombstone"]) for r in compaction.size_tiered(df, 0, 2).collect()} == {("a", True), ("b", False)}  # the bottom holds a
    assert {r["key"] for r in compaction.size_tiered(df.filter("run <> 2"), 0, 2).collect()} == {"b"}
    down = compaction.leveled(df, 0, 7).collect()
    assert [(r["key"], r["value"], r["level"]) for r in down] == [("a", "1", 1)]
    assert compaction.misordered(compaction.level_bounds(df)).count() == 0
    assert compaction.overfull(compaction.level_bounds(df), 1, 10, False, 7).count() == 2


def test_flush_stream_writes_a_run_per_batch(spark, tmp_path):
    for i in range(3):
        records(spark, 20, start=20 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    flush.flush(flush.log_stream(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("run").distinct().count() == 3
    assert sorted(map(tuple, merge.latest(out).collect())) == sorted(map(tuple, merge.latest(records(spark, 60)).collect()))


def test_corrupt_records_are_found(spark):
    df = spark.createDataFrame([("k", "v", 1), ("k", "v", None)], "key string, value string, crc long")
    assert integrity.corrupt(df).count() == 2


def test_tombstones_stay_while_the_bottom_holds_their_key(spark):
    rows = [(6, 1, "a", "old", 1, 1, False), (5, 2, "a", "", 2, 2, True), (5, 3, "b", "", 2, 3, True), (5, 2, "c", "new", 2, 4, False)]
    levels = spark.createDataFrame(rows, "level int, run int, key string, value string, ts long, seq long, tombstone boolean")
    got = {r["key"]: r["tombstone"] for r in compaction.size_tiered(levels, 5, 7).collect()}
    assert got == {"a": True, "c": False}


def test_rows_without_time_are_numbered_first(spark):
    log = spark.createDataFrame([(3, 1), (None, 2), (10**10, 3), (None, 4)], "ts long, seq long")
    got = {r["seq"]: (r["n"], r["start"]) for r in numbering.numbered(log, F.floor(F.col("ts") / 1000), ["ts", "seq"], size=F.col("seq")).collect()}
    assert got == {2: (0, 0), 4: (1, 2), 1: (2, 6), 3: (3, 7)}


def test_names_are_not_cut(spark):
    names = spark.createDataFrame([(None,), ("9",), ("0998",), ("9999",), ("123456",)], "last string").select(encoding.next_name(F.col("last")).alias("n"))
    assert [r["n"] for r in names.collect()] == ["0001", "0010", "0999", "10000", "123457"]
