"""Changelog semantics on tiny literal frames."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from versionlog.functions import encoding, hashing
from versionlog.operators import merge, numbering, scan
from versionlog.schema import RECORD, changelog, unreserved


def log(spark, *rows):
    """Rows of (key, value or None for a delete, ts)."""
    return spark.createDataFrame([(k, v or "", ts, i, v is None) for i, (k, v, ts) in enumerate(rows)], RECORD)


def live(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_delete_then_put_and_put_then_delete(spark):
    df = log(spark, ("a", "1", 1), ("a", None, 2), ("b", None, 1), ("b", "2", 2), ("c", "3", 5), ("c", None, 4))
    assert live(merge.snapshot(df)) == {"b": "2", "c": "3"}
    assert [r["key"] for r in merge.deleted_keys(df).collect()] == ["a"]


def test_delete_hides_older_runs(spark):
    old, new = log(spark, ("a", "1", 1)), log(spark, ("a", None, 2))
    assert live(merge.merge_runs([old, new], keep_tombstones=False)) == {}
    assert merge.merge_runs([old, new]).count() == 1


def test_ties_go_to_the_later_record_and_the_earlier_run(spark):
    assert live(merge.snapshot(log(spark, ("a", "1", 1), ("a", "2", 1)))) == {"a": "2"}
    x, y = (spark.createDataFrame([("a", v, 1, 0, False)], RECORD) for v in "xy")
    assert live(merge.merge_runs([x, y])) == {"a": "x"}


def test_as_of_and_history(spark):
    df = log(spark, ("a", "1", 1), ("a", "2", 3), ("a", None, 5))
    assert live(merge.as_of(df, 4)) == {"a": "2"}
    assert live(merge.as_of(df, 5)) == {}
    assert [(r["version"], r["valid_to"]) for r in merge.history(df).orderBy("version").collect()] == [(1, 3), (2, 5), (3, None)]


def test_pages_and_ranges(spark):
    df = log(spark, *[(k, k, 1) for k in ("", "a", "ab", "b", "é", "z")])
    assert sorted(live(scan.range_scan(df, "a", "b"))) == ["a", "ab", "b"]
    assert live(scan.range_scan(df, "b", "a")) == {}
    assert "" in live(scan.range_scan(df, "", "a"))
    assert sorted(live(scan.prefix_scan(df, "a"))) == ["a", "ab"]
    records = merge.snapshot(df)
    for number, size in ((0, 5), (1, 0), (-1, 2), (9, 5)):
        assert scan.page(records, number, size).count() == 0
    pages = [r["key"] for n in (1, 2, 3) for r in scan.page(records, n, 2).collect()]
    assert pages == [r["key"] for r in scan.iterate(records)] == ["", "a", "ab", "b", "z", "é"]


def test_point_reads(spark):
    df = log(spark, ("a", "1", 1), ("b", None, 1))
    assert live(scan.get(df, "a")) == {"a": "1"}
    assert live(scan.get(df, "b")) == live(scan.get(df, "x")) == {}
    keys = spark.createDataFrame([("a",), ("a",), ("x",)], "key string")
    assert live(scan.multi_get(df, keys)) == live(scan.multi_get(df, keys, 3)) == {"a": "1"}


def test_pushdown_reaches_the_scan(spark, tmp_path):
    log(spark, *[(str(i), "v", i) for i in range(100)]).write.parquet(str(tmp_path / "t"))
    plan = scan.range_scan(spark.read.parquet(str(tmp_path / "t")), "10", "20")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,10)" in plan and "LessThanOrEqual(key,20)" in plan


def test_reserved_keys_and_null_values(spark):
    df = spark.createDataFrame([("bloomFilter_x",), ("tokenBucket",), ("mybloomFilter",)], "key string")
    assert [r["key"] for r in unreserved(df).collect()] == ["mybloomFilter"]
    raw = spark.createDataFrame([("k", None, 1, None)], "k string, v string, t long, dead boolean")
    row = changelog(raw, F.col("k"), F.col("v"), F.col("t"), F.col("t"), F.col("dead")).first()
    assert row["value"] == "" and row["tombstone"] is False


def test_lengths_and_display(spark):
    row = spark.range(1).select(
        encoding.plain_length(F.lit("é"), F.lit("abc"), F.lit(False)).alias("p"), encoding.plain_length(F.lit("é"), F.lit("abc"), F.lit(True)).alias("d"),
        *[encoding.varint_length(F.lit(n).cast("long")).alias(f"v{n}") for n in (0, 127, 128, 1 << 40)],
        encoding.display(F.lit("k"), F.lit("v"), F.lit(True)).alias("s"), encoding.next_name(F.lit("0041")).alias("n"), encoding.next_name(F.lit(None)).alias("n0")).first()
    assert (row["p"], row["d"], row["v0"], row["v127"], row["v128"], row["v1099511627776"]) == (34, 23, 1, 1, 2, 6)
    assert (row["s"], row["n"], row["n0"]) == ("✝ k\tv", "0042", "0001")


def test_fnv_known_values(spark):
    want = {"": 14695981039346656037, "a": 12638187200555641996, "foobar": 0x85944171F73967E8}
    df = spark.createDataFrame([(k,) for k in want], "k string").select("k", hashing.fnv1a64(F.col("k")).alias("h"))
    assert {r["k"]: int(r["h"]) for r in df.collect()} == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.sampled_from("xyz")), st.integers(0, 5)), min_size=1, max_size=12))
def test_merge_is_idempotent_and_order_free(spark, rows):
    df = log(spark, *rows)
    once = merge.latest(df)
    assert sorted(map(tuple, merge.latest(once).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, merge.latest(df.orderBy(F.desc("seq"))).collect())) == sorted(map(tuple, once.collect()))


def test_numbers_and_running_sums_over_buckets(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101, i % 7) for i in range(500)], "seq long, ts long, s long")
    got = numbering.numbered(df, F.floor(F.col("ts") / 10), ["ts", "seq"], size=F.col("s")).orderBy("n").collect()
    rows = sorted(((i * 37) % 101, i, i % 7) for i in range(500))
    assert [(r["ts"], r["seq"]) for r in got] == [x[:2] for x in rows]
    assert [r["n"] for r in got] == list(range(500))
    assert [r["start"] for r in got] == [sum(x[2] for x in rows[:i]) for i in range(500)]


def test_codec(spark):
    rows = [("é漢", "v", 1 << 50, False), ("", "", 0, False), ("k", "", 127, True), ("k" * 300, "w" * 200, 128, False)]
    df = spark.createDataFrame(rows, "key string, value string, ts long, tombstone boolean").withColumn("crc", hashing.record_crc(F.col("key"), F.col("value")))
    c = [F.col(x) for x in ("key", "value", "ts", "tombstone", "crc")]
    got = df.select(
        encoding.decode_log(encoding.log_bytes(*c)).alias("a"), encoding.decode_plain(encoding.plain_bytes(*c)).alias("b"),
        encoding.varint_bytes(F.col("ts")).alias("v"),
        (F.octet_length(encoding.plain_bytes(*c)) - encoding.plain_length(*c[:2], c[3])).alias("p"), (F.octet_length(encoding.log_bytes(*c)) - encoding.log_length(*c[:2])).alias("l"),
        (F.octet_length(encoding.compressed_bytes(F.lit(7), c[1], c[2], c[3], c[4])) - encoding.compressed_length(c[4], c[2], c[1], c[3])).alias("z")).collect()
    for r, want in zip(got, rows, strict=True):
        assert tuple(r["a"])[:4] == tuple(r["b"])[:4] == want and r["a"]["crc"] == r["b"]["crc"]
        assert (r["p"], r["l"], r["z"]) == (0, 0, 0)
        n, out = want[2], []
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                break
        assert bytes(r["v"]) == bytes(out)
