"""Every operator as a query over the test tables, with the SQL that gives the same rows.

The base changelog comes from ``events``: the user is the key, errors are deletes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versionlog.functions import encoding, hashing
from versionlog.operators import catalog, compaction, indexing, integrity, merge, numbering, ratelimit, scan, simhash, sketches
from versionlog.operators.cache import lru_hits
from versionlog.schema import RECORD, changelog, micros, unreserved
from versionlog.scratch import scratch
from versionlog.sources import dictionary as dictionaries
from versionlog.sources import log as wal
from versionlog.sources import runs as stored_runs
from versionlog.sources.runs import parse_manifest
from versionlog.sources.workloads import cycling_puts
from versionlog.streaming import flush as streams
from versionlog.streaming import ratelimit as stream_ratelimit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BATCH, SEGMENT, WATERMARK, DEPTH = 100, 10_000, 150_000, 7
BLOOM_M, BLOOM_K = sketches.bloom_size(200, 0.001)
CMS_M, CMS_K = sketches.cms_size(0.01, 0.01)
HLL_P = 8
MANIFEST = '[["run-0001","run-0002","run-0003"],["run-0004"],["run-0005","run-0006"],null,null]'

#: Common table expressions that the SQL below begins with.
CTE = {
    "cl": "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || event_id END AS value, epoch_us(ts) AS ts, event_type = 'error' AS tombstone FROM events",
    "last": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM cl) WHERE rn = 1",
    "snap": "SELECT key, value, ts, seq FROM last WHERE NOT tombstone",
    "num": f"SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS n, (row_number() OVER (ORDER BY ts, seq) - 1) // {BATCH} AS batch FROM cl",
    "runs": "SELECT * EXCLUDE (rn, n, batch), batch AS run FROM (SELECT *, row_number() OVER (PARTITION BY batch, key ORDER BY ts DESC, seq DESC) AS rn FROM num) WHERE rn = 1",
    "bnd": "SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS records FROM runs GROUP BY run",
    "leveled": "SELECT *, CASE WHEN run % 5 < 3 THEN 0 ELSE 1 END AS level FROM runs",
    "man": "SELECT level, run, min(key) AS min_key, max(key) AS max_key, count(*) AS records FROM leveled GROUP BY ALL",
    "pos": "SELECT *, sum(29 + strlen(key) + strlen(value)) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - (29 + strlen(key) + strlen(value)) AS start FROM cl",
    "wrd": r"SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM documents) WHERE strlen(w) > 2 GROUP BY ALL",
    "fp": "SELECT d.doc_id, coalesce(sum(CASE WHEN s.v > 0 THEN 1::HUGEINT << s.i ELSE 0 END), 0)::UBIGINT AS f FROM documents d LEFT JOIN (SELECT doc_id, i, sum(CASE WHEN (('0x' || substr(md5(w), 1, 16))::UBIGINT >> i::UBIGINT) & 1 = 1 THEN c ELSE -c END) AS v FROM wrd, range(64) t(i) GROUP BY ALL) s USING (doc_id) GROUP BY d.doc_id",
    "idx": "SELECT run, key, offs AS \"offset\" FROM (SELECT run, key, row_number() OVER w - 1 AS i, coalesce(sum(CASE WHEN tombstone THEN 21 + strlen(key) ELSE 29 + strlen(key) + strlen(value) END) OVER (PARTITION BY run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM runs WINDOW w AS (PARTITION BY run ORDER BY key)) WHERE i % 5 = 0",
    "dict": "SELECT key, row_number() OVER (ORDER BY min(batch), key) - 1 AS id FROM num GROUP BY key",
    "bits": f"SELECT DISTINCT (('0x' || substr(md5(key || '000' || i), 1, 16))::UBIGINT % {BLOOM_M})::BIGINT AS bit FROM (SELECT DISTINCT key FROM cl), range({BLOOM_K}) t(i)",
    "cells": f"SELECT i::INT AS \"row\", (('0x' || substr(md5(key || '000' || i), 1, 16))::UBIGINT % {CMS_M})::BIGINT AS col, count(*) AS n FROM cl, range({CMS_K}) t(i) GROUP BY ALL",
    "fnv": "SELECT key, list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::HUGEINT)), lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * 1099511628211) % 18446744073709551616)::UBIGINT AS h FROM (SELECT DISTINCT key FROM cl)",
    "reg": f"SELECT (h >> {64 - HLL_P}::UBIGINT)::INT AS bucket, max(CASE WHEN h = 0 THEN 65 ELSE length(b) - length(rtrim(b, '0')) + 1 END)::INT AS rank FROM (SELECT h, bin(h) AS b FROM fnv) GROUP BY ALL",
    "leaf": "SELECT n AS idx, sha1(concat_ws('|', key, value, ts::VARCHAR, tombstone::VARCHAR)) AS hash FROM num",
    "req": "SELECT key, seq, ts // 1000000 AS t FROM cl",
    "bucket": "SELECT *, row_number() OVER (PARTITION BY key, session ORDER BY t, seq) <= 3 AS allowed FROM (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY t, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, seq) >= 7200 THEN 1 ELSE 0 END AS f FROM req))",
    "crc": "SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(kv) + 1), lambda i: ascii(kv[i])::BIGINT)), lambda h, b: list_reduce(list_concat([xor(h, b)], range(0, 8)::BIGINT[]), lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) AS crc FROM (SELECT *, key || value AS kv FROM cl)",
}
_NEEDS = {"last": ["cl"], "snap": ["last"], "num": ["cl"], "runs": ["num"], "bnd": ["runs"], "leveled": ["runs"], "man": ["leveled"], "pos": ["cl"], "fp": ["wrd"], "idx": ["runs"], "dict": ["num"], "bits": ["cl"], "cells": ["cl"], "fnv": ["cl"], "reg": ["fnv"], "leaf": ["num"], "req": ["cl"], "bucket": ["req"], "crc": ["cl"]}


def _with(names: str, body: str, extra: str = "") -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + ([extra] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def query(ctes: str = "", sql: str | None = None, extra: str = "") -> Callable[[Query], Query]:
    """Registers a query by its function's name, with its SQL over the named expressions."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _with(ctes, sql, extra)
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return changelog(e, F.col("user_id"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), micros(F.col("ts")), F.col("event_id"), F.col("event_type") == "error")


def runs_of(log: DataFrame) -> DataFrame:
    """Flushed batches: the latest record of each key within every hundred records."""
    return merge.latest(numbering.batches(log, BATCH), within=("batch",)).withColumnRenamed("batch", "run")


def leveled_runs(log: DataFrame) -> DataFrame:
    return runs_of(log).withColumn("level", F.when(F.col("run") % 5 < 3, 0).otherwise(1))


# Mutations and merges


@query("cl", "SELECT key, value, ts, seq, tombstone FROM cl")
def kv_changelog(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d)


@query("cl", "SELECT key, value, ts, seq, tombstone, row_number() OVER w AS version, coalesce(lead(ts) OVER w, 9223372036854775807) AS valid_to FROM cl WINDOW w AS (PARTITION BY key ORDER BY ts, seq)")
def kv_history(spark: SparkSession, d: str) -> DataFrame:
    """Open ends are shown as the greatest time."""
    return merge.history(base_log(spark, d)).withColumn("valid_to", F.coalesce("valid_to", F.lit((1 << 63) - 1)))


@query("snap", "SELECT * FROM snap")
def kv_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return merge.snapshot(base_log(spark, d))


@query("last", "SELECT key, ts FROM last WHERE tombstone")
def kv_deleted_keys(spark: SparkSession, d: str) -> DataFrame:
    return merge.deleted_keys(base_log(spark, d))


AS_OF = 1_705_276_800_000_000


@query("cl", f"SELECT key, value, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM cl WHERE ts <= {AS_OF}) WHERE rn = 1 AND NOT tombstone")
def kv_as_of(spark: SparkSession, d: str) -> DataFrame:
    return merge.as_of(base_log(spark, d), AS_OF)


@query("snap", "SELECT * FROM snap WHERE key = '42'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return scan.get(base_log(spark, d), "42")


@query("snap", "SELECT * FROM snap WHERE key IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderkey < 100)")
def kv_multi_get(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").filter(F.col("o_orderkey") < 100).select(F.col("o_custkey").cast("string").alias("key"))
    return scan.multi_get(base_log(spark, d), keys)


@query("", "SELECT key FROM (SELECT CASE c_custkey % 4 WHEN 0 THEN 'bloomFilter_' WHEN 1 THEN 'simhash' WHEN 2 THEN 'my_simhash' ELSE 'user' END || c_custkey AS key FROM customer) WHERE NOT regexp_matches(key, '^(bloomFilter|countMinSketch|hyperLogLog|simhash|tokenBucket)')")
def reserved_key_guard(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("bloomFilter_", "simhash", "my_simhash", "user"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return unreserved(table(spark, d, "customer").select(F.concat(kind, F.col("c_custkey").cast("string")).alias("key")))


_THREE = [(0, 2), (1, 2), (0, 3)]


@query("cl", "SELECT key, value, ts, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC, run) AS rn FROM (SELECT *, 0 AS run FROM cl WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM cl WHERE seq % 2 = 1 UNION ALL SELECT *, 2 FROM cl WHERE seq % 3 = 0)) WHERE rn = 1")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    return merge.merge_runs([log.filter(F.col("seq") % n == r) for r, n in _THREE])


# Scans


@query("snap", "SELECT * FROM snap WHERE key BETWEEN '10' AND '14'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.range_scan(base_log(spark, d), "10", "14")


@query("snap", "SELECT * FROM snap WHERE key BETWEEN '1' AND '5' ORDER BY key LIMIT 10 OFFSET 10")
def range_page_2(spark: SparkSession, d: str) -> DataFrame:
    return scan.page(scan.range_scan(base_log(spark, d), "1", "5"), 2, 10)


@query("snap", "SELECT * FROM snap WHERE false")
def range_invalid_page(spark: SparkSession, d: str) -> DataFrame:
    return scan.page(scan.range_scan(base_log(spark, d), "1", "5"), 0, 10)


@query("snap", "SELECT * FROM snap WHERE key BETWEEN '1' AND '5' ORDER BY key LIMIT 10 OFFSET 10000000")
def range_past_end(spark: SparkSession, d: str) -> DataFrame:
    return scan.page(scan.range_scan(base_log(spark, d), "1", "5"), 1_000_001, 10)


@query("snap", "SELECT * FROM snap WHERE starts_with(key, '7')")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.prefix_scan(base_log(spark, d), "7")


@query("", "SELECT url AS key, page_id AS value FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC) AS rn FROM pages) WHERE rn = 1 AND starts_with(url, 'http') ORDER BY url LIMIT 20 OFFSET 20")
def prefix_page_2(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    log = changelog(p, F.col("url"), F.col("page_id"), F.col("page_id"), F.col("page_id"), F.lit(False))
    return scan.page(scan.prefix_scan(log, "http"), 2, 20).select("key", F.col("value").cast("long").alias("value"))


@query("", "SELECT 'bloomFilter_' || p_partkey AS key FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 0")
def list_sketches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "bloomFilter").otherwise("simhash")
    log = changelog(p, F.concat_ws("_", kind, F.col("p_partkey")), F.col("p_name"), F.col("p_partkey"), F.col("p_partkey"), F.col("p_size") % 2 != 0)
    return catalog.list_sketches(log, "bloomFilter")


# Records, log, runs


@query("cl", "SELECT seq, CASE WHEN tombstone THEN '✝ ' ELSE '  ' END || key || chr(9) || value AS shown FROM cl")
def record_display(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d).select("seq", encoding.display(F.col("key"), F.col("value"), F.col("tombstone")).alias("shown"))


_VARINT = "greatest(1, ceil(length(bin({0})) / 7.0))::BIGINT"


@query("crc", f"SELECT seq, (CASE WHEN tombstone THEN 21 + strlen(key) ELSE 29 + strlen(key) + strlen(value) END)::BIGINT AS plain, (9 + {_VARINT.format('crc')} + {_VARINT.format('ts')} + CASE WHEN tombstone THEN 0 ELSE {_VARINT.format('strlen(value)')} + strlen(value) END)::BIGINT AS compressed, (29 + strlen(key) + strlen(value))::BIGINT AS log FROM crc")
def record_lengths(spark: SparkSession, d: str) -> DataFrame:
    k, v, t = F.col("key"), F.col("value"), F.col("tombstone")
    return base_log(spark, d).select(
        "seq", encoding.plain_length(k, v, t).alias("plain"),
        encoding.compressed_length(hashing.record_crc(k, v), F.col("ts"), v, t).alias("compressed"), encoding.log_length(k, v).alias("log"))


@query("cl", f"SELECT seq, ts, {_VARINT.format('ts')} AS ts_bytes, {_VARINT.format('seq')} AS seq_bytes FROM cl")
def varint_lengths(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d).select("seq", "ts", encoding.varint_length(F.col("ts")).alias("ts_bytes"), encoding.varint_length(F.col("seq")).alias("seq_bytes"))


_PLAIN = "printf('%016x', strlen(key)) || hex(key) || printf('%08x', crc) || printf('%016x', ts) || CASE WHEN tombstone THEN '01' ELSE '00' || printf('%016x', strlen(value)) || hex(value) END"
_LOGGED = "printf('%08x', crc) || printf('%016x', ts) || CASE WHEN tombstone THEN '01' ELSE '00' END || printf('%016x', strlen(key)) || printf('%016x', strlen(value)) || hex(key) || hex(value)"
_VARBYTES = "list_aggregate(list_transform(range(0, {1}), lambda i: printf('%02x', ((ts >> (7 * i)) & 127) + CASE WHEN i < {1} - 1 THEN 128 ELSE 0 END)), 'string_agg', '')"


@query("crc", f"SELECT seq, lower({_PLAIN}) AS plain, lower({_LOGGED}) AS logged, {_VARBYTES.format('ts', _VARINT.format('ts'))} AS ts_varint FROM crc")
def record_bytes(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("key", "value", "ts", "tombstone")]
    crc = hashing.record_crc(c[0], c[1])
    return base_log(spark, d).select("seq", *(F.lower(F.hex(x)).alias(n) for x, n in ((encoding.plain_bytes(*c, crc), "plain"), (encoding.log_bytes(*c, crc), "logged"), (encoding.varint_bytes(F.col("ts")), "ts_varint"))))


@query("crc", "SELECT seq, key, value, ts, tombstone, crc::BIGINT AS crc FROM crc UNION ALL SELECT -seq - 1, key, value, ts, tombstone, crc::BIGINT FROM crc")
def record_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("key", "value", "ts", "tombstone")]
    log = base_log(spark, d).withColumn("crc", hashing.record_crc(c[0], c[1]))
    logged = log.select("seq", encoding.decode_log(encoding.log_bytes(*c, F.col("crc"))).alias("r"))
    plain = log.select((-F.col("seq") - 1).alias("seq"), encoding.decode_plain(encoding.plain_bytes(*c, F.col("crc"))).alias("r"))
    return logged.unionByName(plain).select("seq", "r.*")


@query("", "SELECT p_partkey, printf('%04d', 7 * p_partkey + 1) AS name FROM part")
def next_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", encoding.next_name(7 * F.col("p_partkey")).alias("name"))


@query("pos", f"SELECT seq, start::BIGINT AS start, (start // {SEGMENT})::BIGINT AS segment, ((start + 28 + strlen(key) + strlen(value)) // {SEGMENT})::BIGINT AS last_segment FROM pos")
def wal_segments(spark: SparkSession, d: str) -> DataFrame:
    return wal.segments(base_log(spark, d), SEGMENT).select("seq", "start", "segment", "last_segment")


@query("pos", f"SELECT key, value, ts, seq, tombstone FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM pos WHERE start >= {WATERMARK}) WHERE rn = 1")
def wal_replay_from_watermark(spark: SparkSession, d: str) -> DataFrame:
    return wal.replay(base_log(spark, d), WATERMARK, SEGMENT)


@query("pos", f"SELECT key, value, ts, seq, tombstone FROM pos WHERE (start + 28 + strlen(key) + strlen(value)) // {SEGMENT} >= {WATERMARK // SEGMENT}")
def wal_truncate(spark: SparkSession, d: str) -> DataFrame:
    return wal.truncate(base_log(spark, d), WATERMARK, SEGMENT)


@query("crc", "SELECT seq, crc::BIGINT AS crc FROM crc")
def crc_values(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d).select("seq", hashing.record_crc(F.col("key"), F.col("value")).alias("crc"))


@query("cl", "SELECT seq, key, value FROM (SELECT seq, key, CASE WHEN seq % 97 = 0 THEN value || '!' ELSE value END AS value FROM cl) WHERE seq % 97 = 0")
def crc_check(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d).withColumn("crc", hashing.record_crc(F.col("key"), F.col("value")))
    damaged = log.withColumn("value", F.when(F.col("seq") % 97 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return integrity.corrupt(damaged).select("seq", "key", "value")


@query("num", "SELECT batch::BIGINT AS batch, count(*) AS records, count(DISTINCT key) AS keys, min(seq) AS first_seq FROM num GROUP BY batch")
def flush_batches(spark: SparkSession, d: str) -> DataFrame:
    filled = numbering.batches(base_log(spark, d), BATCH)
    return filled.groupBy("batch").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("key").alias("keys"), F.min("seq").alias("first_seq"))


@query("runs", "SELECT run::BIGINT AS run, key, value, ts, seq, tombstone FROM runs")
def flushed_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(base_log(spark, d))


@query("bnd", "SELECT run::BIGINT AS run, min_key, max_key, records FROM bnd")
def run_min_max(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bounds(runs_of(base_log(spark, d)))


@query("bnd", "SELECT run::BIGINT AS run FROM bnd WHERE min_key <= '101' AND max_key >= '101'")
def prune_point(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bounds(runs_of(base_log(spark, d))).filter(indexing.may_hold("101")).select("run")


@query("bnd", "SELECT run::BIGINT AS run FROM bnd WHERE min_key <= '1' AND max_key >= '0'")
def prune_range(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bounds(runs_of(base_log(spark, d))).filter(indexing.may_overlap("0", "1")).select("run")


@query("bnd", "SELECT run::BIGINT AS run FROM bnd WHERE NOT (max_key < '99' OR (min_key > '99' AND NOT starts_with(min_key, '99')))")
def prune_prefix(spark: SparkSession, d: str) -> DataFrame:
    return indexing.bounds(runs_of(base_log(spark, d))).filter(indexing.may_begin("99")).select("run")


@query("idx", 'SELECT run::BIGINT AS run, key, "offset" FROM idx')
def sparse_index(spark: SparkSession, d: str) -> DataFrame:
    return indexing.sparse_index(runs_of(base_log(spark, d)))


@query("idx", 'SELECT run::BIGINT AS run, key, offs AS "offset" FROM (SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY key) - 1 AS i, coalesce(sum(16 + strlen(key)) OVER (PARTITION BY run ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM idx) WHERE i % 5 = 0')
def summary_index(spark: SparkSession, d: str) -> DataFrame:
    return indexing.summary_index(runs_of(base_log(spark, d)))


PROBES = ["", "100", "42", "77", "999"]


@query("idx", "SELECT run::BIGINT AS run, probe, max(\"offset\") FILTER (key <= probe) AS start, coalesce(min(\"offset\") FILTER (key > probe), 0) AS \"end\" FROM idx, (VALUES (''), ('100'), ('42'), ('77'), ('999')) p(probe) GROUP BY run, probe HAVING start IS NOT NULL")
def index_floor_lookup(spark: SparkSession, d: str) -> DataFrame:
    return indexing.floor_lookup(indexing.sparse_index(runs_of(base_log(spark, d))), PROBES)


@query("dict", "SELECT key, id FROM dict")
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    return indexing.dictionary(numbering.batches(base_log(spark, d), BATCH))


@query("dict", "SELECT c.id, d.key, c.seq FROM (SELECT d.id + CASE WHEN seq % 50 = 0 THEN 1000000 ELSE 0 END AS id, seq FROM cl JOIN dict d USING (key)) c LEFT JOIN dict d USING (id)")
def dictionary_decode(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    ids = indexing.dictionary(numbering.batches(log, BATCH))
    coded = indexing.encode(log, ids).select((F.col("id") + F.when(F.col("seq") % 50 == 0, 1_000_000).otherwise(0)).alias("id"), "seq")
    return indexing.decode(coded, ids)


# Levels


@query("", "SELECT level::INT AS level, pos::INT AS pos, run FROM (VALUES (0, 0, 'run-0001'), (0, 1, 'run-0002'), (0, 2, 'run-0003'), (1, 0, 'run-0004'), (2, 0, 'run-0005'), (2, 1, 'run-0006')) m(level, pos, run)")
def manifest_levels(spark: SparkSession, d: str) -> DataFrame:
    return parse_manifest(spark.range(1).select(F.lit(MANIFEST).alias("value")))


@query("", "SELECT level::BIGINT AS level, 10::BIGINT AS size_tiered, (CASE WHEN level = 0 THEN 1 ELSE 10 * 9 ** (level - 1) END)::BIGINT AS leveled FROM range(7) t(level)")
def level_capacity(spark: SparkSession, d: str) -> DataFrame:
    level = F.col("id")
    return spark.range(DEPTH).select(level.alias("level"), compaction.capacity(level, 10, 9, False).alias("size_tiered"), compaction.capacity(level, 10, 9, True).alias("leveled"))


@query("man", "SELECT level, count(*) AS runs, 10::BIGINT AS capacity FROM man GROUP BY level HAVING count(*) > 10")
def level_overfull(spark: SparkSession, d: str) -> DataFrame:
    return compaction.overfull(compaction.level_bounds(leveled_runs(base_log(spark, d))), 10, 9, False, DEPTH)


@query("man", "SELECT u.run::BIGINT AS upper, l.run::BIGINT AS lower FROM man u JOIN man l ON u.level = 0 AND l.level = 1 AND u.min_key <= l.max_key AND u.max_key >= l.min_key")
def leveled_overlap(spark: SparkSession, d: str) -> DataFrame:
    return compaction.overlaps(compaction.level_bounds(leveled_runs(base_log(spark, d))), 0)


@query("man", "SELECT level, run::BIGINT AS run, max_key, next_min FROM (SELECT *, lead(min_key) OVER (PARTITION BY level ORDER BY min_key, run) AS next_min FROM man) WHERE level > 0 AND next_min <= max_key")
def leveled_valid(spark: SparkSession, d: str) -> DataFrame:
    return compaction.misordered(compaction.level_bounds(leveled_runs(base_log(spark, d))))


@query("leveled", "SELECT key, value, ts, seq, tombstone, 1 AS level FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM leveled WHERE level = 0) WHERE rn = 1")
def compact_size_tiered(spark: SparkSession, d: str) -> DataFrame:
    return compaction.size_tiered(leveled_runs(base_log(spark, d)), 0, DEPTH)


@query("leveled man", "SELECT key, value, ts, seq, tombstone, 1 AS level FROM (SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM leveled l WHERE run IN (SELECT run FROM u) OR run IN (SELECT m.run FROM man m, u WHERE m.level = 1 AND u.min_key <= m.max_key AND u.max_key >= m.min_key)) WHERE rn = 1", "u AS (SELECT * FROM man WHERE level = 0 ORDER BY run LIMIT 1)")
def compact_leveled(spark: SparkSession, d: str) -> DataFrame:
    return compaction.leveled(leveled_runs(base_log(spark, d)), 0, DEPTH)


@query("leveled", "SELECT key, value, ts, seq, tombstone, 6 AS level FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM leveled WHERE level = 0) WHERE rn = 1 AND NOT tombstone")
def compact_to_bottom(spark: SparkSession, d: str) -> DataFrame:
    runs = leveled_runs(base_log(spark, d)).withColumn("level", F.when(F.col("level") == 0, DEPTH - 2).otherwise(0))
    return compaction.size_tiered(runs, DEPTH - 2, DEPTH)


#: What stands on the bottom level after a compaction must show the same as what stood on two levels before.
BOTTOM = "SELECT key, value, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM cl) WHERE rn = 1 AND NOT tombstone"


@query("cl", BOTTOM)
def compact_over_bottom(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("run") < 20, DEPTH - 1).otherwise(DEPTH - 2)
    levels = runs_of(base_log(spark, d)).withColumn("level", old)
    new = compaction.size_tiered(levels, DEPTH - 2, DEPTH).select(*RECORD.names)
    return merge.snapshot(levels.filter(F.col("level") == DEPTH - 1).select(*RECORD.names).unionByName(new)).select("key", "value", "ts", "seq")


# Sketches


@query("", f"SELECT {BLOOM_M}::INT AS bloom_m, {BLOOM_K}::INT AS bloom_k, ceil(200 * abs(ln(0.001)) / ln(2) ** 2)::INT AS m, ceil(ceil(200 * abs(ln(0.001)) / ln(2) ** 2) / 200 * ln(2))::INT AS k")
def bloom_params(spark: SparkSession, d: str) -> DataFrame:
    m, k = sketches.bloom_size(200, 0.001)
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in (("bloom_m", BLOOM_M), ("bloom_k", BLOOM_K), ("m", m), ("k", k))))


@query("bits", "SELECT bit FROM bits")
def bloom_bits(spark: SparkSession, d: str) -> DataFrame:
    return sketches.bloom_build(base_log(spark, d), "key", BLOOM_M, BLOOM_K)


@query("bits", "SELECT bit FROM bits")
def bloom_merge(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    halves = [sketches.bloom_build(log.filter(F.col("seq") % 2 == r), "key", BLOOM_M, BLOOM_K) for r in (0, 1)]
    return sketches.bloom_merge(*halves)


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))


_FOUND = f"SELECT key, count(b.bit) = {BLOOM_K} AS found FROM (SELECT key, (('0x' || substr(md5(key || '000' || i), 1, 16))::UBIGINT % {BLOOM_M})::BIGINT AS bit FROM (SELECT DISTINCT c_custkey::VARCHAR AS key FROM customer), range({BLOOM_K}) t(i)) p LEFT JOIN bits b USING (bit) GROUP BY key"


@query("bits", _FOUND)
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    return sketches.bloom_probe(bloom_bits(spark, d), _probes(spark, d), "key", BLOOM_M, BLOOM_K)


@query("bits", f"SELECT count(*) AS absent, count(*) FILTER (found) AS false_positives FROM ({_FOUND}) WHERE key NOT IN (SELECT key FROM cl)")
def bloom_fpr(spark: SparkSession, d: str) -> DataFrame:
    absent = bloom_probe(spark, d).join(base_log(spark, d).select("key"), "key", "left_anti")
    return absent.agg(F.count(F.lit(1)).alias("absent"), F.count(F.when(F.col("found"), 1)).alias("false_positives"))


@query("", f"SELECT {CMS_M}::INT AS m, {CMS_K}::INT AS k, ceil(exp(1) / 0.01)::INT AS m_again, ceil(ln(exp(1) / 0.01))::INT AS k_again")
def cms_params(spark: SparkSession, d: str) -> DataFrame:
    m, k = sketches.cms_size(0.01, 0.01)
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in (("m", CMS_M), ("k", CMS_K), ("m_again", m), ("k_again", k))))


@query("cells", 'SELECT "row", col, n FROM cells')
def cms_cells(spark: SparkSession, d: str) -> DataFrame:
    return sketches.cms_build(base_log(spark, d), "key", CMS_M, CMS_K)


@query("cells", 'SELECT "row", col, n FROM cells')
def cms_merge(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    return sketches.cms_merge(*(sketches.cms_build(log.filter(F.col("seq") % 2 == r), "key", CMS_M, CMS_K) for r in (0, 1)))


_ESTIMATE = f"SELECT key, min(coalesce(c.n, 0)) AS estimate FROM (SELECT key, i::INT AS \"row\", (('0x' || substr(md5(key || '000' || i), 1, 16))::UBIGINT % {CMS_M})::BIGINT AS col FROM (SELECT DISTINCT key FROM cl), range({CMS_K}) t(i)) p LEFT JOIN cells c USING (\"row\", col) GROUP BY key"


@query("cells", _ESTIMATE)
def cms_estimate(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    return sketches.cms_estimate(cms_cells(spark, d), log, "key", CMS_M, CMS_K)


@query("cells", f"SELECT key, estimate - n AS error FROM ({_ESTIMATE}) JOIN (SELECT key, count(*) AS n FROM cl GROUP BY key) USING (key)")
def cms_error(spark: SparkSession, d: str) -> DataFrame:
    exact = base_log(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return cms_estimate(spark, d).join(exact, "key").select("key", (F.col("estimate") - F.col("n")).alias("error"))


@query("reg", "SELECT bucket, rank FROM reg")
def hll_registers(spark: SparkSession, d: str) -> DataFrame:
    return sketches.hll_build(base_log(spark, d), "key", HLL_P)


@query("reg", "SELECT bucket, rank FROM reg")
def hll_merge(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    return sketches.hll_merge(*(sketches.hll_build(log.filter(F.col("seq") % 2 == r), "key", HLL_P) for r in (0, 1)))


_M = 1 << HLL_P


@query("reg", f"SELECT round(CASE WHEN e <= 2.5 * {_M} AND filled < {_M} THEN {_M} * ln({_M}.0 / ({_M} - filled)) ELSE e END, 4)::DOUBLE AS estimate FROM (SELECT count(*) AS filled, 0.7213 / (1 + 1.079 / {_M}) * {_M} * {_M} / (sum(2.0 ** -rank) + {_M} - count(*)) AS e FROM reg)")
def hll_estimate(spark: SparkSession, d: str) -> DataFrame:
    return sketches.hll_estimate(hll_registers(spark, d), HLL_P).select(F.round("estimate", 4).alias("estimate"))


@query("cl", "SELECT count(DISTINCT key) AS keys FROM cl")
def distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d).agg(F.countDistinct("key").alias("keys"))


@query()
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return sketches.approx_distinct(base_log(spark, d), "key")


@query("cl", "SELECT count(DISTINCT key) AS keys, true AS close FROM cl")
def approx_distinct_error(spark: SparkSession, d: str) -> DataFrame:
    """The exact number, and whether the estimate is within a tenth of it."""
    log = base_log(spark, d)
    guess = sketches.approx_distinct(log, "key").select("estimate", F.lit(0).cast("long").alias("keys"))
    both = guess.unionByName(log.agg(F.lit(0).cast("long").alias("estimate"), F.countDistinct("key").alias("keys"))).agg(F.max("estimate").alias("e"), F.max("keys").alias("keys"))
    return both.select("keys", (10 * F.abs(F.col("e") - F.col("keys")) <= F.col("keys")).alias("close"))


@query("cells", "SELECT 'countMinSketch_users' AS sketch, \"row\"::BIGINT AS \"row\", col, n FROM cells")
def sketch_catalog(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    first, more = (sketches.cms_build(log.filter(F.col("seq") % 2 == r), "key", CMS_M, CMS_K) for r in (0, 1))
    held = catalog.create("countMinSketch", "users", first).unionByName(catalog.create("countMinSketch", "gone", first))
    return catalog.insert(catalog.delete(held, "countMinSketch", "gone"), "countMinSketch", "users", more)


@query("fp", "SELECT doc_id, (f & 4294967295)::BIGINT AS lo, (f >> 32)::BIGINT AS hi FROM fp")
def simhash_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = simhash.halves(F.col("fingerprint"))
    return simhash.fingerprints(table(spark, d, "documents")).select("doc_id", lo.alias("lo"), hi.alias("hi"))


@query("fp", "SELECT a.doc_id AS a, b.doc_id AS b, bit_count(xor(a.f, b.f))::INT AS distance FROM fp a JOIN fp b ON b.doc_id = a.doc_id + 1")
def simhash_hamming(spark: SparkSession, d: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, d, "documents"))
    a, b = prints.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("fa")), prints.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("fb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", simhash.hamming(F.col("fa"), F.col("fb")).alias("distance"))


@query("fp", "SELECT a.id AS a, b.id AS b, bit_count(xor(a.f, b.f))::INT AS distance FROM n a JOIN n b ON a.id < b.id AND bit_count(xor(a.f, b.f)) <= 3 UNION ALL SELECT n.id, fp.doc_id, 0 FROM fp JOIN n USING (f) WHERE fp.doc_id <> n.id", "n AS MATERIALIZED (SELECT f, min(doc_id) AS id FROM fp GROUP BY f)")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near(simhash.fingerprints(table(spark, d, "documents")))


# Integrity


def _leaf_count(spark: SparkSession, d: str) -> int:
    return table(spark, d, "events").count()


_LEVEL = "SELECT idx // 2 AS idx, sha1(unhex(max(hash) FILTER (idx % 2 = 0) || coalesce(max(hash) FILTER (idx % 2 = 1), sha1('')))) AS hash FROM {0} GROUP BY idx // 2"


@query("leaf", "SELECT idx, hash FROM leaf")
def merkle_leaves(spark: SparkSession, d: str) -> DataFrame:
    return integrity.merkle_leaves(base_log(spark, d))


_TREE = ", ".join(["l0 AS (SELECT * FROM leaf)"] + [f"l{i} AS ({_LEVEL.format(f'l{i - 1}')})" for i in range(1, 21)])


@query("leaf", "SELECT level, idx, hash FROM (" + " UNION ALL ".join(f"SELECT {i} AS level, idx, hash FROM l{i}" for i in range(21)) + ") WHERE level <= 1 OR level <= (SELECT ceil(log2(count(*))) FROM leaf)", _TREE)
def merkle_levels(spark: SparkSession, d: str) -> DataFrame:
    return integrity.merkle_levels(integrity.merkle_leaves(base_log(spark, d)), _leaf_count(spark, d))


@query("leaf", "SELECT hash FROM (" + " UNION ALL ".join(f"SELECT {i} AS level, hash, count(*) OVER () AS n FROM l{i}" for i in range(1, 21)) + ") WHERE n = 1 ORDER BY level LIMIT 1", _TREE)
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    return integrity.merkle_root(integrity.merkle_leaves(base_log(spark, d)), _leaf_count(spark, d))


@query("leaf", "SELECT idx, CASE WHEN idx < 5 THEN 'removed' ELSE 'changed' END AS change FROM num WHERE n < 5 OR (seq % 500 = 0)".replace("idx", "n AS idx", 1).replace("WHEN idx", "WHEN n"))
def merkle_diff(spark: SparkSession, d: str) -> DataFrame:
    log = base_log(spark, d)
    a = integrity.merkle_leaves(log)
    b = integrity.merkle_leaves(log.withColumn("value", F.when(F.col("seq") % 500 == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value")))).filter(F.col("idx") >= 5)
    return integrity.merkle_diff(a, b)


# State


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return base_log(spark, d).select("key", "seq", F.floor(F.col("ts") / 1_000_000).alias("t"))


@query("bucket", "SELECT key, seq, t, session, allowed FROM bucket")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return ratelimit.token_bucket(_requests(spark, d), 3, 7200)


@query("bucket", "SELECT key, count(*) AS requests, count(*) FILTER (NOT allowed) AS rejected FROM bucket GROUP BY key")
def token_bucket_rejections(spark: SparkSession, d: str) -> DataFrame:
    return ratelimit.rejections(_requests(spark, d), 3, 7200)


@query("", "WITH a AS (SELECT event_type AS shard, CAST(user_id % 20 AS BIGINT) AS key, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events), p AS (SELECT *, lag(pos) OVER (PARTITION BY shard, key ORDER BY pos) AS prev FROM a) SELECT p.shard, p.seq, p.key, p.prev IS NOT NULL AND (SELECT count(DISTINCT b.key) FROM a b WHERE b.shard = p.shard AND b.pos > p.prev AND b.pos < p.pos) < 5 AS hit FROM p")
def lru_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("shard"), (F.col("user_id") % 20).alias("key"), micros(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"))
    return lru_hits(e, 5)


@query("", "SELECT CAST(i % 100 AS VARCHAR) AS key, count(*) AS puts, max(i) AS last FROM range(100000) t(i) GROUP BY 1")
def workload_put100(spark: SparkSession, d: str) -> DataFrame:
    return cycling_puts(spark, 100_000, 100).groupBy("key").agg(F.count(F.lit(1)).alias("puts"), F.max("seq").alias("last"))


@query("", "SELECT CAST(i % 50000 AS VARCHAR) AS key, CAST(i % 50000 AS VARCHAR) AS value, i AS ts, i AS seq FROM range(50000, 100000) t(i)")
def workload_put50000(spark: SparkSession, d: str) -> DataFrame:
    return merge.snapshot(cycling_puts(spark, 100_000, 50_000))


# Written and read back, in batches and as streams


@query("last", "SELECT key, value, ts, seq, tombstone FROM last WHERE key BETWEEN '2' AND '6'")
def run_write_read(spark: SparkSession, d: str) -> DataFrame:
    """Two runs written and committed to a manifest, and a key range merged from what the manifest names."""
    root, log = scratch(spark, "runs"), base_log(spark, d)
    ids = [stored_runs.write_run(log.filter(F.col("seq") % 2 == r), root) for r in (0, 1)]
    stored_runs.save_manifest(spark, root, [ids, [], []])
    every = [r for level in stored_runs.load_manifest(spark, root) for r in level]
    return merge.latest(stored_runs.read_runs(spark, root, every).filter(F.col("key").between("2", "6")))


@query("last", "SELECT key, value, ts, seq, tombstone FROM last")
def wal_write_read(spark: SparkSession, d: str) -> DataFrame:
    """The log written with checksums in two appends, verified, and replayed from its start."""
    root, log = scratch(spark, "log"), base_log(spark, d)
    for r in (0, 1):
        wal.append(log.filter(F.col("seq") % 2 == r), root)
    return wal.replay(wal.read(spark, root), 0, SEGMENT)


@query("dict", "SELECT key, id FROM dict")
def dictionary_write_read(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "dictionary")
    dictionaries.save(indexing.dictionary(numbering.batches(base_log(spark, d), BATCH)), root)
    return dictionaries.load(spark, root)


@query("last", "SELECT key, value, ts, seq, tombstone FROM last")
def stream_flush(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of files, each flushed as a run; the runs merged."""
    root = scratch(spark, "stream")
    base_log(spark, d).repartition(3, "seq").write.parquet(f"{root}/log")
    streams.flush(streams.log_stream(spark, f"{root}/log"), f"{root}/out", f"{root}/state").awaitTermination()
    return merge.latest(spark.read.schema(RECORD).parquet(f"{root}/out/*"))


@query("bucket", "SELECT key, seq, t, allowed FROM bucket")
def stream_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "bucket")
    _requests(spark, d).write.parquet(f"{root}/in")
    requests = spark.readStream.schema("key string, seq long, t long").parquet(f"{root}/in")
    sink = stream_ratelimit.token_bucket(requests, 3, 7200).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("key", "seq", "t", "allowed")
