"""The registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.log import event_log, order_log, raw_value
from ..operators import read
from . import layout

FLUSH_PAIRS = 100
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LOG = """WITH log AS (SELECT user_id * 10 + event_id % 10 AS key, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS value,
  event_type = 'error' AS deleted, event_id AS seq, event_id // 100 AS flush FROM events),
newest AS (SELECT key, value, deleted, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
live AS (SELECT key, value, seq FROM newest WHERE NOT deleted),
nf AS (SELECT max(flush) + 1 AS n FROM log),
placed AS (SELECT log.*, CASE WHEN flush < n // 59049 * 59049 THEN 4 WHEN flush < n // 729 * 729 THEN 3 WHEN flush < n // 27 * 27 THEN 2 WHEN flush < n // 3 * 3 THEN 1 ELSE 0 END AS level FROM log, nf),
located AS (SELECT *, CASE level WHEN 4 THEN 0 WHEN 3 THEN flush // 729 WHEN 2 THEN flush // 27 WHEN 1 THEN flush // 3 ELSE flush END AS run FROM placed),
runs AS (SELECT level, run, count(DISTINCT key) AS pairs, min(key) AS min_key, max(key) AS max_key FROM located GROUP BY level, run),
ranked AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rn FROM live),
leaf AS (SELECT rn // 256 AS page, max(key) AS max_key, count(*) AS pairs FROM ranked GROUP BY 1),
node AS (SELECT page // 256 AS node, max(max_key) AS max_key, count(*) AS children FROM leaf GROUP BY 1),
asked AS (SELECT unnest(range(0, 2000, 7)) AS key),
ranges AS (SELECT i AS qid, i * 13 AS lo, i * 13 + 100 AS hi FROM range(100) t(i))
"""


def query(name: str, sql: str | None = None, head: str = LOG) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = head + sql
        return f

    return add


def _asked(spark: SparkSession) -> DataFrame:
    return spark.range(0, 2000, 7).select(F.col("id").alias("key"))


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.range(100).select(F.col("id").alias("qid"), (F.col("id") * 13).alias("lo"), (F.col("id") * 13 + 100).alias("hi"))


@query("put_bulk", "SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders", head="")
def put_bulk(s, d):
    return read.resolve(order_log(s, d)).select("key", "value")


@query("put_overwrite", "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE NOT deleted) WHERE rn = 1")
def put_overwrite(s, d):
    return read.resolve(event_log(s, d).where("not deleted")).select("key", "value", "seq")


@query("delete_live", "SELECT key, value FROM live")
def delete_live(s, d):
    return read.resolve(event_log(s, d)).select("key", "value")


def _get(name: str, key: int) -> None:
    @query(name, f"SELECT {key}::BIGINT AS key, (SELECT value FROM live WHERE key = {key}) AS value, EXISTS (SELECT 1 FROM live WHERE key = {key}) AS found")
    def _(s, d, key=key):
        return read.get(event_log(s, d), key)


_get("get_hit", 100)
_get("get_miss", 10**9)


@query("get_deleted", "SELECT min(key)::BIGINT AS key, NULL::BIGINT AS value, false AS found FROM newest WHERE deleted")
def get_deleted(s, d):
    log = event_log(s, d)
    gone = read.resolve(log, False).where("deleted").agg(F.min("key").alias("key"))
    return read.multi_get(log, gone)


@query("multi_get", "SELECT key, value, live.key IS NOT NULL AS found FROM asked LEFT JOIN live USING (key)")
def multi_get(s, d):
    return read.multi_get(event_log(s, d), _asked(s))


def _scan(name: str, low: int, high: int) -> None:
    @query(name, f"SELECT key, value FROM live WHERE key BETWEEN {low} AND {high}")
    def _(s, d):
        return read.scan(event_log(s, d), low, high)


_scan("scan_range", 100, 400)
_scan("scan_single", 100, 100)
_scan("scan_below_min", -(10**12), 50)
_scan("scan_above_max", 1000, 2**63 - 1)
_scan("scan_full", -(2**63) + 1, 2**63 - 1)


@query("scan_inverted_count", "SELECT count(*)::BIGINT AS n FROM live WHERE key BETWEEN 400 AND 100")
def scan_inverted_count(s, d):
    return read.scan(event_log(s, d), 400, 100).agg(F.count("*").alias("n"))


@query("scan_skip_tombstones", "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE NOT deleted) WHERE rn = 1 AND key BETWEEN 100 AND 400")
def scan_skip_tombstones(s, d):
    return read.scan_skipping(event_log(s, d), 100, 400)


@query("multi_scan", "SELECT qid, count(live.key)::BIGINT AS n, coalesce(sum(value), 0)::BIGINT AS total FROM ranges LEFT JOIN live ON key BETWEEN lo AND hi GROUP BY qid")
def multi_scan(s, d):
    return read.multi_scan(event_log(s, d), _ranges(s))


@query("multi_scan_wide", "SELECT qid, count(live.key)::BIGINT AS n, coalesce(sum(value), 0)::BIGINT AS total FROM (SELECT qid, lo - 10000000 AS lo, hi AS hi FROM ranges) LEFT JOIN live ON key BETWEEN lo AND hi GROUP BY qid")
def multi_scan_wide(s, d):
    return read.multi_scan(event_log(s, d), _ranges(s).withColumn("lo", F.col("lo") - 10_000_000))


@query("memtable_scan_raw", "SELECT key, CASE WHEN deleted THEN -9223372036854775807 - 1 ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE flush = 0) WHERE rn = 1 AND key BETWEEN 0 AND 1000")
def memtable_scan_raw(s, d):
    return read.raw_scan(event_log(s, d).where("flush = 0"), 0, 1000, raw_value())


@query("memtable_get", "SELECT flush, key, CASE WHEN deleted THEN -9223372036854775807 - 1 ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY flush, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
def memtable_get(s, d):
    """Every key asked of the memtable of every flush, raw."""
    log = event_log(s, d)
    newest = log.groupBy("flush", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("deleted", "seq").alias("deleted"))
    asked = log.select("flush", "key").distinct()
    return asked.join(newest, ["flush", "key"], "left").select("flush", "key", raw_value().alias("value"))


@query("memtable_traverse", "SELECT flush, key, value, deleted FROM (SELECT *, row_number() OVER (PARTITION BY flush, key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1")
def memtable_traverse(s, d):
    log = event_log(s, d)
    return log.groupBy("flush", "key").agg(F.max_by("value", "seq").alias("value"), F.max_by("deleted", "seq").alias("deleted")).orderBy("flush", "key")


@query("memtable_size", "SELECT flush, (count(DISTINCT key) * 16)::BIGINT AS bytes FROM log GROUP BY flush")
def memtable_size(s, d):
    return event_log(s, d).groupBy("flush").agg((F.count_distinct("key") * 16).alias("bytes"))


@query("flush_runs", "SELECT flush, count(DISTINCT key)::BIGINT AS pairs, min(key) AS min_key, max(key) AS max_key FROM log GROUP BY flush")
def flush_runs(s, d):
    return event_log(s, d).groupBy("flush").agg(F.count_distinct("key").alias("pairs"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("run_manifest", "SELECT level::INT AS level, run::BIGINT AS run, pairs, min_key, max_key, ceil(pairs / 256.0)::BIGINT AS pages FROM runs")
def run_manifest(s, d):
    return layout.runs(event_log(s, d))


@query("run_prune", "SELECT level::INT AS level, run::BIGINT AS run FROM runs WHERE min_key <= 5 AND max_key >= 0")
def run_prune(s, d):
    return layout.runs(event_log(s, d)).where("min_key <= 5 and max_key >= 0").select("level", "run")


@query("lsm_levels", "SELECT level::INT AS level, count(DISTINCT flush)::BIGINT AS flushes, count(DISTINCT run)::BIGINT AS runs, count(*)::BIGINT AS versions FROM located GROUP BY level")
def lsm_levels(s, d):
    return layout.with_levels(event_log(s, d)).groupBy("level").agg(F.count_distinct("flush").alias("flushes"), F.count_distinct("run").alias("runs"), F.count("*").alias("versions"))


@query("merge_keep_tombstones", "SELECT key, value, deleted, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE flush < 3) WHERE rn = 1")
def merge_keep_tombstones(s, d):
    log = event_log(s, d)
    return read.merge([log.where(f"flush = {k}") for k in range(3)], False).select("key", "value", "deleted", "seq")


@query("merge_drop_tombstones", "SELECT key, value, seq FROM live")
def merge_drop_tombstones(s, d):
    log = event_log(s, d)
    return read.merge([log.where("flush % 2 = 0"), log.where("flush % 2 = 1")], True).select("key", "value", "seq")


@query("resolve_by_level_order", "SELECT key, value FROM live")
def resolve_by_level_order(s, d):
    return read.resolve_by_place(layout.with_levels(event_log(s, d))).select("key", "value")


@query("btree_leaf_dir", "SELECT page::BIGINT AS page, max_key, pairs::BIGINT AS pairs FROM leaf")
def btree_leaf_dir(s, d):
    return layout.leaves(read.resolve(event_log(s, d)))


@query("btree_internal", "SELECT node::BIGINT AS node, max_key, children::BIGINT AS children FROM node")
def btree_internal(s, d):
    return layout.internal(layout.leaves(read.resolve(event_log(s, d))))


@query("btree_root", "SELECT node::BIGINT AS position, max_key AS root_key FROM node")
def btree_root(s, d):
    return layout.internal(layout.leaves(read.resolve(event_log(s, d)))).select(F.col("node").alias("position"), F.col("max_key").alias("root_key"))


@query("header_pages", "SELECT (1 + count(*))::BIGINT AS pages FROM node")
def header_pages(s, d):
    return layout.internal(layout.leaves(read.resolve(event_log(s, d)))).agg((F.count("*") + 1).alias("pages"))


def _bound(name: str, column: str, how: str) -> None:
    @query(name, f"SELECT key, (SELECT {how} FROM live WHERE live.key {'<=' if column == 'floor_key' else '>=' if column == 'lower_key' else '>'} asked.key) AS {column} FROM asked")
    def _(s, d):
        return read.bounds(event_log(s, d), _asked(s)).select("key", column)


_bound("floor_lookup", "floor_key", "max(live.key)")
_bound("lower_bound", "lower_key", "min(live.key)")
_bound("upper_bound", "upper_key", "min(live.key)")


@query(
    "lru_hits",
    "SELECT access_no, page_id, prev IS NOT NULL AND (SELECT count(DISTINCT b.page_id) FROM tr b WHERE b.access_no > a.prev AND b.access_no < a.access_no) < 64 AS hit FROM (SELECT *, lag(access_no) OVER (PARTITION BY page_id ORDER BY access_no) AS prev FROM tr) a",
    head="WITH tr AS (SELECT event_id AS access_no, (user_id * 10 + event_id % 10) // 8 AS page_id FROM events)\n",
)
def lru_hits(s, d):
    return layout.lru_hits(event_log(s, d).select(F.col("seq").alias("access_no"), F.expr("key div 8").alias("page_id")), 64)


@query("flooding_decision", "SELECT qid, (hi * qid - lo + 1) >= 64 * 256 OR (hi * qid - lo + 1) < 0 AS floods FROM ranges")
def flooding_decision(s, d):
    return _ranges(s).select("qid", read.floods(F.col("lo"), F.col("hi") * F.col("qid")).alias("floods"))


@query("read_amplification", "SELECT key, count(runs.level)::BIGINT AS candidate_runs FROM asked LEFT JOIN runs ON key BETWEEN min_key AND max_key GROUP BY key")
def read_amplification(s, d):
    runs = layout.runs(event_log(s, d)).select("min_key", "max_key")
    starts = runs.select(F.col("min_key").alias("p"), F.lit(1).alias("w")).unionByName(runs.select((F.col("max_key") + 1).alias("p"), F.lit(-1).alias("w")))
    steps = starts.groupBy("p").agg(F.sum("w").alias("w"))  # as many as runs, not keys
    return _asked(s).join(F.broadcast(steps), F.col("p") <= F.col("key"), "left").groupBy("key").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("candidate_runs"))


@query("space_amplification", "SELECT level::INT AS level, count(*)::BIGINT AS versions, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM live WHERE live.seq = located.seq))::BIGINT AS live FROM located GROUP BY level")
def space_amplification(s, d):
    log = layout.with_levels(event_log(s, d))
    live = read.resolve(event_log(s, d)).select("seq", F.lit(1).alias("one"))
    return log.join(live, "seq", "left").groupBy("level").agg(F.count("*").alias("versions"), F.count("one").alias("live"))


@query("write_amplification", "SELECT (sum(level) + count(*))::BIGINT AS pairs_written, count(*)::BIGINT AS pairs_put FROM located")
def write_amplification(s, d):
    return layout.with_levels(event_log(s, d)).agg((F.sum("level") + F.count("*")).cast("long").alias("pairs_written"), F.count("*").alias("pairs_put"))


@query("uniform_keys", None)
def uniform_keys(s, d):
    n = s.read.parquet(f"{d}/events.parquet").count()
    return s.range(n).select(F.floor(F.rand(7) * 1_000_000_000 + 1).alias("key")).select("key", F.col("key").alias("value"))


def generated_queries(keys: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` of the keys, shuffled; the same for the same seed."""
    return keys.select("key").orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n)
