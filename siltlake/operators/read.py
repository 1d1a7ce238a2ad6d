"""Newest version wins, and the reads built on it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def resolve(log: DataFrame, drop_tombstones: bool = True) -> DataFrame:
    """key, value, deleted, seq of the newest version of each key.  Plain max_by keeps
    this a hash aggregate with partial sums; filters on the key pass below it, the
    one on deletions never does.  Versions of a key must differ in seq (``untied``
    makes them)."""
    newest = log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq"))
    return newest.where(~F.col("deleted")) if drop_tombstones else newest


def untied(log: DataFrame) -> DataFrame:
    """The newest version of each key of a batch whose order may have ties: of equal seq
    a value wins over a deletion, and the larger value over a smaller one."""
    newest = log.groupBy("key").agg(F.max(F.struct("seq", (~F.col("deleted")).alias("live"), "value")).alias("v"))
    return newest.select("key", F.col("v.value").alias("value"), (~F.col("v.live")).alias("deleted"), F.col("v.seq").alias("seq"))


def resolve_by_place(log: DataFrame) -> DataFrame:
    """The same by place: upper levels first, then the later run, then the later write."""
    w = W.partitionBy("key").orderBy("level", F.desc("flush"), F.desc("seq"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1 and not deleted").drop("rn", "deleted")


def scan(log: DataFrame, low: int, high: int) -> DataFrame:
    """key, value within [low, high], ascending.  low > high gives nothing."""
    return resolve(log.where(F.col("key").between(low, high))).select("key", "value").orderBy("key")


def scan_skipping(log: DataFrame, low: int, high: int) -> DataFrame:
    """The other reading of a deletion: it hides itself, not what is older."""
    return resolve(log.where(F.col("key").between(low, high) & ~F.col("deleted"))).select("key", "value").orderBy("key")


def raw_scan(log: DataFrame, low: int, high: int, raw: Column) -> DataFrame:
    """A memtable's range: deletions show as the sentinel."""
    return resolve(log.where(F.col("key").between(low, high)), False).select("key", raw.alias("value"))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, value, found of every key asked for.  The semi-join stands below the
    aggregate by hand, as the optimizer does not move it there."""
    asked = keys.select(F.col("key").cast("long").alias("key"))
    live = resolve(log.join(asked.distinct(), "key", "left_semi")).select("key", "value")
    return asked.join(live.withColumn("found", F.lit(True)), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def get(log: DataFrame, key: int) -> DataFrame:
    """One row: key, value, found.  The key reaches the file scan as a filter."""
    live = resolve(log.where(F.col("key") == key))
    return live.agg(F.lit(key).cast("long").alias("key"), F.max("value").alias("value"), (F.count("*") > 0).alias("found"))


def _cuts(keys: DataFrame, n: int) -> list[int]:
    """At most ``n - 1`` keys that part the rows evenly, about; approximate quantiles."""
    found = keys.where("key is not null").approxQuantile("key", [k / n for k in range(1, n)], 0.5 / n) if n > 1 else []
    return sorted({max(-(2**63), min(2**63 - 1, int(x))) for x in found})


def _part(key: Column, cuts: list[int], first: int = 0) -> Column:
    """Which of the ranges between ``cuts`` a key is in: a search tree of comparisons."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < F.lit(cuts[mid]), _part(key, cuts[:mid], first)).otherwise(_part(key, cuts[mid + 1 :], first + mid + 1))


def ranged(rows: DataFrame, keys: DataFrame | None = None, most: int = 256) -> DataFrame:
    """rows with part: ranges of ``key`` of about equal numbers of rows, in order, as many
    as there are shuffle partitions (``most`` at most).  Windows over what each part
    comes to see that many rows, whatever the keys are."""
    n = min(most, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.withColumn("part", _part(F.col("key"), _cuts(rows if keys is None else keys, n)).cast("int"))


def multi_scan(log: DataFrame, ranges: DataFrame) -> DataFrame:
    """qid, n, total of each range (qid, lo, hi) over the live keys.

    Both are differences of running totals at the two ends of a range, so a range costs
    the same whatever its width.  Keys and the different ends are dealt by ranges of
    keys and summed there; totals of the parts before are added.  A null or inverted
    range holds nothing; qid must be unique."""
    live = resolve(log).select("key", F.lit(1).alias("at"), "value")
    good = ranges.where("lo <= hi").select("qid", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    ends = good.select(F.explode(F.array(F.struct(F.col("lo").alias("key"), F.lit(0).alias("at")), F.struct(F.col("hi").alias("key"), F.lit(2).alias("at")))).alias("e")).select("e.*").distinct()
    asked = ends.select("key", "at", F.lit(None).cast("long").alias("value"))
    points = ranged(live.unionByName(asked), log.select("key").unionByName(asked.select("key")))
    one, value = F.when(F.col("at") == 1, 1).otherwise(0).cast("long"), F.coalesce("value", F.lit(0)).cast("decimal(38,0)")
    points = points.select("key", "at", "part", one.alias("one"), value.alias("value"))
    upto = W.partitionBy("part").orderBy("key", "at").rowsBetween(W.unboundedPreceding, 0)
    run = points.select("key", "at", "part", F.sum("one").over(upto).alias("n"), F.sum("value").over(upto).alias("v")).where("at <> 1")
    sums = points.groupBy("part").agg(F.sum("one").alias("pn"), F.sum("value").alias("pv"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"), F.coalesce(F.sum("pv").over(before), F.lit(0)).alias("bv"))
    at = run.join(F.broadcast(sums), "part").select("key", "at", (F.col("n") + F.col("bn")).alias("n"), (F.col("v") + F.col("bv")).alias("v"))
    low, high = (at.where(F.col("at") == k).select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("v").alias(f"{c}_v")) for k, c in ((0, "lo"), (2, "hi")))
    found = good.join(low, "lo").join(high, "hi").select("qid", (F.col("hi_n") - F.col("lo_n")).alias("n"), (F.col("hi_v") - F.col("lo_v")).cast("long").alias("total"))
    return ranges.select("qid").join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


def bounds(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, floor_key (last live key <= key), lower_key (first >= key), upper_key (first
    > key).  One pass over both, dealt by ranges of keys: within a part the neighbours
    are window sums, across parts they come from the parts' ends."""
    live = resolve(log).select("key", F.col("key").alias("at"), F.lit(False).alias("asks"))
    asked = keys.select(F.col("key").cast("long").alias("key"), F.lit(None).cast("long").alias("at"), F.lit(True).alias("asks"))
    both = ranged(live.unionByName(asked), log.select("key").unionByName(asked.select("key")))
    w = W.partitionBy("part").orderBy("key")
    down, up = w.rangeBetween(W.unboundedPreceding, 0), w.rangeBetween(0, W.unboundedFollowing)
    # the first key above: at a key's own rows that of the next different key
    steps = both.groupBy("part", "key").agg(F.max("at").alias("at"), F.sum(F.col("asks").cast("long")).alias("times"))
    near = steps.select("key", "part", "times", F.max("at").over(down).alias("f"), F.min("at").over(up).alias("l"), F.min("at").over(w.rowsBetween(1, W.unboundedFollowing)).alias("u")).where("times > 0")
    ends = steps.groupBy("part").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    o = W.orderBy("part")
    ends = ends.select("part", F.max("last").over(o.rowsBetween(W.unboundedPreceding, -1)).alias("pf"), F.min("first").over(o.rowsBetween(1, W.unboundedFollowing)).alias("nf"))
    found = near.join(F.broadcast(ends), "part").select("key", F.coalesce("f", "pf").alias("floor_key"), F.coalesce("l", "nf").alias("lower_key"), F.coalesce("u", "nf").alias("upper_key"))
    return keys.select(F.col("key").cast("long").alias("key")).join(found, "key")


def merge(runs: list[DataFrame], drop_tombstones: bool) -> DataFrame:
    """Several runs as one; deletions go only where nothing older is left."""
    return resolve(reduce(DataFrame.unionByName, runs), drop_tombstones)


def floods(low: Column, high: Column) -> Column:
    """Whether a range is wide enough (64 pages of 256 keys) to be kept out of a cache."""
    width = (high.cast("decimal(20,0)") - low.cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    return (width >= 64 * 256) | (width < 0)  # an inverted range wraps, as unsigned
