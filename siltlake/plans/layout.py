"""Levels of the tree in closed form, pages of a run, cost of reads and merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.read import ranged

RATIO = 3
PAGE_PAIRS = 256
PER_LEVEL = [3, 9, 27, 81]  # runs that level 0..3 holds when it is merged away
FLUSHES = [1, 3, 27, 729, 59049]  # flushes in a run of each level


def level_of(flush: Column, n: Column) -> Column:
    """The level where a flush lies after n flushes."""
    out = F.lit(0)
    for level in (1, 2, 3, 4):
        size = FLUSHES[level]
        inside = flush < F.floor(n / size) * size
        out = F.when(inside, F.lit(level)).otherwise(out)
    return out


def run_of(flush: Column, level: Column) -> Column:
    """A run's number within its level, by its first flush (level 4 is one run)."""
    out = flush
    for k in (1, 2, 3):
        out = F.when(level == k, F.floor(flush / FLUSHES[k])).otherwise(out)
    return F.when(level == 4, F.lit(0)).otherwise(out).cast("long")


def run_counts(n: int) -> list[int]:
    return [n % 3, n // 3 % 9, n // 27 % 27, n // 729 % 81, int(n >= 59049)]


def with_levels(log: DataFrame) -> DataFrame:
    n = log.agg((F.max("flush") + 1).alias("n_flushes"))
    placed = log.join(F.broadcast(n)).withColumn("level", level_of(F.col("flush"), F.col("n_flushes")))
    return placed.withColumn("run", run_of(F.col("flush"), F.col("level")))


def runs(log: DataFrame) -> DataFrame:
    """Per (level, run): pairs, min_key, max_key, pages, of keys resolved within the run."""
    pairs = with_levels(log).groupBy("level", "run", "key").agg(F.max("seq").alias("seq"))
    return pairs.groupBy("level", "run").agg(F.count("*").alias("pairs"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.ceil(F.count("*") / PAGE_PAIRS).cast("long").alias("pages"))


def numbered(live: DataFrame) -> DataFrame:
    """live with rn, the 0-based rank of its key: counts by ranges of keys give where each
    starts, so only ranges are sorted, each by itself."""
    at = ranged(live)
    counts = at.groupBy("part").agg(F.count("*").alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("key"))
    return at.withColumn("nth", nth).join(F.broadcast(starts), "part").withColumn("rn", F.col("start") + F.col("nth") - 1).drop("part", "nth", "start")


def leaves(live: DataFrame) -> DataFrame:
    """page, max_key, pairs: leaf pages of 256 pairs."""
    return numbered(live).groupBy(F.expr(f"rn div {PAGE_PAIRS}").alias("page")).agg(F.max("key").alias("max_key"), F.count("*").alias("pairs"))


def internal(leaf: DataFrame) -> DataFrame:
    """node, max_key, children: 256 leaves a node."""
    return leaf.groupBy(F.expr(f"page div {PAGE_PAIRS}").alias("node")).agg(F.max("max_key").alias("max_key"), F.count("*").alias("children"))


def _last_pages(rows: DataFrame, by: str, capacity: int) -> DataFrame:
    """by, page_id, last: the ``capacity`` pages of each group that were used last."""
    last = rows.groupBy(by, "page_id").agg(F.max("last").alias("last"))
    nth = F.row_number().over(W.partitionBy(by).orderBy(F.desc("last")))
    return last.withColumn("nth", nth).where(F.col("nth") <= capacity).drop("nth")


def _states(rows: DataFrame, within: str, by: str, capacity: int) -> DataFrame:
    """(by, page_id, last): the pages in the cache before each group ``by`` of ``within``,
    of the groups' own last pages and, under a null ``by``, those from before all."""

    def ordered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = {}, []
        before = pdf[pdf[by].isna()].sort_values("last")
        for p, t in zip(before["page_id"], before["last"], strict=True):
            held[p] = t
        for g, own in pdf[pdf[by].notna()].sort_values("last").groupby(by, sort=True):
            out += [(int(g), p, t) for p, t in held.items()]
            for p, t in zip(own["page_id"], own["last"], strict=True):
                held.pop(p, None)
                held[p] = t
            while len(held) > capacity:
                del held[next(iter(held))]
        return pd.DataFrame(out, columns=[by, "page_id", "last"])

    return rows.groupBy(within).applyInPandas(ordered, f"{by} long, page_id long, last long")


def lru_hits(trace: DataFrame, capacity: int, chunk: int = 1 << 16, fan: int = 1 << 10) -> DataFrame:
    """access_no, page_id, hit of a trace of page accesses (numbers, each access once): a
    hit iff fewer than ``capacity`` different pages were seen since the page's last
    access, that is, iff the page is among the ``capacity`` used last.

    What a stretch of the trace leaves in the cache is its last ``capacity`` pages, and
    such summaries combine.  The trace is cut into chunks, and these into groups of
    ``fan``: groups give the cache before each group, groups and chunks that before
    each chunk, and each chunk is then run through by itself.  Linear in the trace; a
    task holds a chunk or ``fan`` summaries."""
    rows = trace.select(F.col("access_no").cast("long").alias("last"), F.col("page_id").cast("long").alias("page_id"))
    rows = rows.withColumn("chunk", F.floor(F.col("last") / chunk).cast("long")).withColumn("top", F.floor(F.col("last") / (chunk * fan)).cast("long"))
    chunks = _last_pages(rows, "chunk", capacity).withColumn("top", F.floor(F.col("chunk") / fan).cast("long"))
    tops = _last_pages(chunks, "top", capacity).withColumn("all", F.lit(0))
    before_top = _states(tops, "all", "top", capacity)
    none = F.lit(None).cast("long")
    before = _states(chunks.select("top", "chunk", "page_id", "last").unionByName(before_top.select("top", none.alias("chunk"), "page_id", "last")), "top", "chunk", capacity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("last")
        held, out = {}, []
        for t, p, own in zip(pdf["last"], pdf["page_id"], pdf["own"], strict=True):
            hit = held.pop(p, None) is not None
            held[p] = True
            if len(held) > capacity:
                del held[next(iter(held))]
            if own:
                out.append((t, p, hit))
        return pd.DataFrame(out, columns=["access_no", "page_id", "hit"])

    every = rows.select("chunk", "page_id", "last", F.lit(True).alias("own")).unionByName(before.select("chunk", "page_id", "last", F.lit(False).alias("own")))
    return every.groupBy("chunk").applyInPandas(run, "access_no long, page_id long, hit boolean")
