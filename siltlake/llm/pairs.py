"""Comparing the rows of buckets of any size, without emitting pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

SALTS = 16


def cells(rows: DataFrame, total: int, block: int = 1024, shard_rows: int = 20_000) -> DataFrame:
    """``rows`` (bucket long, id long, ...) with shard, a, b, part: the group to be
    compared in one task.

    Small buckets go, many together, to ``total / shard_rows`` shards (a = b = -1).
    A bucket over ``block`` rows is cut into parts by hash, and each pair of parts is
    a group of its own: its rows are sent once for each part, and no group holds
    more than about two parts.  Sizes come from a count by bucket; they are joined
    back under a salt, so that no task gets a whole hot bucket.
    """
    shards = max(1, -(-total // shard_rows))
    big = rows.groupBy("bucket").count().where(F.col("count") > block)
    big = big.select("bucket", F.ceil(F.col("count") / block).cast("int").alias("cut"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    r = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(big, ["bucket", "salt"], "left")
    r = r.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("cut")).cast("int"), F.lit(-1)))
    r = r.withColumn("other", F.explode(F.when(F.col("cut").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("cut") - 1))))
    return r.select(
        *rows.columns,
        "part",
        F.when(F.col("cut").isNull(), F.pmod("bucket", F.lit(shards))).otherwise(F.col("bucket")).alias("shard"),
        F.least("part", "other").alias("a"),
        F.greatest("part", "other").alias("b"),
    )


def within(bucket: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal ``bucket`` (sorted), some at a time."""
    n = len(bucket)
    if not n:
        return
    end = np.searchsorted(bucket, bucket, side="right")
    i, d = np.arange(n), 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    while len(i := i[i + d < end[i]]):
        held.append((i, i + d))
        size += len(i)
        if size >= most:
            yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held, size = [], 0
        d += 1
    if held:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def across(left: np.ndarray, right: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of two parts, some at a time."""
    step = max(1, most // max(1, len(right)))
    for k in range(0, len(left), step):
        x = left[k : k + step]
        yield np.repeat(x, len(right)), np.tile(right, len(x))


def joined(n: int, links: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of n rows reaches over links within this group."""
    lab = np.empty(n, "i8")
    order = np.argsort(ids, kind="stable")
    lab[order] = np.arange(n)  # labels are ranks of ids
    by_rank = ids[order]
    if links:
        i, j = np.concatenate([x for x, _ in links]), np.concatenate([x for _, x in links])
        while True:
            low = np.minimum(lab[i], lab[j])
            new = lab.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = np.minimum(new, new[order[new]])  # jump to the label's own label
            if (new == lab).all():
                break
            lab = new
    return by_rank[lab]
