"""Connected components without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id of ``edges`` (src, dst); component is the smallest
    id reachable.

    Star contraction on links that point from the larger id to the smaller one.
    A round lets the targets of an id point to the smallest of them (keyed by the
    source, which has few targets), then lets every link jump over its target's
    target.  The jump joins two checkpointed tables, so a star with a third of all
    ids is a skewed sort-merge join, which adaptive execution splits.  Null ids and
    self links are ignored; an empty table gives an empty result.
    """
    e = (
        edges.select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("m"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct()
    )
    e = checkpointed(e)
    for _ in range(rounds):
        t = e.groupBy("v").agg(F.min("m").alias("t"), F.count("*").alias("n"))
        t = checkpointed(t)
        more = e.join(t.where("n > 1").select("v", "t"), "v").where("m <> t").select(F.col("m").alias("v"), F.col("t").alias("m"))
        small = checkpointed(t.select("v", F.col("t").alias("m")).unionByName(more).distinct())
        up = checkpointed(small.groupBy("v").agg(F.min("m").alias("up")))
        deep = small.join(up.select(F.col("v").alias("m"), "up"), "m", "left")
        e = checkpointed(
            deep.select("v", F.coalesce("up", "m").alias("m"), F.col("up").isNotNull().alias("moved"))
        )
        if e.agg(F.max("moved"), F.count("*") - F.count_distinct("v")).first() in ((None, 0), (False, 0)):
            return e.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(
                e.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct()
            )
        e = checkpointed(e.select("v", "m").distinct())
    raise RuntimeError("components did not settle")
