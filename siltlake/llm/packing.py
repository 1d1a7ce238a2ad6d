"""Operator 2: best-fit packing under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

CAPACITY = 2048  # words in a sequence
GROUP_DOCS = 4096  # documents that one task packs together, on average
SCHEMA = "doc_id long, piece int, start long, n_words long, bin_id long, bin_offset long, source string, cluster long"


class Bins:
    """Open bins ordered by residual.  Each carries a bitmap of its sources and one of
    its duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.sources, self.clusters = capacity, [], [], []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin that has room and neither bit set; the
        search goes from successor to successor until one is compatible."""
        order = self.order
        for k in range(bisect_left(order, (size, -1)), len(order)):
            residual, b = order[k]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del order[k]
                break
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if residual > size:
            insort(order, (residual - size, b))
        return b, self.capacity - residual


def pack_group(pieces: list[tuple[int, str | None, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster), placed in the given order.  A null
    source conflicts with nothing; nor does a cluster that occurs once."""
    seen: dict[int, int] = {}
    for _, _, c in pieces:
        seen[c] = seen.get(c, 0) + 1
    bit_s: dict[str, int] = {}
    bit_c: dict[int, int] = {}
    bins = Bins(capacity)
    return [
        bins.put(n, 0 if s is None else 1 << bit_s.setdefault(s, len(bit_s)), 1 << bit_c.setdefault(c, len(bit_c)) if seen[c] > 1 else 0)
        for n, s, c in pieces
    ]


def best_fit(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, cluster_col: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, n_words, bin_id, bin_offset, source, cluster.

    Lengths are counts of words (runs of other than ASCII white space).  A longer
    document than ``capacity`` is cut into pieces; no word is dropped.  No bin holds
    two pieces of one source or of one duplicate cluster (``cluster_col``, else equal
    texts).  Pieces go longest first (ties: doc_id, cluster, piece).  Documents are
    dealt by hash into groups whose number follows their count, and each group packs
    its own bins; a source with a third of all rows only means more bins.

    Nulls: a null or empty text has no pieces to place and gives one row with 0
    words and a null bin_id; a null source conflicts with no other; a null id is
    carried.  Repeated rows are in one cluster and so in different bins.  An empty
    table gives no rows.  Other columns are ignored.
    """
    n = docs.count()
    groups = max(1, -(-n // group_docs))
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.xxhash64("text")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        cluster.alias("cluster"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("words"),
    )
    dealt = sized.withColumn("g", F.pmod(F.xxhash64("doc_id", "cluster", "words"), F.lit(groups)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        full, rest, none = [], [], []
        for i, s, c, w in zip(pdf["doc_id"], pdf["source"], pdf["cluster"], pdf["words"], strict=True):
            i, s, c = None if pd.isna(i) else int(i), s if isinstance(s, str) else None, int(c) if c is not None and not pd.isna(c) else 0
            if not w:
                none.append((i, 0, 0, 0, None, None, s, c))
            for k in range(w // capacity):
                full.append((i, k, k * capacity, capacity, s, c))
            if w % capacity:
                rest.append((i, int(w // capacity), int(w - w % capacity), int(w % capacity), s, c))
        rest.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[5], r[1]))
        base, out = int(key[0]) << 32, []
        for (i, k, at, size, s, c), (b, off) in zip(rest, pack_group([(r[3], r[4], r[5]) for r in rest], capacity), strict=True):
            out.append((i, k, at, size, base + b, off, s, c))
        used = len({r[4] for r in out})
        out += [(i, k, at, size, base + used + m, 0, s, c) for m, (i, k, at, size, s, c) in enumerate(full)]
        return pd.DataFrame(out + none, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"doc_id": "Int64", "bin_id": "Int64", "bin_offset": "Int64"})

    return dealt.groupBy("g").applyInPandas(run, SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2}
ORACLE_SQL: dict[str, str] = {}
