"""Operator 9: SimHash near-duplicates through vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, small_batches, table, written
from .graph import components
from .pairs import joined

SHINGLE = 4
RADIUS = 4
SAMPLE = 32_768  # fingerprints that the tree of shards is built from, at most
SHARDS = (64, 4096)  # least and most leaves of that tree, about
SHARD_ROWS = 20_000  # fingerprints that a shard has at home, on average, between these
HOME = 100_000  # fingerprints that one task has at home, at most about
LEAF = 128  # fingerprints in a leaf of the tree within a shard
LINKS = 1 << 20  # links held before they are contracted
SEED = 42


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 of each of the text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined_, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k]).tolist()]
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(joined_[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    count = np.zeros(64, "i8")
    for at in range(0, len(h), 8192):
        count += np.unpackbits(h[at : at + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(count * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 of the text's word shingles."""
    return majority(shingles(text))


def fingerprints(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """carry columns and fp (the fingerprint's bits as a signed long)."""
    carry = carry or ["doc_id"]
    names = [*carry, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in b.column(0).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp)], names=names)

    return docs.select(F.col("text").alias("_hashed"), *carry).mapInArrow(run, docs.select(*carry).schema.add("fp", "long"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VPTree:
    """Vantage points and the distance that parts near from far.  Leaves are numbered,
    and hold the points that they were built from."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple[int, int, int, int]] = []  # point, limit, near child, far child; a leaf is ~number
        self.leaves: list[np.ndarray] = []
        self.points = points
        self.root = self._build(np.arange(len(points)), leaf)

    def _build(self, own: np.ndarray, leaf: int) -> int:
        points = self.points[own]
        if len(points) > leaf:
            # of a few candidates the point whose distances spread most
            some = points[:: max(1, len(points) // 8)][:8]
            d = [distance(points, p).astype("i8") for p in some]
            k = int(np.argmax([x.std() for x in d]))
            limit = int(np.median(d[k]))
            near = d[k] <= limit
            if near.all() and (d[k] < limit).any():
                limit, near = limit - 1, d[k] < limit
            if not near.all():
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                self.nodes[at] = (int(some[k]), limit, self._build(own[near], leaf), self._build(own[~near], leaf))
                return at
        self.leaves.append(own)
        return -len(self.leaves)

    def visits(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indices of ``points``): the leaves that may hold something within
        ``radius`` of a point.  By the triangle inequality a branch is passed over if
        the point lies more than ``radius`` on the other side of the limit; with
        radius 0 a point comes to one leaf, its home."""
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, i = todo.pop()
            if not len(i):
                continue
            if at < 0:
                yield -at - 1, i
                continue
            p, limit, near, far = self.nodes[at]
            d = distance(points[i], np.uint64(p)).astype("i8")
            todo += [(near, i[d - radius <= limit]), (far, i[d + radius > limit])]

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), "i8")
        for leaf, i in self.visits(points, 0):
            out[i] = leaf
        return out


def near_pairs(home: np.ndarray, tree: VPTree, asks: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of asks, index of home) of all pairs within ``radius``."""
    for leaf, i in tree.visits(asks, radius):
        own = tree.leaves[leaf]
        step = max(1, (1 << 18) // max(1, len(own)))
        for k in range(0, len(i), step):
            x, y = np.nonzero(distance(asks[i[k : k + step], None], home[own]) <= radius)
            yield i[k + x], own[y]


def _meet(radius: int, leaf: int):
    """One shard: what is at home, and what its boundary lets others look for there."""

    def run(group: pa.Table) -> pa.Table:
        home, asks = (np.frombuffer(b"".join(x for x in group.column(c).to_pylist() if x), "<u8") for c in ("home", "asks"))
        tree, links, held = VPTree(home, leaf), [], 0
        every = np.concatenate([home, asks])
        for shift, some in ((0, home), (len(home), asks)):
            for i, j in near_pairs(home, tree, some, radius):
                i = i + shift
                keep = i > j  # a pair within home is found from both sides
                links.append((i[keep], j[keep]))
                held += int(keep.sum())
                if held > LINKS:
                    links = contracted(len(every), links)
                    held = len(links[0][0])
        ids = every.view("i8")
        low = joined(len(ids), links, ids)
        out = low != ids
        return pa.table({"src": ids[out], "dst": low[out]})

    return run


def contracted(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of each of n rows to the first that it reaches."""
    low = joined(n, links, np.arange(n))
    out = np.flatnonzero(low != np.arange(n))
    return [(out, low[out])]


def links(classes: DataFrame, n: int, radius: int = RADIUS, leaf: int = LEAF, shard_rows: int = SHARD_ROWS, most_home: int = HOME) -> DataFrame:
    """(src, dst) over fingerprints: links that join what links of at most ``radius``
    differing bits join, for ``n`` different ones (column fp).

    A vantage-point tree, built from a bounded sample, parts the fingerprints by
    Hamming distance; each leaf is a shard, and every fingerprint has one home.  It
    also asks in the shards that its ball of ``radius`` overlaps, as far as these come
    after its home (a pair needs to be found from one side).  Within a shard a tree of
    what is at home prunes by the same bounds.  A shard with more than ``most_home``
    at home is cut, and is asked in each part.  Fingerprints travel packed.
    """
    least, most = SHARDS
    sample = np.unique(np.array([r["fp"] for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()], "i8").view("u8"))
    top = VPTree(sample, max(8, len(sample) // min(max(n // shard_rows, least), most)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf_, count = np.unique(top.home(b.column(0).to_numpy().view("u8")), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf_), pa.array(count)], names=["leaf", "n"])

    size = {r["leaf"]: r["n"] for r in classes.select("fp").mapInArrow(homes, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    cut = np.array([max(1, -(-size.get(k, 0) // most_home)) for k in range(len(top.leaves))], "i8")
    first = np.cumsum(cut) - cut

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view("u8")
            at = top.home(fp)
            own = first[at] + (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("i8") % cut[at]
            rows = []
            for x, i in top.visits(fp, radius):
                for cell in range(first[x], first[x] + cut[x]):
                    home, asks = fp[own == cell], fp[i[own[i] < cell]]
                    if len(home) or len(asks):
                        rows.append((cell, home.tobytes(), asks.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["cell", "home", "asks"])

    return classes.select("fp").mapInArrow(route, "cell long, home binary, asks binary").groupBy("cell").applyInArrow(_meet(radius, leaf), "src long, dst long")


def linked(prints: DataFrame, radius: int = RADIUS, **how) -> DataFrame:
    """(fp, component): each different fingerprint and the smallest doc_id that it
    reaches (null if there is none).  Fingerprints are linked by ``links``, and if one
    doc_id has several."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    near = links(classes, classes.count(), radius, **how)
    several = prints.where("doc_id is not null").groupBy(F.col("doc_id").alias("_of")).agg(F.min("fp").alias("dst"), F.max("fp").alias("high")).where("dst < high").select("_of", "dst")
    same_id = prints.join(several, F.col("doc_id") == F.col("_of")).select(F.col("fp").alias("src"), "dst")
    roots = components(near.unionByName(same_id)).select(F.col("id").alias("_fp"), F.col("component").alias("root"))
    rooted = written(classes.join(roots, classes["fp"] == F.col("_fp"), "left").select("fp", "id", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component"))
    return rooted.join(least, F.col("root") == F.col("_root")).select("fp", "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, carry: list[str] | None = None, **how) -> DataFrame:
    """doc_id, (carry), fp, component_id of every document.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles of four
    (all words, if fewer; none: fingerprint zero).  Documents with equal fingerprints
    are one class, and only classes are compared, through vantage-point trees
    (``links``; ``how`` has its sizes).

    Nulls: a null text has no words; a row with a null id has the component of its
    fingerprint, which is null if nothing there has an id.  Rows that repeat an id are
    one node, with the links of all its rows.  An empty table gives no rows; other
    columns are ignored.
    """
    carry = carry or []
    prints = written(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id", *carry]))
    of = linked(prints, radius, **how).withColumnRenamed("fp", "_fp")
    # rows and classes are both dealt by the fingerprint; a hot one is a skewed join
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", *carry, "fp", F.col("component").alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))


QUERIES = {"op9_simhash_vantage_trees": op9}
ORACLE_SQL: dict[str, str] = {}
