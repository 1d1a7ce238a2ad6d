"""Operator 1: embedding near-duplicates by iterative quantisation and multi-index tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, written
from .graph import components
from .pairs import across, cells, joined, within
from .vectors import as_bytes, dimension, unpacked

THRESHOLD = 0.93
SAMPLE = 20_000  # classes that the rotations are learnt from, at most
SAMPLE_BYTES = 64 << 20  # and bytes of theirs, about
LEARNT = 8  # dimensions that have a rotation of their own; vectors of others get a random one
BITS = 64
ROUNDS = 30
#: Settings: codes are cut into so many substrings (the second number), in one of which a
#: pair may differ by so many bits (the third).  Links that are found depend on it, so
#: the first holds at every size (it shows all that the second shows of 64 bits); others
#: are only used if a caller names them (the first number: classes they are meant for).
TABLES = ((1 << 21, 8, 0), (1 << 26, 4, 1), (1 << 62, 3, 2))
LINKS = 1 << 20


@dataclass
class Codes:
    """Centre, projection to principal axes times the learnt rotation."""

    mean: np.ndarray
    axes: np.ndarray

    def of(self, unit: np.ndarray) -> np.ndarray:
        b = (unit - self.mean) @ self.axes > 0
        return b.astype("u8") @ (np.uint64(1) << np.arange(b.shape[1], dtype="u8"))


def learn(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 1) -> Codes:
    """Iterative quantisation (Gong and Lazebnik, CVPR 2011): principal axes, then the
    rotation that brings the vectors closest to the corners of the cube."""
    mean = x.mean(0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :bits]
    v = c @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))
    for _ in range(rounds):
        s, _, t = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (s @ t).T
    return Codes(mean, axes @ r)


@dataclass
class Index:
    """The codes of each dimension."""

    learnt: dict[int, Codes] = field(default_factory=dict)

    def codes(self, dim: int) -> Codes:
        if dim not in self.learnt:
            self.learnt[dim] = Codes(np.zeros(dim), np.random.default_rng(dim).normal(size=(dim, min(dim, BITS))))
        return self.learnt[dim]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the square
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cuts(bits: int, tables: int) -> list[np.uint64]:
    """Masks of the substrings of a code."""
    edge = np.linspace(0, bits, min(tables, bits) + 1).astype(int)
    return [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(edge, edge[1:])]


def radius(bits: int) -> int:
    """Bits in which codes of a pair may differ: a cosine of 0.93 is 0.12 of them for
    random directions, with deviations of 0.04 at 64 bits and more at fewer."""
    return bits // 4 + 1


def first_tables(a: np.ndarray, b: np.ndarray, masks: list[np.uint64], errors: int) -> np.ndarray:
    """The first table that brings two codes together (len(masks): none does)."""
    alike = np.stack([np.bitwise_count((a ^ b) & m) <= errors for m in masks] + [np.ones(len(a), bool)])
    return alike.argmax(0)


def _candidates(group: dict[str, np.ndarray], a: int, b: int, tables: int, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a cell whose codes are near enough and that no earlier table shows."""
    bucket, part, code, home, dim, tab = (group[c] for c in ("bucket", "part", "code", "home", "dim", "tab"))
    masks = {d: cuts(min(d, BITS), tables) for d in set(dim.tolist())}
    order = np.argsort(bucket, kind="stable")
    pairs = ((order[i], order[j]) for i, j in within(bucket[order])) if a == b else across(np.flatnonzero(part == a), np.flatnonzero(part == b))
    for i, j in pairs:
        ok = (home[i] | home[j]) & (dim[i] == dim[j]) & (tab[i] == tab[j]) & (np.bitwise_count(code[i] ^ code[j]) <= np.minimum(dim[i], BITS) // 4 + 1)
        i, j = i[ok], j[ok]
        for d, m in masks.items():
            k = np.flatnonzero(dim[i] == d)
            k = k[first_tables(code[i[k]], code[j[k]], m, errors) == tab[i[k]]]
            if len(k):
                yield i[k], j[k]


def _columns(group: pa.Table) -> tuple[dict[str, np.ndarray], int, int]:
    x = {c: group.column(c).to_numpy() for c in ("bucket", "id", "part", "code", "dim", "tab")}
    x["code"] = x["code"].view("u8")
    x["home"] = np.asarray(group.column("home").to_numpy(zero_copy_only=False), bool)
    return x, group.column("a")[0].as_py(), group.column("b")[0].as_py()


def _surviving(tables: int, errors: int):
    """Rows of a cell that have a candidate there."""

    def run(group: pa.Table) -> pa.Table:
        x, a, b = _columns(group)
        some = np.zeros(len(x["id"]), bool)
        for i, j in _candidates(x, a, b, tables, errors):
            some[i] = some[j] = True
        return group.filter(pa.array(some)).select(["id", "code", "dim", "tab", "home", "bucket"])

    return run


def _rerank(threshold: float, tables: int, errors: int):
    """Candidates of a cell by the vectors themselves: for each row its links there, and
    the smallest node that it reaches."""

    def run(group: pa.Table) -> pa.Table:
        x, a, b = _columns(group)
        ids, label, weight = x["id"], group.column("label").to_numpy(), group.column("n").to_numpy()
        vec, dim = group.column("vec").to_pylist(), x["dim"]
        units, at = {}, np.zeros(len(ids), "i8")
        for d in set(dim.tolist()):
            own = np.flatnonzero(dim == d)
            at[own] = np.arange(len(own))
            units[d] = unit(np.stack([unpacked(vec[k]) for k in own.tolist()]))
        count, links, held = np.zeros(len(ids), "i8"), [], 0
        for i, j in _candidates(x, a, b, tables, errors):
            u, keep = units[int(dim[i[0]])], np.zeros(len(i), bool)
            for k in range(0, len(i), 20_000):
                s = slice(k, k + 20_000)
                keep[s] = np.einsum("ij,ij->i", u[at[i[s]]], u[at[j[s]]]) >= threshold
            keep &= label[i] == label[j]
            i, j = i[keep], j[keep]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            links.append((i, j))
            held += len(i)
            if held > LINKS:
                low = joined(len(ids), links, np.arange(len(ids)))
                links = [(np.arange(len(ids)), low)]
                held = 0
        low = joined(len(ids), links, ids)
        out = (count > 0) | (low != ids)
        return pa.table({"id": ids[out], "links": count[out], "low": low[out]})

    return run


def _code(index: Index, tables: int, errors: int):
    """A row for each table and class, in its own bucket; with ``errors``, also in the
    buckets that more bits set lead to (a pair needs to meet from one side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, label, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            dim = np.array([dimension(v) for v in vec], "i4")
            for d in sorted(set(dim.tolist())):
                own = np.flatnonzero(dim == d)
                code = index.codes(d).of(unit(np.stack([unpacked(vec[k]) for k in own.tolist()])))
                for t, mask in enumerate(cuts(min(d, BITS), tables)):
                    sub, who, home = code & mask, np.arange(len(own)), np.ones(len(own), bool)
                    for to, of in _probes(sub, mask, errors):
                        sub, who, home = np.append(sub, to), np.append(who, of), np.append(home, np.zeros(len(of), bool))
                    n = len(who)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[own[who]]), pa.array(label[own[who]]), pa.array(code[who].view("i8")), pa.array(np.full(n, d, "i4")), pa.array(np.full(n, t, "i4")), pa.array(home), pa.array(sub.view("i8"))],
                        names=["id", "label", "code", "dim", "tab", "home", "sub"],
                    )

    return run


def _probes(sub: np.ndarray, mask: np.uint64, errors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(substring, index of its owner) of the other buckets that a row goes to: its own
    with up to ``errors`` bits changed, of which the highest is set."""
    bits = [np.uint64(1 << k) for k in range(64) if int(mask) >> k & 1]
    if errors >= 1:
        for b in bits:
            of = np.flatnonzero(sub & b == 0)
            yield sub[of] | b, of
    if errors >= 2:
        for n, high in enumerate(bits):
            of = np.flatnonzero(sub & high == 0)
            for low in bits[:n]:
                yield (sub[of] | high) ^ low, of
    if errors > 2:
        raise ValueError("at most two bits are probed")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, block: int = 4096, tables: tuple[int, int] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows of one label and one number of components are compared by cosine in double
    precision.  Equal vectors of a label are one class, and only classes are compared:
    codes that share a substring in one of the tables (eight of them at every size, or
    as ``tables`` says, see ``TABLES``), then those within a Hamming ``radius``, and only for these the
    vectors.  Codes alone are sent to all tables; vectors follow where a row has a
    candidate.  A link counts in the first table that shows it.  The rotations are
    learnt from at most ``sample`` classes; the index holds every class.  Recall is
    held against brute force in the tests.  Buckets of any size are compared whole,
    in parts.

    A vector that is null, zero, empty, or holds null or non-finite values, or that
    has a null label, links with nothing: n_links 0, its own component.  A row with a
    null id takes part like others, counts in n_links, and gives its component no id.
    Rows that repeat an id are vectors each, with their own links.  Repeated rows
    link with one another.  An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = as_bytes(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")), "v", ["vec_id", "label"], lambda v: v if v.any() else None)
    rows = written(rows)
    classes = rows.where("vec is not null and label is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    total, widest = classes.agg(F.count("*"), F.max(F.length("vec"))).first()
    count, errors = tables or TABLES[0][1:]
    fit = [bytes(r["vec"]) for r in classes.orderBy(F.xxhash64("vec", "label"), "label", "vec").limit(min(sample, SAMPLE_BYTES // (widest or 1) + 2)).select("vec").collect()]
    by_dim: dict[int, list[bytes]] = {}
    for v in fit:
        by_dim.setdefault(dimension(v), []).append(v)
    common = sorted(by_dim, key=lambda d: (-len(by_dim[d]), d))[:LEARNT]
    index = Index({d: learn(unit(np.stack([unpacked(v) for v in by_dim[d]]))) for d in common if len(by_dim[d]) > 1})
    coded = classes.select("node", "label", "vec").mapInArrow(_code(index, count, errors), "id long, label long, code long, dim int, tab int, home boolean, sub long")
    tabled = written(coded.select("id", "code", "dim", "tab", "home", F.xxhash64("label", "dim", "tab", "sub").alias("bucket")))
    some = cells(tabled, total * count, block).groupBy("shard", "a", "b").applyInArrow(_surviving(count, errors), "id long, code long, dim int, tab int, home boolean, bucket long")
    some = some.distinct().join(classes.select(F.col("node").alias("id"), "label", "n", "vec"), "id")
    got = written(cells(written(some), total * 2, max(1, block // 4)).groupBy("shard", "a", "b").applyInArrow(_rerank(threshold, count, errors), "id long, links long, low long"))
    roots = components(got.select(F.col("id").alias("src"), F.col("low").alias("dst"))).select(F.col("id").alias("_c"), F.col("component").alias("root"))
    links = got.groupBy(F.col("id").alias("_l")).agg(F.sum("links").alias("links"))
    found = (
        classes.join(links, F.col("node") == F.col("_l"), "left")
        .join(roots, F.col("node") == F.col("_c"), "left")
        .select("id", F.col("label").alias("_label"), F.md5("vec").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    found = written(found)
    least = found.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component"))
    found = found.join(least, F.col("root") == F.col("_root")).select("_label", "_key", "n_links", "component")
    each = rows.select("vec_id", "label", F.md5("vec").alias("key")).join(found, (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_key")), "left")
    component = F.coalesce("component", "vec_id")
    return each.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Every pair of a label; it agrees as far as the index finds all links.
_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
l AS (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND a.good AND b.good AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
w AS (SELECT r, r AS at FROM v UNION SELECT w.r, l.b FROM w JOIN l ON w.at = l.a),
c AS (SELECT w.r, min(v.vec_id) AS component_id FROM w JOIN v ON w.at = v.r GROUP BY w.r),
n AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, vec_id IS NULL AND component_id IS NULL) AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""

QUERIES = {"op1_itq_near_vectors": op1}
ORACLE_SQL = {"op1_itq_near_vectors": _SQL}
