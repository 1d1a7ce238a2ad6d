"""Operator 3: exact top-k inner products by norm buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import parts, table, written
from .vectors import as_bytes, unpacked

K = 20
EVERY = 20
SCALE = 64
BLOCK = 1 << 17  # candidates that one task compares, at most about
QUERIES_AT_ONCE = 1 << 16  # queries that it compares them with, at most about
BLOCKS_A_PART = 2  # blocks for each shuffle partition, at least
LONGEST = 2048  # vectors of a dimension that give the first thresholds
LONGEST_BYTES = 32 << 20
LONGEST_DIMS = 8
SCORES = 1 << 22  # held at once
BY_COORDINATE = 0.5  # least local cosine at which a coordinate prunes better than length
EXACT = float(1 << 53)


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * SCALE)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles; exact, and held to 64 bits."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q @ c.T).astype("i8")
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(c).T, -(1 << 63), (1 << 63) - 1).astype("i8")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties to the smaller id."""
    if len(score) > k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= low)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))][:k]


def retrieve(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the best k of one bucket that reach a query's floor.

    The local threshold of a query is the cosine that the longest candidate needs for
    the floor.  Above one, the bucket is passed over.  If it is high, the query's
    largest coordinate bounds that coordinate of the (normalised) candidate, and a
    sorted list gives those in range; else a candidate must be long enough.  What
    is left is multiplied out.
    """
    out: list[tuple[int, int, int]] = []
    length = np.sqrt((c * c).sum(1))
    order = np.argsort(-length, kind="stable")
    c, c_ids, length = c[order], c_ids[order], length[order]
    q_len = np.sqrt((q * q).sum(1))
    unit = c / np.maximum(length, 1e-300)[:, None]
    sorted_by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_len * length[0] > 0, floor / (q_len * length[0]), np.where(floor > 0, np.inf, -np.inf))
    dense = []
    for n in range(len(q)):
        t = local[n]
        if t > 1 + 1e-9:
            continue
        if t < BY_COORDINATE:
            dense.append(n)
            continue
        u = q[n] / q_len[n]
        f = int(np.argmax(np.abs(u)))
        if f not in sorted_by:
            o = np.argsort(unit[:, f], kind="stable")
            sorted_by[f] = o, unit[o, f]
        o, values = sorted_by[f]
        t = min(t, 1.0)
        spread = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
        # a cosine of at least t: the angle between the two and the coordinate's axis
        low = -np.inf if u[f] < -t else u[f] * t - spread
        high = np.inf if u[f] > t else u[f] * t + spread
        some = o[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, side="right")]
        _emit(out, n, q_ids[n], floor[n], products(q[n : n + 1], c[some])[0], c_ids[some], k)
    step = max(1, SCORES // max(1, len(c)))
    for at in range(0, len(dense), step):
        rows = np.array(dense[at : at + step])
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q_len[rows] > 0, floor[rows] / q_len[rows], -np.inf).min()
        long_enough = int(np.searchsorted(-length, -(need * (1 - 1e-9) - 1e-9), side="right"))
        scores = products(q[rows], c[:long_enough])
        for n, s in zip(rows.tolist(), scores, strict=True):
            _emit(out, n, q_ids[n], floor[n], s, c_ids[:long_enough], k)
    return out


def _emit(out: list, n: int, own: int, floor: float, score: np.ndarray, ids: np.ndarray, k: int) -> None:
    keep = np.flatnonzero((score >= floor) & (ids != own))
    for x in keep[best(score[keep], ids[keep], k)].tolist():
        out.append((n, int(ids[x]), int(score[x])))


def _first_floors(queries: np.ndarray, q_ids: np.ndarray, top: np.ndarray, top_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query its k-th best score among ``top``; minus infinity if there are
    fewer.  Where doubles don't hold a score, the floor is less, never more."""
    out = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        scores = products(queries[at : at + 256], top)
        for n, s in enumerate(scores, at):
            s = s[top_ids != q_ids[n]]
            if len(s) >= k:
                low = float(np.partition(s, len(s) - k)[len(s) - k])
                out[n] = low if abs(low) < EXACT else low - abs(low) * 2.0**-50
    return out


def search(df: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES_AT_ONCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, the ``k``
    largest integer inner products with all other rows of as many components, ties to
    the smaller id.

    Vectors are grouped by dimension and length (a bucket is an eighth of a doubling),
    and buckets cut into blocks by hash.  The longest vectors, a bounded number, give
    each query a first threshold: its k-th best among them.  A query is sent to the
    blocks of the buckets whose longest vector could reach that; candidates are sent
    once (once for every ``queries`` queries, if there are more).  A block is pruned by
    length or by a coordinate and the rest multiplied out; the k best of each block
    are ranked.  The number of buckets is bounded by the range of doubles, not by the
    rows.

    A vector that is null, empty, or holds null or non-finite values takes no part; nor
    does a row with a null id.  Rows with the query's id are its own.  Scores beyond 64
    bits are held at the limit.  Further rows that repeat an id are candidates each; a
    query's repeated rows are one query of each dimension (the first by bytes).  An
    empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = as_bytes(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), "v", ["vec_id"], lambda v: integers(v) if len(v) else None).where("vec is not null and vec_id is not null")
    rows = written(_with_length(rows))
    buckets = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("len").alias("most"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asks")).orderBy("dim", "bucket").collect()
    if not buckets:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = sum(r["n"] for r in buckets)
    size = max(1, min(block, -(-total // (BLOCKS_A_PART * parts(spark)))))
    held: dict[int, list[tuple[int, float, int, int]]] = {}  # of a dimension: bucket, longest, first block, blocks
    n_blocks = 0
    for r in buckets:
        held.setdefault(r["dim"], []).append((r["bucket"], r["most"], n_blocks, -(-r["n"] // size)))
        n_blocks += -(-r["n"] // size)
    n_q = max(1, -(-sum(r["asks"] for r in buckets) // queries))
    # the longest vectors of the dimensions with most rows; queries of others start without a floor
    top = {}
    room = LONGEST_BYTES
    for d in sorted(held, key=lambda d: -sum(r["n"] for r in buckets if r["dim"] == d)):
        most = min(LONGEST, room // (8 * d))
        if most < 1 or len(top) >= LONGEST_DIMS:
            break
        got = rows.where(F.col("dim") == d).orderBy(F.desc("len"), "vec_id", "vec").limit(most).select("vec_id", "vec").collect()
        top[d] = np.array([r["vec_id"] for r in got], "i8"), np.stack([unpacked(bytes(r["vec"])) for r in got])
        room -= 8 * d * len(got)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block that it has to look at."""
        for b in batches:
            ids, dims, vec = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for d in sorted(set(dims.tolist())):
                own = np.flatnonzero(dims == d)
                q = np.stack([unpacked(vec[n]) for n in own.tolist()])
                floor = _first_floors(q, ids[own], top[d][1], top[d][0], k) if d in top else np.full(len(own), -np.inf)
                with np.errstate(over="ignore"):
                    length = np.sqrt((q * q).sum(1))
                    for _, most, first, count in held[d]:
                        some = np.flatnonzero(length * most * (1 + 1e-9) + 1e-9 >= floor)
                        for at in range(first, first + count if len(some) else first):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, "i4")), pa.array(ids[own[some]]), pa.array([vec[n] for n in own[some].tolist()], pa.binary()), pa.array(floor[some])], names=["block", "vec_id", "vec", "floor"])

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("vec").alias("vec")).mapInArrow(ask, "block int, vec_id long, vec binary, floor double")
    where = spark.createDataFrame([(d, x, first, count) for d, of in held.items() for x, _, first, count in of], "dim int, bucket int, first int, count int")
    placed = rows.join(F.broadcast(where), ["dim", "bucket"]).select((F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("count"))).cast("int").alias("block"), "vec_id", "vec")
    both = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qb"), "block", F.lit(True).alias("asks"), "vec_id", "vec", "floor").unionByName(
        placed.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), "block", F.lit(False).alias("asks"), "vec_id", "vec", F.lit(None).cast("double").alias("floor"))
    )

    def meet(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").to_numpy(zero_copy_only=False), bool)
        ids, got = group.column("vec_id").to_numpy(), []
        if asks.any() and not asks.all():
            vec = np.stack([unpacked(v) for v in group.column("vec").to_pylist()])
            got = retrieve(vec[asks], ids[asks], group.column("floor").to_numpy(zero_copy_only=False)[asks], vec[~asks], ids[~asks], k)
        q_ids = ids[asks]
        return pa.table([pa.array([int(q_ids[n]) for n, _, _ in got], pa.int64()), pa.array([c for _, c, _ in got], pa.int64()), pa.array([s for *_, s in got], pa.int64())], names=["query_id", "vec_id", "score"])

    found = both.groupBy("qb", "block").applyInArrow(meet, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_length(rows: DataFrame) -> DataFrame:
    """len, dim, and bucket: an eighth of a doubling of the length (0 for the zero vector)."""

    def run(batches):
        for b in batches:
            vec = [unpacked(x) for x in b.column(1).to_pylist()]
            n = np.array([np.sqrt((v * v).sum()) for v in (v / 2.0**500 for v in vec)]) * 2.0**500
            with np.errstate(divide="ignore"):
                bucket = np.where(n > 0, np.floor(8 * np.log2(np.maximum(n, 1e-300))) + 10_000, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.minimum(n, np.finfo("f8").max)), pa.array(bucket.astype("i4")), pa.array(np.array([len(v) for v in vec], "i4"))], names=["vec_id", "vec", "len", "bucket", "dim"])

    return rows.mapInArrow(run, "vec_id long, vec binary, len double, bucket int, dim int")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op3_norm_bucket_topk": op3}
ORACLE_SQL = {"op3_norm_bucket_topk": _SQL}
