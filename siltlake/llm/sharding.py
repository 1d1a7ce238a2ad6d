"""Operator 10: shards along a Hilbert curve over quantised metadata (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table

BITS = 4  # per dimension
DIMS = 3
SHARDS = 16
RUNS = 10  # bits: runs that one curve cell is cut into, by the highest bits of the text's crc32
SALT = 64  # parts that the copies of one text are numbered in, by id


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a point on the Hilbert curve (Skilling's transform, AIP 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def curve(bits: int = BITS, dims: int = DIMS) -> list[int]:
    """Curve index of every cell, in the order of the cell's row-major number."""
    mask = (1 << bits) - 1
    return [hilbert_index(tuple(c >> bits * (dims - 1 - d) & mask for d in range(dims)), bits) for c in range(1 << bits * dims)]


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """Curve index as a column: the table of the (few) cells is a literal."""
    number = F.lit(0)
    for c in cells:
        number = number * (1 << bits) + c
    return F.element_at(F.lit(curve(bits, len(cells))), (number + 1).cast("int"))


def category(col: str, bits: int = BITS) -> Column:
    """A string's cell: crc32 modulo the cells, so that new values need no table."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % (1 << bits)


def log_length(size: Column, bits: int = BITS) -> Column:
    """Cell of a length: its power of two, the last cell holding all longer ones."""
    top = (1 << bits) - 1
    return sum((F.when(size >= (1 << (k + 3)), 1).otherwise(0) for k in range(1, top + 1)), F.lit(0))


def placed(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """The columns of ``shard``; ``whole``: with ``_row``, a struct of all columns of the
    row, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    cells = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *(category(c).alias(f"_{c}") if c in docs.columns else F.lit(0).alias(f"_{c}") for c in ("lang", "source")),
        *([F.struct(*docs.columns).alias("_row")] if whole else []),
    )
    salt = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % SALT
    key = ["hilbert", "text_crc32", "salt"]
    rows = cells.select("doc_id", "size", "text_crc32", hilbert([F.col("_lang"), F.col("_source"), log_length(F.col("size"))]).alias("hilbert"), salt.alias("salt"), *(["_row"] if whole else []))
    run = F.shiftright("text_crc32", 32 - RUNS).alias("run")
    parts = rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("run", run)
    runs = parts.groupBy("hilbert", "run").agg(F.sum("n").alias("run_n"))
    by_cell = runs.groupBy("hilbert").agg(F.sum("run_n").alias("cell_n"))
    before = W.orderBy("hilbert").rowsBetween(W.unboundedPreceding, -1)
    cells_at = by_cell.select(
        "hilbert",
        F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("cell_at"),
        F.sum("cell_n").over(W.partitionBy(F.lit(0))).alias("total"),
    )
    in_cell = W.partitionBy("hilbert").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs_at = (
        runs.withColumn("in_cell", F.coalesce(F.sum("run_n").over(in_cell), F.lit(0)))
        .join(cells_at, "hilbert")
        .select("hilbert", "run", (F.col("cell_at") + F.col("in_cell")).alias("run_at"), "total")
    )
    in_run = W.partitionBy("hilbert", "run").orderBy("text_crc32", "salt").rowsBetween(W.unboundedPreceding, -1)
    at = parts.withColumn("in_run", F.coalesce(F.sum("n").over(in_run), F.lit(0))).join(runs_at, ["hilbert", "run"]).select(*key, (F.col("run_at") + F.col("in_run")).alias("at"), "total")
    nth = F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "size"))
    ranked = rows.withColumn("nth", nth).join(at, key).withColumn("rank", F.col("at") + F.col("nth") - 1)
    of = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards} - 1) div {shards}")
    return (
        ranked.withColumn("shard", of.cast("int"))
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", *(["_row"] if whole else []))
    )


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and hilbert.

    Order: curve index of (language, source, length class), then crc32 of the text, a
    part number (crc32 of the id), id, size.  So copies (equal texts of one cell) are
    neighbours, and only the cut between two shards can part them: the law is on rows,
    and a group of copies of any size is cut like other rows.  The global rank comes
    from counts: of cells and of their runs (two window sums over bounded tables), of
    texts within a run, and row_number among the copies of one part.  No task sees a
    whole cell or all copies of a text, and nothing is sorted globally; rows that are
    alike in text and id are numbered together.  ``shard = rank * shards div rows``:
    law ``rows``, counts at most one apart; ``slot`` counts from 0 in each shard.

    Nulls: a null text has no bytes (size 1, crc32 0); null lang or source is the
    empty string's cell; null ids sort first and are placed like others.  Repeated
    rows each get a slot of their own.  An empty table gives no rows.  Further
    columns of the input are ignored.
    """
    return placed(docs, shards, id_col, text_col)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", file_rows: int = 100_000) -> None:
    """The rows, with all their columns, as Parquet files of up to ``file_rows``, in a
    folder for each shard (``_shard=``), each sorted along the curve, so that file
    statistics prune on language, source and length together.  Rows are handled as in
    ``shard``; none is joined by its id, so ids may be null or repeat."""
    rows = placed(docs, shards, id_col, text_col, whole=True).select("shard", "slot", F.expr(f"slot div {file_rows}").alias("file"), "_row")
    n = max(1, rows.select("shard", "file").distinct().count())
    rows.repartition(n, "shard", "file").sortWithinPartitions("shard", "file", "slot").select("_row.*", F.col("shard").alias("_shard")).write.option("maxRecordsPerFile", file_rows).partitionBy("_shard").parquet(path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def _sql() -> str:
    """The same law and the same places, in DuckDB: crc32 as a fold over the bytes,
    the global rank as one row_number."""
    crc = "[" + ",".join(map(str, _crc_table())) + "]::UBIGINT[]"
    crc = f"({crc})"

    def of(x: str) -> str:
        return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: ('0x' || h)::UBIGINT)),
            lambda c, b: xor(c >> 8, {crc}[(xor(c, b) & 255::UBIGINT)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"""

    classes = " + ".join(f"(size >= {1 << (k + 3)})::INT" for k in range(1, 1 << BITS))
    return f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {of("coalesce(text, '')")} AS text_crc32,
         {of("coalesce(lang, '')")} % {1 << BITS} AS a, {of("coalesce(source, '')")} % {1 << BITS} AS b, {of("coalesce(doc_id::VARCHAR, '')")} % {SALT} AS salt
  FROM documents),
h AS (SELECT *, [{",".join(map(str, curve()))}][(a * {1 << 2 * BITS} + b * {1 << BITS} + ({classes}) + 1)::BIGINT] AS hilbert FROM r),
k AS (SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, salt, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () AS total FROM h),
s AS (SELECT *, (rank * {SHARDS}) // total AS shard FROM k)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard,
       (rank - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, hilbert::INT AS hilbert
FROM s"""


QUERIES = {"op10_hilbert_sharding": op10}
ORACLE_SQL = {"op10_hilbert_sharding": _sql()}
