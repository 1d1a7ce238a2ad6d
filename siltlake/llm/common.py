"""What the training-data operators share: the shared folder, written tables, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on a local master, where the cluster names none, a temporary one is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="siltlake-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here
    and a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete every table that ``written`` made in this process; results that still
    read them must be stored first."""
    n = 0
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables of loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, as texts may be long once they are Python's.
    (The session's limit on a batch's bytes bounds what Spark sends at once.)"""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows in this session, so that executors hold few texts at once.
    For programs, which own their session (the registered queries, the pipeline);
    operators leave it alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(k)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(values, level: int = 1) -> bytes:
    """A numpy array, its byte planes one after another, compressed."""
    import zstandard

    return zstandard.compress(values.reshape(-1, 1).view("u1").T.tobytes() if len(values) else b"", level)


def unpack(blob: bytes, dtype: str):
    import numpy as np
    import zstandard

    raw, width = zstandard.decompress(blob), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(width, -1).T).reshape(-1).view(dtype)
