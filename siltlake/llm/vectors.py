"""Vectors between Arrow lists and bytes of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def doubles(col: pa.Array) -> list[np.ndarray | None]:
    """Each list as doubles; None where it is null or holds null or non-finite values."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.array([0 if n is None else n for n in col.value_lengths().to_pylist()], "i8")
    flat = col.flatten()
    values = np.asarray(flat.to_numpy(zero_copy_only=False), "f8") if len(flat) else np.zeros(0)
    values = values + 0.0  # one zero
    ends = np.cumsum(lens)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    null = col.is_null().to_pylist()
    return [None if z or bad[e] > bad[e - n] else values[e - n : e] for z, n, e in zip(null, lens.tolist(), ends.tolist(), strict=True)]


def packed(v: np.ndarray) -> bytes:
    """A vector in four bytes a component if that is exact, else in eight; equal vectors
    are equal bytes."""
    with np.errstate(over="ignore"):
        half = v.astype("<f4")
    return b"\x04" + half.tobytes() if (half == v).all() else b"\x08" + v.astype("<f8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[0] == 4 else "<f8", offset=1).astype("f8")


def dimension(data: bytes) -> int:
    return (len(data) - 1) // data[0]


def as_bytes(df: DataFrame, column: str, carry: list[str], make=lambda v: v) -> DataFrame:
    """carry columns and vec: ``make`` of each vector, packed; null where that or the
    vector is None."""
    names = [*carry, "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if v is None else make(v) for v in doubles(b.column(0))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([None if v is None else packed(v) for v in made], pa.binary())], names=names)

    return df.select(F.col(column).alias("_vector"), *carry).mapInArrow(run, df.select(*carry).schema.add("vec", "binary"))
