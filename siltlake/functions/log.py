"""The version log: schema, the tombstone sentinel, and logs made of other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: What stands for a deletion at the interface of single puts, as in the key-value form.
TOMBSTONE = -(2**63)

VERSION = T.StructType(
    [
        T.StructField("key", T.LongType(), False),
        T.StructField("value", T.LongType(), True),  # null iff deleted
        T.StructField("deleted", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)


def from_sentinel(df: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """(key, value, seq) with sentinels or nulls to versions: a sentinel is a deletion."""
    gone = F.col(value).isNull() | (F.col(value) == TOMBSTONE)
    return df.select(F.col(key).cast("long").alias("key"), F.when(~gone, F.col(value).cast("long")).alias("value"), gone.alias("deleted"), F.col(seq).cast("long").alias("seq"))


def raw_value(value: str = "value", deleted: str = "deleted") -> Column:
    return F.when(F.col(deleted), F.lit(TOMBSTONE)).otherwise(F.col(value))


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("long")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions from ``events``, errors as deletions, a flush of 100 versions each."""
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") * 10 + F.col("event_id") % 10).alias("key"),
        F.when(~gone, cents("value")).alias("value"),
        gone.alias("deleted"),
        F.col("event_id").alias("seq"),
        F.expr("event_id div 100").alias("flush"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("key"), cents("o_totalprice").alias("value"), F.lit(False).alias("deleted"), F.col("o_orderkey").alias("seq")
    )
