"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 50_000
BATCH_ROWS = 500


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's Arrow batches to BATCH_ROWS rows: long texts by the ten thousand, Spark's
    default, would fill a worker. A lower setting stays."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return df


def fresh(prefix: str) -> Callable[[str], str]:
    """Column names that no input column can clash with."""
    tag = uuid4().hex[:8]
    return lambda name: f"_{prefix}_{name}_{tag}"


def hash_pair(c: Column) -> tuple[Column, Column]:
    """128 bits in two longs; the second comes from another seed, so it is independent of the first."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def join_small(df: DataFrame, side: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a table that is small in practice but unbounded in principle; `side` must be cheap to count.

    Up to BROADCAST_ROWS rows, counted first, it is broadcast, so the large side isn't shuffled.
    Beyond that it is a shuffled join, in which Spark splits skewed partitions.
    """
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, keys, how)


def ranked(df: DataFrame, keys: list[str], salt: Column, name: str, salts: int) -> DataFrame:
    """Number the rows of each key from 0, without gaps, spreading a hot key over `salts` groups.

    Rows get their place within (key, salt); the counts of the salts before, at most `salts` rows
    a key, are added. Rows that agree on `salt` and key are interchangeable only if `df` is cut.
    """
    col = fresh("rank")
    s, n, before, order = col("salt"), col("n"), col("before"), col("order")
    salted = df.withColumn(order, salt).withColumn(s, F.pmod(F.col(order), F.lit(salts)))
    counts = salted.groupBy(*keys, s).agg(F.count("*").alias(n))
    by_salt = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, s, F.coalesce(F.sum(n).over(by_salt), F.lit(0)).alias(before))
    own = Window.partitionBy(*keys, s).orderBy(order)
    placed = salted.withColumn(n, F.row_number().over(own) - 1)
    return placed.join(offsets, [*keys, s]).withColumn(name, F.col(n) + F.col(before)).select(*df.columns, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: its lineage ends there, columns can be read alone."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
