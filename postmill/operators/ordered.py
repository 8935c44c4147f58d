"""Ordered computations per key that stay parallel when one key holds most of the rows.

A window over `partitionBy(key)` puts a whole key into one task. Here rows are range
partitioned by key and order, so a hot key spans many segments; each segment is summarised
on its own and only the small segment summaries are combined per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import cut

SEGMENT = "_segment"


def with_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add a segment number that grows with (keys, order); no row order is lost across segments."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(count, *keys, *order).withColumn(SEGMENT, F.spark_partition_id())


def _local(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SEGMENT).orderBy(*order)


def _carry_window(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SEGMENT)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 1, descending: bool = True) -> DataFrame:
    """First `n` rows per key by `order`. The rank filter is applied before and after the shuffle."""
    columns = [F.desc(c) if descending else F.asc(c) for c in order]
    return (
        df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def trailing_streak(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, reset: Column, name: str = "streak"
) -> DataFrame:
    """Per key: how many hits came after the last reset. Two aggregations, no per-key window."""
    rows = df.select(*keys, F.struct(*order).alias("_at"), hit.alias("_hit"), reset.alias("_reset"))
    last = rows.groupBy(*keys).agg(F.max(F.when(F.col("_reset"), F.col("_at"))).alias("_last"))
    joined = rows.join(last, on=list(keys))
    after = F.col("_last").isNull() | (F.col("_at") > F.col("_last"))
    return joined.groupBy(*keys).agg(F.count_if(F.col("_hit") & after).alias(name))


def running_streak(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, reset: Column, name: str = "streak"
) -> DataFrame:
    """Per row: hits since the last reset, up to and including the row."""
    rows = cut(with_segments(df.withColumn("_hit", hit).withColumn("_reset", reset), keys, order))
    span = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    island = Window.partitionBy(*keys, SEGMENT, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_island", F.sum(F.col("_reset").cast("long")).over(span)).withColumn(
        "_local", F.sum((F.col("_hit") & ~F.col("_reset")).cast("long")).over(island)
    )
    ends = local.groupBy(*keys, SEGMENT).agg(
        F.max("_island").alias("_resets"), F.max_by("_local", F.struct(*order)).alias("_trailing")
    )
    carried = (
        ends.withColumn("_epoch", F.sum((F.col("_resets") > 0).cast("long")).over(
            _carry_window(keys).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_at_end", F.sum("_trailing").over(
            Window.partitionBy(*keys, "_epoch").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_carry", F.coalesce(F.lag("_at_end").over(_carry_window(keys)), F.lit(0)))
        .select(*keys, SEGMENT, "_carry")
    )
    return (
        local.join(carried, on=[*keys, SEGMENT])
        .withColumn(name, F.col("_local") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0))
        .drop(SEGMENT, "_hit", "_reset", "_island", "_local", "_carry")
    )


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "previous"
) -> DataFrame:
    """Per row: the newest non-null `value` of an earlier row of the same key (as-of, never the row itself)."""
    rows = cut(with_segments(df.withColumn("_value", value), keys, order))
    before = _local(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(before))
    carried = (
        rows.groupBy(*keys, SEGMENT)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_newest"))
        .withColumn("_carry", F.last("_newest", ignorenulls=True).over(
            _carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, SEGMENT, "_carry")
    )
    return (
        local.join(carried, on=[*keys, SEGMENT])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop(SEGMENT, "_value", "_local", "_carry")
    )


def decayed_level(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ok: Column,
    keep: float = 0.7, gain: float = 0.3, start: float = 0.5, name: str = "level",
) -> DataFrame:
    """Final value per key of the fold level <- keep * level + gain * ok.

    The fold is linear, so every segment reduces to a decay factor and an offset; segments are
    then applied in order through a suffix sum of their lengths.
    """
    rows = with_segments(df.select(*keys, *order, ok.cast("double").alias("_ok")), keys, order)
    backwards = Window.partitionBy(*keys, SEGMENT).orderBy(*[F.desc(c) for c in order])
    local = (
        rows.withColumn("_age", F.row_number().over(backwards) - 1)
        .groupBy(*keys, SEGMENT)
        .agg(F.count("*").alias("_n"), F.sum(F.lit(gain) * F.col("_ok") * F.pow(F.lit(keep), F.col("_age"))).alias("_offset"))
    )
    later = Window.partitionBy(*keys).orderBy(F.desc(SEGMENT)).rowsBetween(Window.unboundedPreceding, -1)
    return (
        local.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0)))
        .groupBy(*keys)
        .agg(
            (
                F.sum(F.col("_offset") * F.pow(F.lit(keep), F.col("_after")))
                + F.lit(start) * F.pow(F.lit(keep), F.sum("_n"))
            ).alias(name)
        )
    )


def first_n_flag(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: Column | int, name: str = "within"
) -> DataFrame:
    """Flag the first `n` rows per key. Ranks run over segments, so a hot key stays spread out."""
    names = []
    for i, column in enumerate(order):
        df = df.withColumn(f"_o{i}", column)
        names.append(f"_o{i}")
    rows = cut(with_segments(df, keys, names))
    local = rows.withColumn("_pos", F.row_number().over(_local(keys, names)))
    before = (
        rows.groupBy(*keys, SEGMENT).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(_carry_window(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*keys, SEGMENT, "_before")
    )
    return (
        local.join(before, on=[*keys, SEGMENT])
        .withColumn("_pos", F.col("_pos") + F.col("_before"))
        .withColumn(name, F.col("_pos") <= n)
        .drop(SEGMENT, "_before", "_pos", *names)
    )
