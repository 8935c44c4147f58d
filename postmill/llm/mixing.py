"""Mixing sources to target weights: water-filled targets, repetition rates, hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.common import fresh, join_small
from postmill.session import cut

WEIGHTS = (5, 2, 1)
TOTAL_RATIO = 1.5
MAX_REPEATS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked_sources(totals: DataFrame) -> DataFrame:
    """Sources numbered by code point, null last: ranges are numbered apart, then shifted by the counts before.

    Only one count per range meets in one task, not the sources.
    """
    flagged = totals.select(F.col("source").isNull().alias("none"), *totals.columns)
    parts = cut(flagged.repartitionByRange(F.col("none"), F.col("source")).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("start"))
    own = Window.partitionBy("part").orderBy("none", "source")
    return parts.join(starts, "part").select(
        *totals.columns, (F.col("start") + F.row_number().over(own) - 1).cast("long").alias("place")
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total_ratio: float = TOTAL_RATIO, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, size) rows to one row per source: source_size, weight, target, rate.

    The targets share total_ratio times all sizes by weight. A target above max_repeats times its source
    stops there and the excess is shared anew by weight until none is above: every round adds up, over
    all sources, what is fixed and the weights still open (one row each) and fixes more sources. A
    source without words gets the target 0 and the rate 0. Null is a source of its own.
    """
    if total_ratio > max_repeats:
        raise ValueError("total_ratio can't exceed max_repeats")
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    place = F.col("place") % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = cut(_ranked_sources(totals).select("source", "source_size", weight.alias("weight")))
    whole = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_repeats))
    level = None
    while True:  # the level, target per weight, only rises, so a fixed source stays fixed
        stopped = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        fixed, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))
        ).first()
        now = (whole * total_ratio - fixed) / open_weight if open_weight else level
        if now is None or level is not None and now <= level * (1 + 1e-12):
            break
        level = now
    target = F.least(cap, F.col("weight") * F.lit(float(level or 0.0)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return ranked.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 hash of seed, id and, for a null id only, the text."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digits = F.substr(F.md5(F.concat(F.lit(SEED + ":"), own).cast("binary")), F.lit(1), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` plus mix_size, mix_source_size, mix_target and mix_copies, one row per input row.

    copies = floor(rate) plus one with probability of the fraction, drawn from the id's hash: reruns agree,
    repeated rows draw alike, and no document is shuffled or moved. Sizes are summed map-side, so a hot
    source is a row per task. Rows of an empty table give an empty table.
    """
    col = fresh("mix")
    key, size = col("source"), col("size")
    sized = docs.withColumns({key: F.col(source_col), size: word_count(F.col(text_col))})
    plan = targets(sized.select(F.col(key).alias("source"), F.col(size).alias("size")), **options)
    flag = col("flag")
    side = cut(plan.select(
        F.coalesce("source", F.lit("")).alias(key), F.col("source").isNull().alias(flag),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias(col("rate")),
    ))
    flagged = sized.withColumns({flag: F.col(key).isNull(), key: F.coalesce(F.col(key), F.lit(""))})
    rate = F.col(col("rate"))
    copies = (F.floor(rate) + (draw(F.col(id_col), F.col(text_col)) < rate - F.floor(rate)).cast("long")).cast("long")
    keep = [c for c in docs.columns if c not in ("mix_size", "mix_source_size", "mix_target", "mix_copies")]
    return join_small(flagged, side, [key, flag], "inner").select(
        *keep, F.col(size).alias("mix_size"), "mix_source_size", "mix_target", copies.alias("mix_copies")
    )


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as `mix` says, without the mix columns."""
    kept = [c for c in mixed.columns if not c.startswith("mix_")]
    n = F.col("mix_copies").cast("int")
    return mixed.filter("mix_copies > 0").select(*kept, F.explode(F.array_repeat(F.lit(0), n)).alias("_copy")).drop("_copy")
