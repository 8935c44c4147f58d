"""Cheap prefilter score, freshness, blending, quotas and result order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import text as tx
from postmill.operators.eligibility import round_half_up, score_band


def age_days(posted: Column, now: Column) -> Column:
    """Whole days since posting; the future counts as today, unknown stays NULL."""
    seconds = F.unix_micros(now) - F.unix_micros(posted)
    days = F.floor(seconds / F.lit(86_400_000_000))
    # greatest() would take 0 for an unknown date
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days))


def freshness(posted: Column, now: Column) -> Column:
    """struct(adjust, label, age_days)"""
    age = age_days(posted, now)
    return F.struct(
        F.when(age.isNull(), 0).when(age <= 3, 3).when(age <= 7, 1).when(age <= 20, 0).otherwise(-2).alias("adjust"),
        F.when(age <= 3, "new").when(age <= 7, "recent").when(age > 20, "old").alias("label"),
        age.alias("age_days"),
    )


def cheap_score(
    status: Column, title: Column, description: Column, location: Column, listing_mode: Column, last_seen: Column,
    target_role: Column, titles: Column, skills: Column, keywords: Column, locations: Column,
    location_mode: Column, work_mode: Column, now: Column, raw_length: Column,
) -> Column:
    """0-125 from text hits, place, mode and freshness; inactive listings get -1.

    Text arguments are normalised, arrays hold normalised terms.
    """
    def hits(terms: Column, hay: Column, least: int) -> Column:
        return F.size(F.filter(terms, lambda t: (F.length(t) >= least) & F.contains(hay, t)))

    role_hit = (target_role != "") & F.contains(title, target_role)
    other_hit = F.exists(titles, lambda t: (t != target_role) & (t != "") & F.contains(title, t))
    words = F.filter(keywords, lambda k: ~F.array_contains(skills, k))
    in_city = (location_mode == "cities") & (location != "") & F.exists(locations, lambda p: F.contains(location, p))
    mode = (
        F.when((work_mode == "any") | listing_mode.isNull(), 0)
        .when(listing_mode == work_mode, 15)
        .when((listing_mode == "hybrid") | (work_mode == "hybrid"), 8)
        .otherwise(0)
    )

    def points(flag: Column, value: int) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), value).otherwise(0)

    total = (
        points(role_hit, 30) + points(other_hit, 20)
        + F.least(F.lit(30), hits(skills, description, 2) * 5)
        + F.least(F.lit(20), hits(words, description, 3) * 2)
        + points(in_city, 15) + mode
        + points(F.unix_micros(now) - F.unix_micros(last_seen) <= 14 * 86_400_000_000, 10)
        + points(raw_length > 0, 5)
    )
    return F.when(status == "active", total).otherwise(-1)


def score_pairs(pairs: DataFrame, profiles: DataFrame, listings: DataFrame, now: Column) -> DataFrame:
    """Cheap score per retrieved pair. Both sides are normalised once, before they meet."""
    c = F.col

    def keys(name: str) -> Column:
        return F.array_distinct(F.transform(c(name), lambda t: tx.normalize(t))).alias(name)

    left = profiles.select(
        "profile_id", tx.normalize(c("target_role")).alias("target_role"), keys("titles"), keys("skills"),
        keys("keywords"), keys("locations"), "location_mode", c("work_mode").alias("wanted_mode"),
    )
    right = listings.select(
        "listing_id", "platform", "country", "status", tx.normalize(c("title")).alias("title_key"),
        tx.normalize(c("description")).alias("text_key"),
        tx.normalize(F.coalesce("location", F.lit(""))).alias("place_key"), "work_mode", "last_seen_at",
        F.length(F.trim("description")).alias("raw_length"),
    )
    joined = pairs.join(left, "profile_id").join(right, "listing_id")
    return joined.select(
        "profile_id", "listing_id", "platform", "country", c("wanted_mode").alias("profile_mode"),
        cheap_score(
            c("status"), c("title_key"), c("text_key"), c("place_key"), c("work_mode"), c("last_seen_at"),
            c("target_role"), c("titles"), c("skills"), c("keywords"), c("locations"), c("location_mode"),
            c("wanted_mode"), now, c("raw_length"),
        ).alias("cheap_score"),
    )


def top_per_profile(scored: DataFrame, limit: Column | int = lx.PREFILTER_LIMIT, score: str = "cheap_score") -> DataFrame:
    """Best `limit` pairs per profile with their position; `limit` may be a column (budgets)."""
    by = Window.partitionBy("profile_id").orderBy(F.desc(score), "listing_id")
    return scored.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= limit)


def budgeted(scored: DataFrame, affordable: str, score: str = "cheap_score") -> DataFrame:
    """All pairs with `deferred`: what exceeds a profile's affordable count, weakest first."""
    by = Window.partitionBy("profile_id").orderBy(F.desc(score), "listing_id")
    return scored.withColumn("position", F.row_number().over(by)).withColumn(
        "deferred", F.col("position") > F.col(affordable)
    )


def affordable_count(remaining_ms: Column, first_round_ms: Column, scored: Column) -> Column:
    """Listings that fit the remaining time at the measured cost each (0.4-6 s, 1.5 s unmeasured)."""
    each = F.when(scored > 0, F.least(F.lit(6000.0), F.greatest(F.lit(400.0), first_round_ms / scored))).otherwise(1500.0)
    return F.greatest(F.lit(0), F.floor(remaining_ms / each))


def country_quota(
    scored: DataFrame, foreign: Column, remote: Column, limit: int = lx.PREFILTER_LIMIT, score: str = "cheap_score"
) -> DataFrame:
    """Top `limit` per profile where foreign listings get at most 20 % of the seats (40 % if remote).

    Seats one side leaves empty go to the other. Every side keeps at most `limit` candidates before
    the counts are taken, so the later windows hold a bounded number of rows per profile.
    """
    share = F.when(remote, F.lit(0.4)).otherwise(F.lit(0.2))
    side = Window.partitionBy("profile_id", "_foreign").orderBy(F.desc(score), "listing_id")
    ranked = (
        scored.withColumn("_foreign", foreign)
        .withColumn("_seats", F.greatest(F.lit(2), F.floor(limit * share + 0.5)).cast("int"))
        .withColumn("_rank", F.row_number().over(side))
        .filter(F.col("_rank") <= limit)
    )
    whole = Window.partitionBy("profile_id")
    counted = ranked.withColumn("_n_foreign", F.count_if("_foreign").over(whole)).withColumn(
        "_n_domestic", F.count_if(~F.col("_foreign")).over(whole)
    )
    domestic = F.least(F.col("_n_domestic"), limit - F.least(F.col("_n_foreign"), F.col("_seats")))
    taken = counted.filter(F.col("_rank") <= F.when(F.col("_foreign"), limit - domestic).otherwise(domestic))
    by = Window.partitionBy("profile_id").orderBy(F.desc(score), "listing_id")
    return taken.withColumn("position", F.row_number().over(by)).withColumnRenamed("_foreign", "is_foreign").drop(
        "_seats", "_rank", "_n_foreign", "_n_domestic"
    )


# --- final score -------------------------------------------------------------------------


def blended(role_score: Column, technical_score: Column, semantic: Column, adjust: Column) -> Column:
    """struct(technical, final, band): technical is averaged with the semantic score of a table"""
    technical = (technical_score + semantic / 100 * 40) / 2
    final = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), role_score + technical + adjust)) + 0.5).cast("int")
    return tx.let(
        F.struct(technical.alias("t"), final.alias("f")),
        lambda x: F.struct(
            round_half_up(x["t"], 1).alias("technical"), x["f"].alias("final"), score_band(x["f"]).alias("band")
        ),
    )


def semantic_confidence(semantic: Column) -> Column:
    return F.when(semantic >= 75, "high").when(semantic >= 50, "medium").otherwise("low")


def promoted_category(semantic: Column, category: Column) -> Column:
    return F.when(semantic >= 70, "recommended").otherwise(category)


def fallback_score(cheap: Column) -> Column:
    """Score shown while no semantic score exists."""
    scaled = F.least(F.lit(55), F.greatest(F.lit(20), F.floor(cheap * 0.6 + 0.5))).cast("int")
    return F.when(F.coalesce(cheap, F.lit(0)) <= 0, 20).otherwise(scaled)


def with_semantic(evaluated: DataFrame, semantic: DataFrame, floor: int = lx.RELEVANCE_FLOOR, fallback_limit: int = 10) -> DataFrame:
    """Blend where a semantic score exists; profiles without any fall back to ten low-confidence rows.

    `evaluated`: profile_id, listing_id, eligible, role_score, technical_score, adjust, cheap_score,
    category. `semantic`: profile_id, listing_id, semantic.
    """
    c = F.col
    joined = evaluated.join(semantic, ["profile_id", "listing_id"], "left").withColumn(
        "_any", F.count("semantic").over(Window.partitionBy("profile_id")) > 0
    )
    rank = Window.partitionBy("profile_id").orderBy(F.desc("cheap_score"), "listing_id")
    blend = blended(c("role_score"), c("technical_score"), c("semantic"), c("adjust"))
    shaped = joined.withColumn("_rank", F.row_number().over(rank)).filter(
        F.when(c("_any"), c("semantic") >= floor).otherwise(c("_rank") <= fallback_limit)
    ).withColumn("_blend", blend)
    return shaped.select(
        *[name for name in evaluated.columns if name != "category"],
        F.when(c("_any"), promoted_category(c("semantic"), c("category"))).otherwise(c("category")).alias("category"),
        F.when(c("_any"), c("_blend.final")).otherwise(fallback_score(c("cheap_score"))).alias("match_score"),
        F.when(c("_any"), c("_blend.band")).alias("band"),
        F.when(c("_any"), semantic_confidence(c("semantic"))).otherwise("low").alias("confidence"),
    )


def results_with_rejected(scored: DataFrame, limit: int = lx.RESULT_LIMIT, rejected: int = lx.REJECTED_LIMIT) -> DataFrame:
    """Best eligible rows per profile, then a short tail of explained rejections."""
    side = Window.partitionBy("profile_id", "eligible").orderBy(F.desc("match_score"), "listing_id")
    return (
        scored.withColumn("_rank", F.row_number().over(side))
        .filter(F.col("_rank") <= F.when(F.col("eligible"), limit).otherwise(rejected))
        .drop("_rank")
    )


def result_order(kind: str = "score") -> list[Column]:
    """Sort keys: eligible first then score; `recency` and `role` are the other views."""
    c = F.col
    if kind == "recency":
        return [F.desc_nulls_last("posted_at"), c("listing_id")]
    if kind == "role":
        return [F.desc("role_score"), c("listing_id")]
    return [F.desc("eligible"), F.desc("match_score"), F.desc_nulls_last("posted_at"), c("listing_id")]


def priority_order() -> list[Column]:
    """The tolerance comparator as a total order: 5-point and 0.15 tolerances become buckets."""
    return [
        F.desc("eligible"), F.desc(F.floor(F.col("role_score") / 5)), F.desc(F.floor(F.col("required_coverage") / 0.15)),
        F.desc("total"), F.desc_nulls_last("posted_at"), F.col("listing_id"),
    ]


def result_filter(only_eligible: bool = True, min_score: int = 0, city: str | None = None, work_mode: str | None = None) -> Column:
    """View filter; the score floor never hides explained rejections."""
    c = F.col
    keep = F.lit(True)
    if only_eligible:
        keep = keep & F.coalesce(c("eligible"), F.lit(True))
    if min_score > 0:
        keep = keep & (~F.coalesce(c("eligible"), F.lit(True)) | (c("match_score") >= min_score))
    if city is not None:
        keep = keep & (tx.base_city(c("location")) == city)
    if work_mode is not None:
        keep = keep & (F.coalesce(c("work_mode"), F.lit("")) == work_mode)
    return keep


def stored_results(results: DataFrame, expired: DataFrame, non_listing: Column) -> DataFrame:
    """Saved results as they may be shown now: no statistics pages, no expired listings."""
    return results.filter(~non_listing).join(expired.select("listing_id"), "listing_id", "left_anti")
