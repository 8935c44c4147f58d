"""New-match digest: per subscriber the best new, unseen, eligible listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.operators import dedupe as dd
from postmill.operators import eligibility as el
from postmill.operators import retrieve as rt


def canonical_key() -> Column:
    """Listing fingerprint, or its URL when the listing has no usable identity."""
    print_ = tx.fingerprint(F.col("title"), F.col("company"), F.col("location"))
    return F.when(print_ == "", tx.url_key(F.col("url"))).otherwise(print_)


def subscribers(settings: DataFrame, users: DataFrame) -> DataFrame:
    return settings.filter("match_email").join(users, "user_id").filter("email <> ''")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` to append: unknown keys only, each key once."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def new_matches(
    profiles: DataFrame, listings: DataFrame, notified: DataFrame, now: Column, thresholds: DataFrame,
    window_hours: int = lx.DIGEST_WINDOW_HOURS, limit: int = lx.DIGEST_LIMIT, with_similarity: bool = True,
    home_cities: list[str] = lx.CITIES, retrieved: DataFrame | None = None,
) -> DataFrame:
    """(profile_id, position, listing_id, canonical_key, total) for every profile.

    Duplicates among the new listings are merged once for all profiles; per profile one of each
    group stays. `notified`: profile_id, canonical_key. `thresholds`: profile_id, match_min.
    `retrieved` takes pairs of `retrieve` that are already there.
    """
    c = F.col
    recent = listings.filter(F.unix_micros(now) - F.unix_micros("first_seen_at") <= window_hours * 3_600_000_000)
    groups = dd.duplicate_groups(recent, with_similarity).select("listing_id", "group_id")
    retrieved = rt.retrieve(profiles, listings) if retrieved is None else retrieved
    # only what some profile retrieved is parsed, however many listings are new
    asked = recent.join(retrieved.select("listing_id").distinct(), "listing_id", "left_semi")
    roles = asked.select(
        "listing_id", "title", canonical_key().alias("canonical_key"), el.listing_role().alias("role"),
        dd.listing_richness().alias("richness"),
    ).join(groups, "listing_id")
    pairs = retrieved.select("profile_id", "listing_id").join(roles, "listing_id")
    one = Window.partitionBy("profile_id", "group_id").orderBy(F.desc("richness"), "listing_id")
    fresh = (
        pairs.withColumn("_rank", F.row_number().over(one)).filter("_rank = 1").drop("_rank")
        .join(notified.select("profile_id", "canonical_key").distinct(), ["profile_id", "canonical_key"], "left_anti")
    )
    who = profiles.select("profile_id", el.profile_candidate().alias("who")).join(thresholds, "profile_id")
    verdict = el.evaluate(c("role"), c("who"), F.array("title"), True, home_cities)
    good = (
        # a generator, so that the filter doesn't evaluate every pair again
        fresh.join(who, "profile_id").select("profile_id", "listing_id", "canonical_key", "match_min", F.explode(F.array(verdict)).alias("v"))
        .filter(c("v.eligible") & (c("v.total") >= F.greatest(c("match_min"), F.lit(lx.DIGEST_FLOOR))))
        .select("profile_id", "listing_id", "canonical_key", c("v.total").alias("total"))
    )
    best = Window.partitionBy("profile_id").orderBy(F.desc("total"), "listing_id")
    return good.withColumn("position", F.row_number().over(best)).filter(c("position") <= limit)


def digest_texts(matches: DataFrame, listings: DataFrame, target_roles: DataFrame) -> DataFrame:
    """One message body per profile; a digest holds at most ten lines."""
    c = F.col
    line = pf.digest_line(c("position"), c("title"), c("company"), c("location"), c("total"), c("url"))
    lines = (
        matches.join(listings.select("listing_id", "title", "company", "location", "url"), "listing_id")
        .select("profile_id", F.struct("position", line.alias("line")).alias("l"))
        .groupBy("profile_id")
        .agg(F.sort_array(F.collect_list("l")).alias("lines"), F.count("*").alias("n"))
        .join(target_roles, "profile_id")
    )
    fields = {"n": c("n"), "target_role": c("target_role"), "lines": F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")}
    body = pf.fill(pf.TEMPLATES["digest"], fields)
    return lines.select("profile_id", "n", body.alias("body"))
