"""Source bookkeeping from the crawl log: health, verdicts, selection, verification.

Crawl log columns: source, ts, event_id (tie-break), status, parsed, discovered, searched, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import quality as ql
from postmill.functions import text as tx
from postmill.operators import ordered as od

ORDER = ["ts", "event_id"]
BLOCK_MESSAGE = "engel|blocked|cloudflare|captcha|403"


def source_health(log: DataFrame) -> DataFrame:
    """State per source after its whole log. Two map-side aggregations, no window over a source."""
    ok = F.col("parsed") > 0
    at = F.struct(*ORDER)
    state = log.groupBy("source").agg(
        F.count("*").alias("total_runs"),
        F.count_if(~ok).alias("empty_runs"),
        F.max("ts").alias("last_checked_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.max_by("status", at).alias("last_status"),
        F.max_by("parsed", at).alias("last_parsed_count"),
        F.max_by("discovered", at).alias("last_discovered_count"),
        F.max_by(F.lower(F.coalesce("message", F.lit(""))).rlike(BLOCK_MESSAGE), at).alias("blocked"),
        F.bool_or(~ok & (F.col("discovered") == 0) & (F.col("searched") > 0)).alias("requires_javascript"),
    )
    streak = od.trailing_streak(log, ["source"], ORDER, ~ok, ok, "consecutive_failures")
    return state.join(streak, "source")


def verdict(blocked: Column, total: Column, empty: Column, failures: Column) -> Column:
    success = (total - empty) / total
    return (
        F.when(blocked, "engelli").when(total == 0, "bilinmiyor").when(failures >= 3, "bozuk")
        .when(success >= 0.7, "saglikli").when(success > 0, "kismi").otherwise("bozuk")
    )


def health_report(health: DataFrame) -> DataFrame:
    c = F.col
    return health.withColumn(
        "verdict", verdict(c("blocked"), c("total_runs"), c("empty_runs"), c("consecutive_failures"))
    ).orderBy(F.desc("consecutive_failures"), "source")


def registry_metrics(log: DataFrame, base_rate_ms: int = 2000) -> DataFrame:
    """Counters, reliability, health average, coverage and request spacing per source.

    Log columns: source, ts, event_id, succeeded, new_jobs, relevant_jobs, duplicate_jobs, rate_limited.
    """
    ok = F.col("succeeded")
    totals = log.groupBy("source").agg(
        F.count("*").alias("total_scans"),
        F.count_if(ok).alias("successful_scans"),
        F.max("ts").alias("last_scanned_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success_at"),
        F.sum("new_jobs").alias("new_jobs"), F.sum("relevant_jobs").alias("relevant_jobs"),
        F.sum("duplicate_jobs").alias("duplicate_jobs"),
        F.count_if("rate_limited").alias("_limited"),
    )
    level = od.decayed_level(log, ["source"], ORDER, ok, name="health")
    return (
        totals.join(level, "source")
        .withColumn("reliability", F.col("successful_scans") / F.col("total_scans"))
        .withColumn("coverage", F.least(F.lit(1.0), F.col("new_jobs") / 200))
        .withColumn(
            "rate_limit_ms",
            F.least(F.lit(30000), base_rate_ms * F.pow(F.lit(2.0), F.least(F.col("_limited"), F.lit(10)))).cast("int"),
        )
        .drop("_limited")
    )


def escalated_listings(checks: DataFrame, threshold: int = 3) -> DataFrame:
    """Listings whose checks failed `threshold` times in a row since the last success.

    Checks: listing_id, ts, event_id, failed (boolean).
    """
    streak = od.trailing_streak(
        checks, ["listing_id"], ORDER, F.col("failed"), ~F.col("failed"), "error_count"
    )
    return streak.withColumn("status", F.when(F.col("error_count") >= threshold, "stale").otherwise("active"))


def circuit_breaker(fetches: DataFrame, blocked: Column, answered: Column, threshold: int = lx.HOST_BLOCK_THRESHOLD) -> DataFrame:
    """`skipped` for every fetch of a host after `threshold` blocks in a row (within one run).

    Fetches: host, ts, event_id. Other errors neither block nor reset.
    """
    streaks = od.running_streak(fetches, ["host"], ORDER, blocked, answered, "blocks")
    tripped = streaks.filter(F.col("blocks") >= threshold).groupBy("host").agg(F.min(F.struct(*ORDER)).alias("_trip"))
    return (
        streaks.join(tripped, "host", "left")
        .withColumn("skipped", F.coalesce(F.struct(*ORDER) > F.col("_trip"), F.lit(False)))
        .drop("_trip", "blocks")
    )


def verification(
    skipped: Column, last_seen: Column, now: Column, http_status: Column, requested: Column, final: Column, body: Column
) -> Column:
    """struct(decision, reason) for one fetched listing; the first matching rule decides."""
    old = F.unix_micros(now) - F.unix_micros(last_seen) > lx.EXPIRE_AFTER_DAYS * 86_400_000_000
    rules = [
        (skipped, "skipped", "host_blocked"),
        (old, "expired", "not_seen"),
        (http_status.isNull(), "error", "fetch_failed"),
        (http_status.isin(404, 410), "expired", "gone"),
        (http_status.isin(403, 429) | (http_status >= 500), "error", "temporary"),
        (final.isNotNull() & ql.left_detail_page(requested, final), "expired", "redirected"),
        (body.isNull(), "error", "no_body"),
        (ql.closed_marker(body), "expired", "closed_marker"),
        (F.length(body) < lx.MIN_LIVE_BODY, "error", "short_body"),
    ]
    decision, reason = F.lit("active"), F.lit("reachable")
    for rule, d, r in reversed(rules):
        flag = F.coalesce(rule, F.lit(False))
        decision, reason = F.when(flag, d).otherwise(decision), F.when(flag, r).otherwise(reason)
    return F.struct(decision.alias("decision"), reason.alias("reason"))


# --- selection ---------------------------------------------------------------------------


def wave(priority: Column) -> Column:
    return F.when(priority <= 5, 1).when(priority <= 19, 2).when(priority <= 39, 3).otherwise(4)


def selection_score(
    source_tags: Column, profile_tags: Column, reliability: Column, last_scanned: Column, now: Column,
    total_scans: Column, new_jobs: Column, relevant_jobs: Column, duplicate_jobs: Column, priority: Column,
) -> Column:
    special = F.filter(source_tags, lambda t: t != "genel")
    fit = (
        F.when(F.arrays_overlap(special, profile_tags), 30).when(F.array_contains(source_tags, "genel"), 12).otherwise(-60)
    )
    hours = (F.unix_micros(now) - F.unix_micros(last_scanned)) / 3_600_000_000
    waiting = F.coalesce(F.least(F.lit(15.0), hours / 4), F.lit(15.0))
    found = F.greatest(F.lit(1), new_jobs)
    harvest = F.when(
        total_scans > 0,
        F.least(F.lit(20.0), new_jobs / total_scans * 2) + relevant_jobs / found * 10 - duplicate_jobs / found * 15,
    ).otherwise(0.0)
    return fit + reliability * 25 + waiting + harvest + F.greatest(F.lit(0.0), 10 - priority / 10)


def _with_needs(sources: DataFrame, needs: DataFrame) -> DataFrame:
    """Every source with every need. Needs are distinct tag sets, at most 256 by construction, so
    they travel as one array in a scalar subquery."""
    all_needs = needs.agg(F.collect_list(F.struct("need_id", "profile_tags", "home_only")))
    return sources.withColumn("_need", F.explode(all_needs.scalar())).select("*", "_need.*").drop("_need")


def distinct_needs(profiles: DataFrame) -> DataFrame:
    """The few distinct needs behind all profiles: tag set and whether only home sources are wanted.

    Profiles: profile_tags (from `profession_tags`), work_mode.
    """
    tags = F.sort_array(F.array_distinct("profile_tags"))
    home = F.col("work_mode") != "remote"
    return profiles.select(
        F.concat_ws("|", F.array_join(tags, ","), home.cast("string")).alias("need_id"),
        tags.alias("profile_tags"), home.alias("home_only"),
    ).distinct()


def select_sources(sources: DataFrame, needs: DataFrame, now: Column, limit: int = 14) -> DataFrame:
    """Diversified sources per need: top priority always, one explorer, at most three per type.

    `needs`: need_id, profile_tags, home_only (at most two foreign sources instead of five). Many
    profiles share a need; callers deduplicate first. The fixed sources pass by; only their number counts. Of the
    others only the best four per (type, home/foreign) and the explorer can ever be picked, so the greedy pass is a fold
    over one short array per need, whatever the size of the registry.
    """
    c = F.col
    active = sources.filter("status = 'active'").withColumn("tags", F.split("profession_tags", r"\s*,\s*"))
    scored = _with_needs(active, needs).withColumn(
        "score",
        selection_score(
            c("tags"), c("profile_tags"), c("reliability"), c("last_scanned_at"), now, c("total_scans"),
            c("new_jobs"), c("relevant_jobs"), c("duplicate_jobs"), c("priority"),
        ),
    ).withColumn("fixed", c("priority") <= 5).withColumn("is_foreign", c("country") != "TR")
    slim = scored.select("need_id", "home_only", "name", "source_type", "priority", "is_foreign", "fixed", "score", "last_scanned_at")
    rest = slim.filter(~c("fixed"))
    taken = c("_taken")

    by_type = Window.partitionBy("need_id", "source_type", "is_foreign").orderBy(F.desc("score"), "name")
    best = rest.withColumn("_r", F.row_number().over(by_type)).filter(c("_r") <= 4)
    row = F.struct((-c("score")).alias("down"), "name", "source_type", "priority", "score", "is_foreign")
    # a minimum per need, so the longest waiting source needs no window
    oldest = F.min(F.struct(F.coalesce(F.unix_micros("last_scanned_at"), F.lit(-(1 << 63))).alias("at"), "priority", "name", row.alias("row")))
    pool = best.groupBy("need_id", "home_only").agg(F.sort_array(F.collect_list(row)).alias("ranked")).join(
        rest.groupBy("need_id").agg(oldest["row"].alias("explorer")), "need_id"
    ).withColumn("_taken", active.agg(F.count_if(c("priority") <= 5)).scalar())
    start = F.struct(F.when(taken < limit, F.array("explorer")).otherwise(F.slice(F.array("explorer"), 1, 0)).alias("picked"), F.lit(0).alias("foreign"))

    def step(state: Column, x: Column) -> Column:
        fits = (
            (F.size(state["picked"]) + taken < limit) & (x["score"] >= -5) & ~F.exists(state["picked"], lambda p: p["name"] == x["name"])
            & (F.size(F.filter(state["picked"], lambda p: p["source_type"] == x["source_type"])) < 3)
            & (~x["is_foreign"] | (state["foreign"] < F.when(c("home_only"), 2).otherwise(5)))
        )
        return F.when(fits, F.struct(
            F.concat(state["picked"], F.array(x)).alias("picked"), (state["foreign"] + x["is_foreign"].cast("int")).alias("foreign")
        )).otherwise(state)

    chosen = pool.select("need_id", F.explode(F.aggregate("ranked", start, step)["picked"]).alias("p"))
    names = ["need_id", "name", "source_type", "priority", "score"]
    picked = chosen.select("need_id", "p.name", "p.source_type", "p.priority", "p.score")
    return slim.filter("fixed").select(*names).unionByName(picked).withColumn("wave", wave(c("priority")))


# --- life cycle --------------------------------------------------------------------------


def demoted_status(status: Column, priority: Column, total: Column, successful: Column, min_scans: int = 2) -> Column:
    failing = (status == "active") & (priority > 5) & (total >= min_scans) & (successful == 0)
    return F.when(failing, "candidate").otherwise(status)


def probed_status(
    access_method: Column, http_status: Column, body: Column, total: Column, successful: Column
) -> Column:
    """Status of a probed candidate source: active with a job signal, dead after hopeless scans."""
    blocked = tx.fold(body).rlike(lx.PROBE_BLOCK_SIGNAL)
    signal = F.when(access_method == "json-api", body.rlike("title|jobs")).otherwise(
        tx.fold(body).rlike(lx.JOB_PAGE_SIGNAL)
    )
    alive = F.coalesce((http_status == 200) & ~blocked & signal, F.lit(False))
    return F.when(alive, "active").when((total > 0) & (successful == 0), "dead").otherwise("candidate")


def source_plan_order(sources: DataFrame) -> DataFrame:
    return sources.orderBy("priority", "name")
