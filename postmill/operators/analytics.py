"""Reports: counts, shares, heat map, quality gates, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.functions import quality as ql
from postmill.functions import text as tx


def active_count(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count_if(F.col("status") == "active").alias("active"))


def status_counts(df: DataFrame, status: str, values: Sequence[str]) -> DataFrame:
    """One row with a count per status, zeros included, and the total of the known ones."""
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return df.agg(*counts, F.count_if(F.col(status).isin(list(values))).alias("total"))


def status_counts_by(df: DataFrame, key: str, status: str, values: Sequence[str]) -> DataFrame:
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return df.groupBy(key).agg(*counts, F.count("*").alias("total"))


def level(value: Column, good: Column, fair: Column) -> Column:
    """Three-level verdict of a metric."""
    return F.when(good, "ok").when(fair, "warn").otherwise("fail")


def source_share(listings: DataFrame, source: str = "platform") -> DataFrame:
    """Listings and share per source with the diversity verdict of the whole."""
    counts = listings.groupBy(source).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.max("n").alias("largest"), F.count("*").alias("sources"))
    one = whole.select(F.struct("total", "largest", "sources"))
    c = F.col
    top = c("w.largest") / c("w.total")
    return counts.withColumn("w", one.scalar()).select(
        source, "n", (c("n") / c("w.total")).alias("share"), top.alias("top_share"),
        level(top, (c("w.sources") >= 3) & (top <= 0.7), top <= 0.85).alias("diversity"),
    )


def verification_freshness(listings: DataFrame, now: Column, days: int = 7) -> DataFrame:
    old = F.col("last_checked_at").isNull() | (
        F.unix_micros(now) - F.unix_micros("last_checked_at") > days * 86_400_000_000
    )
    fresh = F.col("fresh_percent")
    return (
        listings.filter("status = 'active'")
        .agg(F.count("*").alias("total"), F.count_if(old).alias("stale"))
        .withColumn("fresh_percent", F.when(F.col("total") > 0, (F.col("total") - F.col("stale")) / F.col("total") * 100).otherwise(0.0))
        .withColumn("verdict", level(fresh, fresh >= 50, fresh >= 25))
    )


def application_health(applications: DataFrame) -> DataFrame:
    c = F.col
    done = ~c("status").isin("skipped", "failed")
    rate = c("failure_percent")
    return (
        applications.agg(
            F.count("*").alias("total"), F.count_if(c("status") == "failed").alias("failed"),
            F.count_if(done).alias("prepared"), F.count_if(done & c("has_files")).alias("with_files"),
        )
        .withColumn("failure_percent", F.when(c("total") > 0, c("failed") / c("total") * 100).otherwise(0.0))
        .withColumn("verdict", level(rate, rate < 5, rate < 10))
        .withColumn(
            "files_verdict",
            level(rate, c("prepared") == c("with_files"), c("with_files") / c("prepared") >= 0.9),
        )
    )


def top_companies(listings: DataFrame, limit: int) -> DataFrame:
    return (
        listings.filter((F.col("status") == "active") & F.length("company").between(3, 60))
        .groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(limit)
    )


# --- skill heat map ----------------------------------------------------------------------


def listing_text() -> Column:
    none = F.array().cast("array<string>")
    return F.concat_ws(
        "\n", "title", "description", F.array_join(F.coalesce("requirements", none), "\n"),
        F.array_join(F.coalesce("candidate_criteria", none), "\n"),
    )


def partly_known(own: Column, skill: Column) -> Column:
    return F.exists(
        own,
        lambda s: (s != skill) & (F.length(s) >= 4) & (F.length(skill) >= 4)
        & (F.contains(s, skill) | F.contains(skill, s)),
    )


def skill_status(own: Column, skill: Column) -> Column:
    return F.when(F.array_contains(own, skill), "present").when(partly_known(own, skill), "partial").otherwise("missing")


def skill_heatmap(
    listings: DataFrame, dictionary: Sequence[str], own_skills: Sequence[str], top: int = 20, min_sample: int = 5
) -> DataFrame:
    """Most wanted skills: listings asking for each, share of the sample, state against own skills."""
    own = tx.lit_array([s for s in (ex.normalize_py(x) for x in own_skills) if s])
    found = listings.select(F.explode(ex.counted_skills(listing_text(), dictionary)).alias("skill"))
    counts = found.groupBy("skill").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "skill").limit(top)
    sample = listings.agg(F.count("*"))
    return best.withColumn("sample_size", sample.scalar()).select(
        "skill", "n", (F.col("n") / F.col("sample_size")).alias("share"),
        skill_status(own, F.col("skill")).alias("status"), "sample_size",
        (F.col("sample_size") >= min_sample).alias("confident"),
    )


def skill_heatmap_by(
    sample: DataFrame, own_skills: DataFrame, dictionary: Sequence[str], key: str = "profile_id", top: int = 20
) -> DataFrame:
    """Heat map for many profiles: `sample` holds each profile's retrieved listings, `own_skills` an array."""
    skills = sample.select(key, F.explode(ex.counted_skills(listing_text(), dictionary)).alias("skill"))
    counts = skills.groupBy(key, "skill").agg(F.count("*").alias("n"))
    sizes = sample.groupBy(key).agg(F.count("*").alias("sample_size"))
    by = Window.partitionBy(key).orderBy(F.desc("n"), "skill")
    return (
        counts.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= top)
        .join(sizes, key).join(own_skills, key)
        .select(
            key, "position", "skill", "n", (F.col("n") / F.col("sample_size")).alias("share"),
            skill_status(F.col("own_skills"), F.col("skill")).alias("status"),
        )
    )


# --- sources -----------------------------------------------------------------------------


def coverage_by_type(outcomes: DataFrame, kind: str = "source_type") -> DataFrame:
    return outcomes.groupBy(kind).agg(
        F.count("*").alias("scanned"), F.count_if(F.col("parsed") > 0).alias("succeeded")
    )


def healthy_sources(report: DataFrame, active: DataFrame, min_runs: int = 2) -> DataFrame:
    """Share of working sources among active ones with enough runs."""
    used = report.filter(F.col("total_runs") >= min_runs).join(active.select("source").distinct(), "source", "left_semi")
    return used.agg(
        F.count("*").alias("sources"), F.count_if(F.col("verdict").isin("saglikli", "kismi")).alias("working")
    ).withColumn("verdict", F.when(F.col("working") * 2 >= F.col("sources"), "ok").otherwise("fail"))


def wave_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("wave").agg(F.count("*").alias("sources"), F.sum("relevant").alias("found"))


def facets(results: DataFrame) -> DataFrame:
    """(facet, value): cities and work modes of a result set."""
    rows = results.select(
        F.explode(
            F.array(
                F.struct(F.lit("city").alias("facet"), tx.base_city(F.col("location")).alias("value")),
                F.struct(F.lit("work_mode").alias("facet"), F.col("work_mode").alias("value")),
            )
        ).alias("f")
    ).select("f.*")
    return rows.filter("value <> ''").distinct()


def criteria_counts(criteria: Column) -> Column:
    """struct(met, partial, unmet) of an array of criteria structs"""
    def count(status: str) -> Column:
        return F.size(F.filter(criteria, lambda x: x["status"] == status)).alias(status)

    return F.struct(count("met"), count("partial"), count("unmet"))


# --- quality -----------------------------------------------------------------------------


def bad_listing_rate(listings: DataFrame) -> DataFrame:
    c = F.col
    blocked = ql.is_blocked_page(c("title"), c("description"))
    crossed = ~blocked & ~ql.title_matches_url(c("title"), c("url"))
    return bad_listing_verdict(
        listings.agg(F.count("*").alias("total"), F.count_if(blocked).alias("blocked"), F.count_if(crossed).alias("crossed"))
    )


def bad_listing_verdict(counts: DataFrame) -> DataFrame:
    c = F.col
    rate = c("bad_percent")
    return (
        counts.withColumn("bad_percent", F.when(c("total") > 0, (c("blocked") + c("crossed")) / c("total") * 100).otherwise(0.0))
        .withColumn("verdict", level(rate, rate < 2, rate < 5))
    )


def duplicate_rate(grouped: DataFrame) -> DataFrame:
    """From `dedupe.duplicate_groups`: rows beyond the first of each group."""
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n"))
    return duplicate_verdict(sizes.agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("removed")))


def duplicate_verdict(counts: DataFrame) -> DataFrame:
    c = F.col
    rate = c("duplicate_percent")
    return (
        counts.withColumn("duplicate_percent", F.when(c("total") > 0, c("removed") / c("total") * 100).otherwise(0.0))
        .withColumn("verdict", level(rate, rate < 5, rate < 10))
    )


def cleanup_set(listings: DataFrame) -> DataFrame:
    """Active and stale listings that must go, with the reason."""
    reason = ql.cleanup_reason(F.col("title"), F.col("description"), F.col("url"))
    return listings.filter(F.col("status").isin("active", "stale")).withColumn("reason", reason).filter("reason is not null")


def cleanup_counts(doomed: DataFrame) -> DataFrame:
    return doomed.groupBy("reason", "title").agg(F.count("*").alias("n"))


def without_menu_companies(listings: DataFrame) -> DataFrame:
    menu = tx.normalize(F.coalesce("company", F.lit(""))).isin(lx.MENU_COMPANIES)
    return listings.withColumn("company", F.when(~menu, F.col("company")))


def order_violations(results: DataFrame, search: str = "search_id") -> DataFrame:
    """Eligible rows listed below a rejected one, per search.

    The first rejected position is an aggregate, so no search needs a window of its own.
    """
    first = results.groupBy(search).agg(F.min(F.when(~F.col("eligible"), F.col("pos"))).alias("_first"))
    return results.join(first, search).groupBy(search).agg(
        F.count_if(F.col("eligible") & (F.col("pos") > F.col("_first"))).alias("violations")
    )


def result_quality(results: DataFrame, search: str = "search_id", head: int = 10) -> DataFrame:
    """Eligibility coverage, unexplained rejections and top-10 quality per search."""
    c = F.col
    known = c("eligible").isNotNull()
    top = known & (c("pos") < head)
    return results.groupBy(search).agg(
        F.count("*").alias("results"), F.count_if(known).alias("evaluated"),
        F.count_if(~c("eligible")).alias("rejected"),
        F.count_if(~c("eligible") & (c("blocker_count") == 0)).alias("unexplained"),
        F.count_if(top).alias("top"), F.count_if(top & c("eligible")).alias("top_eligible"),
    )


def scenario_metrics(results: DataFrame, key: str, in_profession: Column, duplicate_key: Column, head: int = 10) -> DataFrame:
    c = F.col
    top = c("pos") < head
    return (
        results.withColumn("_in", in_profession).withColumn("_key", duplicate_key)
        .groupBy(key)
        .agg(
            F.count("*").alias("results"), F.count_if("eligible").alias("eligible"), F.count_if(top).alias("top"),
            F.count_if(top & c("_in")).alias("top_in_profession"),
            (F.count("*") - F.count_distinct("_key")).alias("duplicates"),
        )
    )


def decision_tally(outcomes: DataFrame) -> DataFrame:
    return status_counts(outcomes, "decision", ["active", "expired", "error", "skipped"])


# --- progress ----------------------------------------------------------------------------


def stage_progress(updates: DataFrame, job: str = "job_id") -> DataFrame:
    """Percent done per job from its stage updates (job, stage, status, ts, event_id).

    The newest status per stage counts; a later update of a later stage closes a stage still
    shown as running. Finished stages weigh fully, running ones half, 99 at most.
    """
    c = F.col
    order = {name: i for i, (name, _) in enumerate(lx.STAGE_WEIGHTS)}
    table = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    weight = F.create_map(*[F.lit(x) for pair in lx.STAGE_WEIGHTS for x in pair])
    at = F.struct("ts", "event_id")
    newest = updates.filter(c("stage").isin(list(order))).groupBy(job, "stage").agg(
        F.max(at).alias("at"), F.max_by("status", at).alias("status")
    )
    stages = newest.groupBy(job).agg(
        F.collect_list(F.struct("stage", F.element_at(table, c("stage")).alias("no"), "status", "at")).alias("stages")
    )

    def closed(s: Column) -> Column:
        overtaken = F.exists(c("stages"), lambda o: (o["no"] > s["no"]) & (o["at"] > s["at"]))
        return F.when((s["status"] == "running") & overtaken, "done").otherwise(s["status"])

    def points(s: Column) -> Column:
        status, full = closed(s), F.element_at(weight, s["stage"])
        return F.when(status.isin("done", "skipped"), full.cast("double")).when(status == "running", full / 2).otherwise(0.0)

    total = F.aggregate(F.transform("stages", points), F.lit(0.0), lambda a, x: a + x)
    return stages.select(
        job,
        F.least(F.lit(99), F.floor(total + 0.5)).cast("int").alias("percent"),
        F.size(F.filter("stages", lambda s: closed(s).isin("done", "skipped"))).alias("finished"),
    )
