"""Source health, selection, verification and listing life-cycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import profile as pf
from postmill.functions import text as tx
from postmill.operators import analytics as an
from postmill.operators import health as hl
from postmill.operators import ordered as od
from postmill.operators import reuse as ru
from postmill.plans import sqltext as s
from postmill.plans.registry import query
from postmill.plans.tables import DAY, NOW, at, now
from postmill.sources import listings as ls

c = F.col

_HEALTH = """
runs AS (SELECT *, parsed > 0 AS ok FROM crawl_log),
last_ok AS (SELECT source, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS e FROM runs WHERE ok GROUP BY source),
health AS (
  SELECT source, count(*) AS total_runs, count(*) FILTER (NOT ok) AS empty_runs, arg_max(parsed, (ts, event_id)) AS last_parsed_count,
    arg_max(discovered, (ts, event_id)) AS last_discovered_count, arg_max(status, (ts, event_id)) AS last_status, arg_max(blocked, (ts, event_id)) AS blocked,
    bool_or(NOT ok AND discovered = 0) AS requires_javascript, epoch(max(ts) FILTER (ok)) AS last_success,
    count(*) FILTER (NOT ok AND (last_ok.t IS NULL OR (ts, event_id) > (last_ok.t, last_ok.e))) AS consecutive_failures
  FROM runs LEFT JOIN last_ok USING (source) GROUP BY source
),
verdicts AS (
  SELECT *, CASE WHEN blocked THEN 'engelli' WHEN consecutive_failures >= 3 THEN 'bozuk' WHEN (total_runs - empty_runs) * 1.0 / total_runs >= 0.7 THEN 'saglikli'
    WHEN total_runs > empty_runs THEN 'kismi' ELSE 'bozuk' END AS verdict FROM health
)"""


@query("source_health", s.with_(s.CRAWL_LOG, _HEALTH) + """
SELECT source, total_runs, empty_runs, last_parsed_count, last_discovered_count, last_status, blocked, requires_javascript, round(last_success, 3) AS last_success,
  consecutive_failures, verdict FROM verdicts
""")
def source_health(t):
    report = hl.health_report(hl.source_health(t.crawl_log))
    return report.select(
        "source", "total_runs", "empty_runs", "last_parsed_count", "last_discovered_count", "last_status", "blocked",
        "requires_javascript", F.round(F.unix_micros("last_success_at") / 1e6, 3).alias("last_success"),
        "consecutive_failures", "verdict",
    )


@query("verdict_counts", s.with_(s.CRAWL_LOG, _HEALTH) + "SELECT verdict, count(*) AS n FROM verdicts GROUP BY verdict")
def verdict_counts(t):
    return hl.health_report(hl.source_health(t.crawl_log)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("healthy_sources", s.with_(s.CRAWL_LOG, _HEALTH) + """
SELECT count(*) AS sources, count(*) FILTER (verdict IN ('saglikli', 'kismi')) AS working,
  CASE WHEN count(*) FILTER (verdict IN ('saglikli', 'kismi')) * 2 >= count(*) THEN 'ok' ELSE 'fail' END AS verdict
FROM verdicts WHERE total_runs >= 2 AND source IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')
""")
def healthy_sources(t):
    active = t.read("customer").filter("c_mktsegment <> 'MACHINERY'").select(c("c_custkey").alias("source"))
    return an.healthy_sources(hl.health_report(hl.source_health(t.crawl_log)), active)


@query("health_levels", s.with_(s.SCAN_LOG) + """
SELECT source, count(*) AS total_scans, count(*) FILTER (succeeded) AS successful_scans, sum(new_jobs) AS new_jobs,
  round(0.5 * pow(0.7, count(*)) + sum(CASE WHEN succeeded THEN 0.3 * pow(0.7, n - i) ELSE 0 END), 6) AS health,
  round(count(*) FILTER (succeeded) * 1.0 / count(*), 6) AS reliability, round(least(1.0, sum(new_jobs) / 200.0), 6) AS coverage,
  CAST(least(30000, 2000 * pow(2, least(10, count(*) FILTER (rate_limited)))) AS INTEGER) AS rate_limit_ms
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM scan_log) GROUP BY source
""")
def health_levels(t):
    m = hl.registry_metrics(t.scan_log)
    return m.select(
        "source", "total_scans", "successful_scans", "new_jobs", F.round("health", 6).alias("health"),
        F.round("reliability", 6).alias("reliability"), F.round("coverage", 6).alias("coverage"), "rate_limit_ms",
    )


@query("error_escalation", """
SELECT user_id AS listing_id, error_count, CASE WHEN error_count >= 3 THEN 'stale' ELSE 'active' END AS status FROM (
  SELECT user_id, count(*) FILTER (i > coalesce(k, 0)) AS error_count FROM (
    SELECT *, max(CASE WHEN event_type <> 'error' THEN i END) OVER (PARTITION BY user_id) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)) GROUP BY user_id)
""")
def error_escalation(t):
    checks = t.events.select(
        c("user_id").alias("listing_id"), "ts", "event_id", (c("event_type") == "error").alias("failed")
    )
    return hl.escalated_listings(checks)


@query("failure_streaks", """
SELECT event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM (
  SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
""")
def failure_streaks(t):
    failed = c("event_type") == "error"
    return od.running_streak(t.events, ["user_id"], ["ts", "event_id"], failed, ~failed).select("event_id", "streak")


@query("circuit_breaker", """
WITH relevant AS (
  SELECT *, event_type IN ('error', 'view') AS block FROM events WHERE event_type IN ('error', 'view', 'click')
),
trip AS (
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS e, min(ts) AS t FROM (
    SELECT *, block AND lag(block, 1) OVER w AND lag(block, 2) OVER w AS three FROM relevant WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  WHERE three GROUP BY user_id
)
SELECT event_id, coalesce((ts, event_id) > (t, e), false) AS skipped FROM events LEFT JOIN trip USING (user_id)
""")
def circuit_breaker(t):
    fetches = t.events.select(c("user_id").alias("host"), "ts", "event_id", "event_type")
    kind = c("event_type")
    return hl.circuit_breaker(fetches, kind.isin("error", "view"), kind == "click").select("event_id", "skipped")


_VERIFY = f"""
fetched AS (
  SELECT page_id, url AS asked, CASE WHEN page_id % 11 = 3 THEN NULL WHEN page_id % 11 = 4 THEN 404 WHEN page_id % 11 = 5 THEN 403 WHEN page_id % 11 = 6 THEN 503 ELSE 200 END AS code,
    CASE WHEN page_id % 11 = 7 THEN regexp_replace(url, '[^/]*$', '') ELSE url END AS got, page_id % 11 = 0 AS skipped, {NOW} - (page_id % 37) * {DAY} AS seen,
    CASE WHEN page_id % 11 = 8 THEN 'Bu İlan Kapandı ' || html WHEN page_id % 11 = 9 THEN substr(html, 1, 100) ELSE html END AS body FROM pages
),
decided AS (
  SELECT page_id, CASE WHEN skipped THEN 'host_blocked' WHEN {NOW} - seen > 30 * {DAY} THEN 'not_seen' WHEN code IS NULL THEN 'fetch_failed' WHEN code IN (404, 410) THEN 'gone'
    WHEN code IN (403, 429) OR code >= 500 THEN 'temporary' WHEN lower(regexp_replace({s.path('asked')}, '/+$', '')) <> lower(regexp_replace({s.path('got')}, '/+$', '')) THEN 'redirected'
    WHEN regexp_matches({s.fold('body')}, {s.q(lx.CLOSED_MARKERS)}) THEN 'closed_marker' WHEN length(body) < 500 THEN 'short_body' ELSE 'reachable' END AS reason FROM fetched
),
verified AS (SELECT *, CASE WHEN reason = 'host_blocked' THEN 'skipped' WHEN reason IN ('not_seen', 'gone', 'redirected', 'closed_marker') THEN 'expired'
  WHEN reason = 'reachable' THEN 'active' ELSE 'error' END AS decision FROM decided)"""


def _verified(t):
    i = c("page_id") % 11
    fetched = t.pages.select(
        "page_id", c("url").alias("asked"),
        F.when(i == 3, None).when(i == 4, 404).when(i == 5, 403).when(i == 6, 503).otherwise(200).alias("code"),
        F.when(i == 7, F.regexp_replace("url", "[^/]*$", "")).otherwise(c("url")).alias("got"),
        (i == 0).alias("skipped"), at(F.lit(NOW) - (c("page_id") % 37) * DAY).alias("seen"),
        F.when(i == 8, F.concat(F.lit("Bu İlan Kapandı "), "html")).when(i == 9, F.substring("html", 1, 100)).otherwise(c("html")).alias("body"),
    )
    verdict = hl.verification(c("skipped"), c("seen"), now(), c("code"), c("asked"), c("got"), c("body"))
    return fetched.select("page_id", verdict.alias("v")).select("page_id", "v.*")


@query("verification", s.with_(_VERIFY) + "SELECT page_id, decision, reason FROM verified")
def verification(t):
    return _verified(t)


@query("decision_tally", s.with_(_VERIFY) + """
SELECT count(*) FILTER (decision = 'active') AS active, count(*) FILTER (decision = 'expired') AS expired, count(*) FILTER (decision = 'error') AS error,
  count(*) FILTER (decision = 'skipped') AS skipped, count(*) AS total FROM verified
""")
def decision_tally(t):
    return an.decision_tally(_verified(t))


_SELECT_SCORE = f"""
  CASE WHEN list_has_any(list_filter(tags, lambda x: x <> 'genel'), ['tech', 'finans', 'genel']) THEN 30 WHEN list_contains(tags, 'genel') THEN 12 ELSE -60 END
  + reliability * 25 + coalesce(least(15.0, ({NOW} - last_scanned_s) / 3600.0 / 4), 15.0)
  + CASE WHEN total_scans > 0 THEN least(20.0, new_jobs * 1.0 / total_scans * 2) + relevant_jobs * 1.0 / greatest(1, new_jobs) * 10 - duplicate_jobs * 1.0 / greatest(1, new_jobs) * 15 ELSE 0 END
  + greatest(0.0, 10 - priority / 10.0)"""


@query("selection_scores", s.with_(s.REGISTRY) + f"""
SELECT name, round({_SELECT_SCORE}, 6) AS score, CASE WHEN priority <= 5 THEN 1 WHEN priority <= 19 THEN 2 WHEN priority <= 39 THEN 3 ELSE 4 END AS wave,
  CASE WHEN status = 'active' AND priority > 5 AND total_scans >= 2 AND successful_scans = 0 THEN 'candidate' ELSE status END AS next_status
FROM (SELECT *, string_split(profession_tags, ',') AS tags FROM registry)
""")
def selection_scores(t):
    tags = F.array(*[F.lit(x) for x in ("tech", "finans", "genel")])
    score = hl.selection_score(
        F.split("profession_tags", ","), tags, c("reliability"), c("last_scanned_at"), now(), c("total_scans"), c("new_jobs"),
        c("relevant_jobs"), c("duplicate_jobs"), c("priority"),
    )
    return t.registry.select(
        "name", F.round(score, 6).alias("score"), hl.wave(c("priority")).alias("wave"),
        hl.demoted_status(c("status"), c("priority"), c("total_scans"), c("successful_scans")).alias("next_status"),
    )


_TAG_LISTS = " || ".join(
    f"CASE WHEN regexp_matches(hay, {s.q(p)}) THEN [{s.q(tag)}] ELSE []::VARCHAR[] END" for p, tag in lx.PROFESSION_TAG_PATTERNS
)


@query("profession_tags", s.with_(s.PROFILES) + f"""
SELECT profile_id, array_to_string({_TAG_LISTS} || ['genel'], ',') AS tags FROM (
  SELECT profile_id, {s.norm("array_to_string([target_role] || titles || skills, ' ')")} AS hay FROM profiles)
""")
def profession_tags(t):
    sources = F.concat(F.array("target_role"), "titles", "skills")
    return t.profiles.select("profile_id", F.array_join(pf.profession_tags(sources), ",").alias("tags"))


_NEED_SCORE = _SELECT_SCORE.replace("['tech', 'finans', 'genel']", "profile_tags")
_DIVERSE = f"""
hay AS (SELECT work_mode, {s.norm("array_to_string([target_role] || titles || skills, ' ')")} AS hay FROM profiles),
needs AS (
  SELECT DISTINCT array_to_string(tags, ',') || '|' || home::VARCHAR AS need_id, tags AS profile_tags, home FROM (
    SELECT list_sort(list_distinct({_TAG_LISTS} || ['genel'])) AS tags, work_mode <> 'remote' AS home FROM hay)
),
open_sources AS (SELECT *, string_split(profession_tags, ',') AS tags, priority <= 5 AS fixed, country <> 'TR' AS away FROM registry WHERE status = 'active'),
scored AS (SELECT need_id, home, name, source_type, priority, last_scanned_s, fixed, away, {_NEED_SCORE} AS score FROM open_sources, needs),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY need_id ORDER BY score DESC, name) AS i, row_number() OVER (PARTITION BY need_id ORDER BY last_scanned_s NULLS FIRST, priority, name) AS e
  FROM scored WHERE NOT fixed
),
taken AS (SELECT count(*) AS n FROM open_sources WHERE fixed),
fold(need_id, i, names, kinds, away_n) AS (
  SELECT need_id, 0::BIGINT, CASE WHEN n < 14 THEN [name] ELSE []::VARCHAR[] END, CASE WHEN n < 14 THEN [source_type] ELSE []::VARCHAR[] END, 0 FROM ordered, taken WHERE e = 1
  UNION ALL
  SELECT f.need_id, o.i, CASE WHEN ok THEN list_append(f.names, o.name) ELSE f.names END, CASE WHEN ok THEN list_append(f.kinds, o.source_type) ELSE f.kinds END,
    f.away_n + CASE WHEN ok AND o.away THEN 1 ELSE 0 END
  FROM fold f JOIN ordered o ON o.need_id = f.need_id AND o.i = f.i + 1, taken,
    LATERAL (SELECT n + len(f.names) < 14 AND o.score >= -5 AND NOT list_contains(f.names, o.name) AND len(list_filter(f.kinds, lambda k: k = o.source_type)) < 3
      AND (NOT o.away OR f.away_n < CASE WHEN o.home THEN 2 ELSE 5 END) AS ok) AS x
),
last AS (SELECT need_id, arg_max(names, i) AS names FROM fold GROUP BY need_id)"""


@query("diversified_sources", s.with_(s.PROFILES, s.REGISTRY, _DIVERSE).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT need_id, name, source_type, priority, round(score, 6) AS score, CASE WHEN priority <= 5 THEN 1 WHEN priority <= 19 THEN 2 WHEN priority <= 39 THEN 3 ELSE 4 END AS wave
FROM scored LEFT JOIN last USING (need_id) WHERE fixed OR list_contains(names, name)
""")
def diversified_sources(t):
    """Sources picked for every distinct need of the profiles (greedy, order-dependent)."""
    sources = F.concat(F.array("target_role"), "titles", "skills")
    tagged = t.profiles.select(pf.profession_tags(sources).alias("profile_tags"), "work_mode")
    return hl.select_sources(t.registry, hl.distinct_needs(tagged), now()).withColumn("score", F.round("score", 6))


@query("probe_results", """
SELECT page_id, CASE WHEN code = 200 AND NOT blocked AND regexp_matches(lower(html), '(is-ilani|is-ilanlari|/jobs?\\b|/careers?\\b|kariyer|acik pozisyon|open position|basvur|apply|jobposting)') THEN 'active'
  WHEN page_id % 3 > 0 THEN 'dead' ELSE 'candidate' END AS status
FROM (SELECT page_id, html, CASE WHEN page_id % 4 = 0 THEN 500 ELSE 200 END AS code,
  regexp_matches(lower(html), '(just a moment|attention required|access denied|verify you are|captcha)') AS blocked FROM pages)
""")
def probe_results(t):
    i = c("page_id")
    status = hl.probed_status(F.lit("html"), F.when(i % 4 == 0, 500).otherwise(200), c("html"), i % 3, F.lit(0))
    return t.pages.select("page_id", status.alias("status"))


@query("source_share", """
SELECT source AS platform, n, round(n * 1.0 / total, 6) AS share, round(largest * 1.0 / total, 6) AS top_share,
  CASE WHEN sources >= 3 AND largest * 1.0 / total <= 0.7 THEN 'ok' WHEN largest * 1.0 / total <= 0.85 THEN 'warn' ELSE 'fail' END AS diversity
FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total, max(count(*)) OVER () AS largest, count(*) OVER () AS sources FROM documents GROUP BY source)
""")
def source_share(t):
    share = an.source_share(t.read("documents").select(c("source").alias("platform")))
    return share.withColumn("share", F.round("share", 6)).withColumn("top_share", F.round("top_share", 6))


@query("coverage_by_type", s.with_(s.CRAWL_LOG) + "SELECT status AS source_type, count(*) AS scanned, count(*) FILTER (parsed > 0) AS succeeded FROM crawl_log GROUP BY status")
def coverage_by_type(t):
    return an.coverage_by_type(t.crawl_log.withColumnRenamed("status", "source_type"))


@query("wave_totals", s.with_(s.REGISTRY) + """
SELECT CASE WHEN priority <= 5 THEN 1 WHEN priority <= 19 THEN 2 WHEN priority <= 39 THEN 3 ELSE 4 END AS wave, count(*) AS sources, sum(relevant_jobs) AS found FROM registry GROUP BY 1
""")
def wave_totals(t):
    return an.wave_totals(t.registry.select(hl.wave(c("priority")).alias("wave"), c("relevant_jobs").alias("relevant")))


@query("sources_by_status", s.with_(s.REGISTRY) + "SELECT status, count(*) AS n, min(priority) AS best FROM registry GROUP BY status")
def sources_by_status(t):
    return t.registry.groupBy("status").agg(F.count("*").alias("n"), F.min("priority").alias("best"))


@query("source_order", s.with_(s.REGISTRY) + "SELECT name, priority FROM registry WHERE status = 'active' ORDER BY priority, name")
def source_order(t):
    return hl.source_plan_order(t.registry.filter("status = 'active'")).select("name", "priority")


@query("ttl_reuse", """
WITH searches AS (
  SELECT event_id, user_id, event_type, ts, event_type <> 'error' AS completed, event_id % 5 = 0 AS is_copy, CAST(floor(value) AS INTEGER) AS n FROM events
),
prior AS (
  SELECT *, last_value(CASE WHEN completed AND NOT is_copy AND n > 0 THEN event_id END IGNORE NULLS) OVER w AS source_id,
    last_value(CASE WHEN completed AND NOT is_copy AND n > 0 THEN ts END IGNORE NULLS) OVER w AS source_ts
  FROM searches WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT event_id AS search_id, CASE WHEN ts - source_ts < INTERVAL 48 HOUR THEN source_id END AS reused_id FROM prior
""")
def ttl_reuse(t):
    searches = t.events.select(
        c("event_id").alias("search_id"), "user_id", c("event_type").alias("fingerprint"), c("ts").cast("timestamp").alias("ts"),
        (c("event_type") != "error").alias("completed"), (c("event_id") % 5 == 0).alias("is_copy"),
        F.floor("value").cast("int").alias("result_count"),
    )
    return ru.reusable_results(searches, 48).select("search_id", "reused_id")


# --- listing table -------------------------------------------------------------------------

_VERSIONS = f"""
old AS (SELECT platform, {s.url_key('url')} AS url, title, listing_id, posted_s, first_seen_s, last_seen FROM base_listings WHERE listing_id % 3 <> 0),
old_table AS (SELECT platform, url, arg_max(title, listing_id) AS title, max(posted_s) AS posted_s, min(first_seen_s) AS first_seen_s, max(last_seen) AS last_seen FROM old GROUP BY platform, url),
new AS (SELECT platform, {s.url_key('url')} AS url, listing_id, title || ' v2' AS title, CASE WHEN listing_id % 2 = 0 THEN posted_s + 60 END AS posted_s FROM base_listings WHERE listing_id % 4 <> 1),
new_table AS (SELECT platform, url, arg_max(title, listing_id) AS title, max(posted_s) AS posted_s FROM new GROUP BY platform, url)"""


UPSERT_SQL = s.with_(s.LISTINGS, _VERSIONS) + f"""
SELECT coalesce(o.platform, n.platform) AS platform, coalesce(o.url, n.url) AS url, coalesce(n.title, o.title) AS title, coalesce(n.posted_s, o.posted_s) AS posted_s,
  coalesce(o.first_seen_s, {NOW}) AS first_seen_s, CASE WHEN n.url IS NOT NULL THEN {NOW} ELSE o.last_seen END AS last_seen_s,
  CASE WHEN n.url IS NOT NULL THEN 0 ELSE 2 END AS error_count
FROM old_table o FULL JOIN new_table n ON o.platform = n.platform AND o.url = n.url
"""


def old_and_new_listings(t):
    base = t.base_listings.withColumn("url", tx.url_key(c("url")))
    i = c("listing_id")
    at_id = F.max_by("title", "listing_id").alias("title")
    old = base.filter(i % 3 != 0).groupBy("platform", "url").agg(
        at_id, F.max("posted_at").alias("posted_at"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")
    ).withColumn("error_count", F.lit(2)).withColumn("content_hash", F.lit("old")).withColumn(
        "source_query", F.lit(None).cast("string")).withColumn("last_checked_at", c("last_seen_at"))
    fresh = base.filter(i % 4 != 1).withColumn("title", F.concat("title", F.lit(" v2"))).withColumn(
        "posted_at", F.when(i % 2 == 0, F.timestamp_seconds(F.unix_seconds("posted_at") + 60)))
    new = fresh.groupBy("platform", "url").agg(at_id, F.max("posted_at").alias("posted_at")).select(
        "*", F.lit(0).alias("error_count"), F.lit("new").alias("content_hash"), F.lit(None).cast("string").alias("source_query"),
        now().alias("first_seen_at"), now().alias("last_seen_at"), now().alias("last_checked_at"),
    )
    return old, new


@query("listing_upsert", UPSERT_SQL)
def listing_upsert(t):
    merged = ls.upsert_listings(*old_and_new_listings(t))
    return merged.select(
        "platform", "url", "title", F.unix_seconds("posted_at").alias("posted_s"), F.unix_seconds("first_seen_at").alias("first_seen_s"),
        F.unix_seconds("last_seen_at").alias("last_seen_s"), "error_count",
    )


@query("source_upsert", """
SELECT name, CASE WHEN s_name IS NULL THEN 'https://www.' || regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') || '.com' ELSE 'https://known.example.com' END AS base_url,
  CASE WHEN s_name IS NULL THEN 'general' ELSE 'tech' END AS category
FROM (SELECT DISTINCT source AS name FROM documents UNION SELECT s_name FROM supplier) LEFT JOIN supplier ON s_name = name
""")
def source_upsert(t):
    known = t.read("supplier").select(
        c("s_name").alias("name"), F.lit("https://known.example.com").alias("base_url"), F.lit("tech").alias("category")
    )
    seen = t.read("documents").select(c("source").alias("name"), F.lit("").alias("base_url"), F.lit("odd").alias("category"))
    return ls.upsert_sources(known, seen)


@query("active_listings", s.with_(s.LISTINGS) + """
SELECT listing_id, platform, n_sources AS source_size FROM base_listings JOIN (SELECT source, count(*) AS n_sources FROM documents GROUP BY source) ON source = platform WHERE status = 'active'
""")
def active_listings(t):
    sources = t.read("documents").groupBy(c("source").alias("name")).agg(F.count("*").alias("source_size"))
    active = t.base_listings.filter("status = 'active'").select("listing_id", "platform")
    return active.join(sources, active["platform"] == sources["name"]).select("listing_id", "platform", "source_size")


@query("expired_cascade", s.with_(s.APPLICATIONS) + """
SELECT application_id, CASE WHEN c.c_custkey IS NOT NULL AND status IN ('needs_review', 'manual_required', 'queued', 'preparing') THEN 'skipped' ELSE status END AS status
FROM applications LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) c ON c.c_custkey = user_id
""")
def expired_cascade(t):
    from postmill.operators import applications as ap

    closed = t.read("customer").filter("c_acctbal < 0").select(c("c_custkey").alias("listing_id"))
    rows = t.applications.withColumn("listing_id", c("user_id"))
    return ap.close_pending(rows, closed, "closed").select("application_id", "status")


@query("verification_queue", s.with_(s.LISTINGS) + "SELECT listing_id FROM base_listings ORDER BY last_checked_s NULLS FIRST, listing_id LIMIT 50")
def verification_queue(t):
    return ls.verification_queue(t.base_listings, 50).select("listing_id")


@query("verification_freshness", s.with_(s.LISTINGS) + f"""
SELECT total, stale, round((total - stale) * 100.0 / total, 6) AS fresh_percent, CASE WHEN (total - stale) * 100.0 / total >= 50 THEN 'ok' WHEN (total - stale) * 100.0 / total >= 25 THEN 'warn' ELSE 'fail' END AS verdict
FROM (SELECT count(*) AS total, count(*) FILTER (last_checked_s IS NULL OR {NOW} - last_checked_s > 7 * {DAY}) AS stale FROM base_listings WHERE status = 'active')
""")
def verification_freshness(t):
    return an.verification_freshness(t.base_listings, now()).withColumn("fresh_percent", F.round("fresh_percent", 6))
