"""Application ledger, report, digest and progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import quality as ql
from postmill.functions import text as tx
from postmill.operators import analytics as an
from postmill.operators import applications as ap
from postmill.operators import digest as dg
from postmill.operators import retrieve as rt
from postmill.operators import score as sc
from postmill.plans import sqltext as s
from postmill.plans.dedupe_queries import _CONTENT, _GROUPS, _RICH
from postmill.plans.matching_queries import BASE, _EVAL, _ROLE
from postmill.plans.registry import query
from postmill.plans.tables import HOME_CITIES, NOW, now
from postmill.session import cut

c = F.col

_COUNTS = ", ".join(f"count(*) FILTER (status = {s.q(v)}) AS {v}" for v in lx.APPLICATION_STATUSES)


@query("status_counts", s.with_(s.APPLICATIONS) + f"SELECT {_COUNTS}, count(*) AS total FROM applications")
def status_counts(t):
    return an.status_counts(t.applications, "status", lx.APPLICATION_STATUSES)


@query("user_status_counts", s.with_(s.APPLICATIONS) + f"SELECT user_id, {_COUNTS}, count(*) AS total FROM applications GROUP BY user_id")
def user_status_counts(t):
    return an.status_counts_by(t.applications, "user_id", "status", lx.APPLICATION_STATUSES)


_RANK = "CASE status " + " ".join(f"WHEN {s.q(v)} THEN {i}" for i, v in enumerate(lx.APPLICATION_STATUSES, 1)) + " ELSE 0 END"


@query("app_order", s.with_(s.APPLICATIONS) + f"""
SELECT application_id, user_id, position, CASE WHEN c_acctbal < 0 THEN 'expired' ELSE 'active' END AS listing_status FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK}, score DESC, created_at DESC, application_id) AS position FROM applications)
JOIN customer ON c_custkey = user_id WHERE position <= 5
""")
def app_order(t):
    listings = t.read("customer").select(
        c("c_custkey").alias("listing_id"), F.when(c("c_acctbal") < 0, "expired").otherwise("active").alias("status")
    )
    rows = ap.list_applications(t.applications.withColumn("listing_id", c("user_id")), listings, 5)
    return rows.select("application_id", "user_id", "position", "listing_status")


@query("daily_cap", s.with_(s.APPLICATIONS) + """
SELECT application_id, row_number() OVER (PARTITION BY user_id, date_trunc('year', created_at) ORDER BY created_at, application_id) <= 2 AS send FROM applications WHERE status = 'sent'
""")
def daily_cap(t):
    sent = t.applications.filter("status = 'sent'")
    flagged = ap.capped_sends(sent, 2, F.date_trunc("year", "created_at"), [c("created_at"), c("application_id")])
    return flagged.select("application_id", "send")


@query("sent_today", s.with_(s.APPLICATIONS) + "SELECT user_id, count(*) AS sent_today FROM applications WHERE status = 'sent' AND created_at >= TIMESTAMP '1997-01-01' GROUP BY user_id")
def sent_today(t):
    rows = t.applications.withColumn("sent_at", c("created_at"))
    return ap.sent_today(rows, F.lit("1997-01-01 15:00:00").cast("timestamp"))


@query("latest_per_user", s.with_(s.APPLICATIONS) + """
SELECT user_id, application_id, status FROM applications QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, application_id DESC) = 1
""")
def latest_per_user(t):
    return ap.latest_per_user(t.applications, F.struct("created_at", "application_id"), "application_id", "status")


@query("primary_cvs", s.with_(s.APPLICATIONS) + """
SELECT user_id, application_id AS cv_id FROM applications WHERE score > 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, application_id DESC) = 1
""")
def primary_cvs(t):
    cvs = t.applications.select(
        "user_id", c("application_id").alias("cv_id"), c("created_at").alias("updated_at"), (c("score") > 40).alias("is_primary")
    )
    return ap.primary_cv(cvs).select("user_id", "cv_id")


@query("application_status", """
SELECT o_orderkey, c_name, o_orderstatus FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'
""")
def application_status(t):
    listings = t.read("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return t.orders.join(listings, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "c_name", "o_orderstatus")


@query("application_health", s.with_(s.APPLICATIONS) + """
SELECT total, failed, prepared, with_files, round(failed * 100.0 / total, 6) AS failure_percent,
  CASE WHEN failed * 100.0 / total < 5 THEN 'ok' WHEN failed * 100.0 / total < 10 THEN 'warn' ELSE 'fail' END AS verdict,
  CASE WHEN prepared = with_files THEN 'ok' WHEN with_files * 1.0 / prepared >= 0.9 THEN 'warn' ELSE 'fail' END AS files_verdict
FROM (SELECT count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('skipped', 'failed')) AS prepared,
  count(*) FILTER (status NOT IN ('skipped', 'failed') AND priority <> '5-LOW') AS with_files FROM applications)
""")
def application_health(t):
    rows = t.applications.withColumn("has_files", c("priority") != "5-LOW")
    return an.application_health(rows).withColumn("failure_percent", F.round("failure_percent", 6))


@query("purged_applications", s.with_(s.APPLICATIONS) + """
SELECT application_id, status FROM applications WHERE NOT (status IN ('preparing', 'needs_review', 'queued', 'manual_required', 'skipped', 'failed') AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE'))
""")
def purged_applications(t):
    users = t.read("customer").filter("c_mktsegment = 'AUTOMOBILE'").select(c("c_custkey").alias("user_id"))
    return ap.without_unsent(t.applications, users).select("application_id", "status")


@query("forgotten_users", "SELECT o_orderkey, o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def forgotten_users(t):
    gone = t.read("customer").filter("c_acctbal > 5000").select(c("c_custkey").alias("user_id"))
    return ap.without_users(t.orders.select("o_orderkey", c("o_custkey").alias("user_id")), gone)


@query("inserted_applications", s.with_(s.APPLICATIONS) + """
SELECT DISTINCT user_id, status FROM applications WHERE priority <> '1-URGENT' AND (user_id, status) NOT IN (SELECT (user_id, status) FROM applications WHERE priority = '1-URGENT')
""")
def inserted_applications(t):
    keys = t.applications.select("user_id", "status", "priority")
    return dg.insert_if_absent(
        keys.filter("priority = '1-URGENT'"), keys.filter("priority <> '1-URGENT'").select("user_id", "status"), ["user_id", "status"]
    )


@query("merged_settings", """
SELECT coalesce(a.c_custkey, b.c_custkey) AS user_id, coalesce(b.auto_min, a.auto_min, 80) AS auto_min, coalesce(a.daily_limit, 10) AS daily_limit, coalesce(a.auto_apply, false) AS auto_apply, 40 AS prepare_min
FROM (SELECT c_custkey, c_custkey % 100 AS auto_min, 3 AS daily_limit, c_acctbal > 0 AS auto_apply FROM customer WHERE c_nationkey < 15) a
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 55 END AS auto_min FROM customer WHERE c_nationkey > 10) b USING (c_custkey)
""")
def merged_settings(t):
    users = t.read("customer").withColumnRenamed("c_custkey", "user_id")
    i = c("user_id")

    def settings(df, **given):
        return df.select("user_id", *[given.get(n, F.lit(None).cast(kind)).alias(n) for n, kind in kinds.items()])

    kinds = {"auto_apply": "boolean", "auto_min": "int", "daily_limit": "int", "match_min": "int", "prepare_min": "int", "match_email": "boolean"}
    stored = settings(users.filter("c_nationkey < 15"), auto_min=(i % 100).cast("int"), daily_limit=F.lit(3), auto_apply=c("c_acctbal") > 0)
    update = settings(users.filter("c_nationkey > 10"), auto_min=F.when(i % 2 == 0, 55))
    return ap.merged_settings(stored, update).select("user_id", "auto_min", "daily_limit", "auto_apply", "prepare_min")


# --- preparation -----------------------------------------------------------------------------

_PREP = f"""
results AS (
  SELECT doc_id // 40 AS user_id, doc_id AS listing_id, doc_id % 40 AS pos, CAST(n_chars % 101 AS INTEGER) AS score,
    CASE WHEN n_chars % 4 = 0 THEN 'low' ELSE 'high' END AS confidence, n_chars % 9 > 0 AS has_file, doc_id % 3 > 0 AS mail, doc_id FROM documents
),
batch AS (SELECT * FROM results WHERE score >= 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos, listing_id) <= 10),
wants AS (SELECT *, mail AND user_id % 2 = 0 AND confidence <> 'low' AND score >= 60 AND has_file AS wants FROM batch),
decided AS (
  SELECT *, CASE WHEN NOT mail THEN 'no_address' WHEN user_id % 2 <> 0 THEN 'auto_off' WHEN confidence = 'low' THEN 'low_confidence' WHEN score < 60 THEN 'below_auto_score'
      WHEN used >= 2 THEN 'daily_limit' WHEN NOT has_file THEN 'no_file' END AS reason
  FROM (SELECT *, coalesce(sum(CASE WHEN wants THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos, listing_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS used FROM wants)
),
prepared AS (SELECT user_id, listing_id, CASE WHEN NOT mail THEN 'manual_required' WHEN reason IS NULL THEN 'queued' ELSE 'needs_review' END AS status, reason FROM decided)"""


def _results(t):
    i, n = c("doc_id"), c("n_chars")
    mail = F.when(i % 3 > 0, F.concat(F.lit("cv: hr@x"), i.cast("string"), F.lit(".example.com"))).otherwise("no address")
    none = F.array().cast("array<string>")
    return t.read("documents").select(
        F.floor(i / 40).alias("user_id"), i.alias("listing_id"), (i % 40).alias("pos"), (n % 101).cast("int").alias("score"),
        F.when(n % 4 == 0, "low").otherwise("high").alias("confidence"), (n % 9 > 0).alias("has_file"), mail.alias("description"),
        none.alias("requirements"), none.alias("candidate_criteria"),
    )


def _prepared(t):
    results = _results(t)
    users = results.select("user_id").distinct()
    settings = users.select(
        "user_id", (c("user_id") % 2 == 0).alias("auto_apply"), F.lit(60).alias("auto_min"), F.lit(2).alias("daily_limit"), F.lit(40).alias("prepare_min")
    )
    sent = users.filter(c("user_id") % 10 == 0).withColumn("sent_today", F.lit(1))
    return results, settings, ap.prepare(results, settings, sent)


@query("prepared_applications", s.with_(_PREP) + "SELECT user_id, listing_id, status, reason FROM prepared")
def prepared_applications(t):
    return _prepared(t)[2].select("user_id", "listing_id", "status", "reason")


@query("preparation_summary", s.with_(_PREP) + """
SELECT user_id, coalesce(p, 0) AS prepared, coalesce(q, 0) AS auto_sent, coalesce(r, 0) AS needs_review, coalesce(m, 0) AS manual_required, 0 AS failed, below_threshold FROM (
  SELECT user_id, count(*) FILTER (score < 40) AS below_threshold FROM results GROUP BY user_id) LEFT JOIN (
  SELECT user_id, count(*) AS p, count(*) FILTER (status = 'queued') AS q, count(*) FILTER (status = 'needs_review') AS r, count(*) FILTER (status = 'manual_required') AS m FROM prepared GROUP BY user_id) USING (user_id)
""")
def preparation_summary(t):
    results, settings, prepared = _prepared(t)
    return ap.preparation_summary(results, prepared, settings)


# --- result quality --------------------------------------------------------------------------

_SAVED = """
saved AS (
  SELECT doc_id // 25 AS search_id, doc_id % 25 AS pos, doc_id, toxic, CASE WHEN quality IS NULL THEN NULL ELSE quality = 1 END AS eligible,
    CASE WHEN quality = 0 THEN doc_id % 3 ELSE 0 END AS blocker_count FROM documents LEFT JOIN labels USING (doc_id)
)"""


def _saved(t):
    rows = t.read("documents").select("doc_id", "n_chars").join(t.read("labels"), "doc_id", "left")
    return rows.select(
        F.floor(c("doc_id") / 25).alias("search_id"), (c("doc_id") % 25).alias("pos"), "doc_id", (c("quality") == 1).alias("eligible"),
        F.when(c("quality") == 0, c("doc_id") % 3).otherwise(0).alias("blocker_count"), "n_chars",
    )


@query("order_violations", s.with_(_SAVED) + """
SELECT search_id, count(*) FILTER (eligible AND before) AS violations FROM (
  SELECT *, coalesce(bool_or(NOT eligible) OVER (PARTITION BY search_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM saved) GROUP BY search_id
""")
def order_violations(t):
    return an.order_violations(_saved(t))


@query("top10_quality", s.with_(_SAVED) + """
SELECT search_id, count(*) AS results, count(eligible) AS evaluated, count(*) FILTER (NOT eligible) AS rejected, count(*) FILTER (NOT eligible AND blocker_count = 0) AS unexplained,
  count(*) FILTER (pos < 10 AND eligible IS NOT NULL) AS top, count(*) FILTER (pos < 10 AND eligible) AS top_eligible FROM saved GROUP BY search_id
""")
def top10_quality(t):
    return an.result_quality(_saved(t))


@query("scenario_metrics", s.with_(_SAVED) + """
SELECT search_id, count(*) AS results, count(*) FILTER (eligible) AS eligible, count(*) FILTER (pos < 10) AS top, count(*) FILTER (pos < 10 AND doc_id % 2 = 0) AS top_in_profession,
  count(*) - count(DISTINCT n_chars) AS duplicates FROM saved JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) GROUP BY search_id
""")
def scenario_metrics(t):
    return an.scenario_metrics(_saved(t), "search_id", c("doc_id") % 2 == 0, c("n_chars"))


@query("active_count", s.with_(s.LISTINGS) + "SELECT count(*) AS active FROM base_listings WHERE status = 'active'")
def active_count(t):
    return an.active_count(t.base_listings)


@query("top_companies", s.with_(s.LISTINGS) + "SELECT company, count(*) AS n FROM base_listings WHERE status = 'active' AND length(company) BETWEEN 3 AND 60 GROUP BY company ORDER BY n DESC, company LIMIT 20")
def top_companies(t):
    return an.top_companies(t.base_listings, 20)


@query("facets", s.with_(s.LISTINGS) + """
SELECT DISTINCT 'city' AS facet, trim(split_part(location, ',', 1)) AS value FROM base_listings WHERE location IS NOT NULL
UNION SELECT DISTINCT 'work_mode', work_mode FROM base_listings WHERE work_mode IS NOT NULL
""")
def facets(t):
    return an.facets(t.base_listings)


_VIEW = "view AS (SELECT *, listing_id % 3 > 0 AS eligible, CAST(n_chars % 101 AS INTEGER) AS match_score FROM base_listings)"


def _view(t):
    return t.base_listings.withColumn("eligible", c("listing_id") % 3 > 0).withColumn("match_score", (c("n_chars") % 101).cast("int"))


@query("filtered_results", s.with_(s.LISTINGS, _VIEW) + """
SELECT listing_id, match_score FROM view WHERE NOT (eligible AND match_score < 50) AND trim(split_part(coalesce(location, ''), ',', 1)) = 'en'
ORDER BY eligible DESC, match_score DESC, posted_s DESC, listing_id
""")
def filtered_results(t):
    """Explained rejections stay visible below the score floor."""
    kept = _view(t).filter(sc.result_filter(only_eligible=False, min_score=50, city="en"))
    return kept.orderBy(*sc.result_order()).select("listing_id", "match_score")


@query("recent_results", s.with_(s.LISTINGS, _VIEW) + "SELECT listing_id FROM view WHERE eligible AND work_mode = 'remote' ORDER BY posted_s DESC, listing_id")
def recent_results(t):
    kept = _view(t).filter(sc.result_filter(only_eligible=True, work_mode="remote"))
    return kept.orderBy(*sc.result_order("recency")).select("listing_id")


@query("stored_results", s.with_(s.LISTINGS, _VIEW) + f"""
SELECT listing_id, match_score FROM view WHERE status <> 'stale' AND NOT regexp_matches({s.fold('title')}, '^(the|les|nicht)\\b')
""")
def stored_results(t):
    expired = t.base_listings.filter("status = 'stale'")
    non_listing = ql.is_non_listing_page(c("title"), c("url"), r"^(the|les|nicht)\b")
    return sc.stored_results(_view(t), expired, non_listing).select("listing_id", "match_score")


@query("criteria_counts", s.with_(s.LISTINGS) + """
SELECT listing_id, CASE WHEN n_chars % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS met, CASE WHEN n_chars % 3 = 1 THEN 1 ELSE 0 END AS partial,
  CASE WHEN n_chars % 3 = 2 THEN 1 ELSE 0 END + CASE WHEN n_chars % 5 <> 0 THEN 1 ELSE 0 END AS unmet FROM base_listings
""")
def criteria_counts(t):
    n = c("n_chars")
    first = F.when(n % 3 == 0, "met").when(n % 3 == 1, "partial").otherwise("unmet")
    second = F.when(n % 5 == 0, "met").otherwise("unmet")
    criteria = F.array(F.struct(first.alias("status")), F.struct(second.alias("status")))
    return t.base_listings.select("listing_id", an.criteria_counts(criteria).alias("x")).select("listing_id", "x.*")


# --- progress --------------------------------------------------------------------------------

_STAGE_NAMES = [name for name, _ in lx.STAGE_WEIGHTS]
_STAGE_LIST = "[" + ", ".join(s.q(x) for x in _STAGE_NAMES) + "]"
_WEIGHT = "CASE stage " + " ".join(f"WHEN {s.q(n)} THEN {w}" for n, w in lx.STAGE_WEIGHTS) + " END"


@query("stage_progress", f"""
WITH updates AS (
  SELECT user_id AS job_id, ts, event_id, list_extract({_STAGE_LIST}, CAST(event_id % 7 AS INTEGER) + 1) AS stage, event_id % 7 AS no,
    CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'signup' THEN 'skipped' WHEN 'purchase' THEN 'pending' ELSE 'failed' END AS status FROM events
),
newest AS (SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, event_id DESC) = 1),
closed AS (
  SELECT job_id, stage, CASE WHEN status = 'running' AND EXISTS (SELECT 1 FROM newest o WHERE o.job_id = n.job_id AND o.no > n.no AND (o.ts, o.event_id) > (n.ts, n.event_id)) THEN 'done' ELSE status END AS status FROM newest n
)
SELECT job_id, CAST(least(99, floor(sum(CASE WHEN status IN ('done', 'skipped') THEN {_WEIGHT} WHEN status = 'running' THEN {_WEIGHT} / 2.0 ELSE 0 END) + 0.5)) AS INTEGER) AS percent,
  count(*) FILTER (status IN ('done', 'skipped')) AS finished FROM closed GROUP BY job_id
""")
def stage_progress(t):
    stages = F.array(*[F.lit(x) for x in _STAGE_NAMES])
    kind = c("event_type")
    status = F.when(kind == "view", "running").when(kind == "click", "done").when(kind == "signup", "skipped").when(kind == "purchase", "pending").otherwise("failed")
    updates = t.events.select(
        c("user_id").alias("job_id"), "ts", "event_id", F.get(stages, (c("event_id") % 7).cast("int")).alias("stage"), status.alias("status")
    )
    return an.stage_progress(updates)


# --- digest ----------------------------------------------------------------------------------

_RECENT = "recent AS (SELECT * FROM base_listings WHERE (listing_id % 97) <= 24 AND listing_id IN (SELECT listing_id FROM listings WHERE len(requirements) > 0))"
_DIGEST = f"""
canon AS (SELECT listing_id, group_id, CASE WHEN f = '' THEN {s.url_key('url')} ELSE f END AS canonical_key, {_RICH} AS richness
  FROM (SELECT *, {s.fingerprint('title', 'company', 'location')} AS f FROM recent) JOIN grouped USING (listing_id)),
reduced AS (SELECT profile_id, listing_id, canonical_key FROM retrieved JOIN canon USING (listing_id)
  QUALIFY row_number() OVER (PARTITION BY profile_id, group_id ORDER BY richness DESC, listing_id) = 1),
digest AS (
  SELECT profile_id, listing_id, canonical_key, total, row_number() OVER (PARTITION BY profile_id ORDER BY total DESC, listing_id) AS position
  FROM reduced JOIN evaluated USING (profile_id, listing_id)
  WHERE eligible AND total >= greatest(profile_id % 70, {lx.DIGEST_FLOOR}) AND NOT EXISTS (
    SELECT 1 FROM canon k JOIN retrieved r USING (listing_id) WHERE r.profile_id = reduced.profile_id AND k.listing_id % 5 = 0 AND k.canonical_key = reduced.canonical_key)
)"""
_DIGEST_SQL = "WITH RECURSIVE " + ",\n".join(
    v.strip() for v in (*BASE, _ROLE, _EVAL, _RECENT, _CONTENT.replace("FROM base_listings", "FROM recent"), _GROUPS.replace("FROM base_listings", "FROM recent"), _DIGEST)
) + "\n"


@query("new_match_digest", _DIGEST_SQL + f"SELECT profile_id, listing_id, canonical_key, total, position FROM digest WHERE position <= {lx.DIGEST_LIMIT}")
def new_match_digest(t):
    listings = t.listings
    usable = listings.filter(F.size("requirements") > 0)
    recent = usable.filter((c("listing_id") % 97) <= 24)
    pairs = cut(rt.retrieve(t.profiles, usable))
    seen = recent.filter(c("listing_id") % 5 == 0).select("listing_id", dg.canonical_key().alias("canonical_key"))
    notified = pairs.join(seen, "listing_id").select("profile_id", "canonical_key")
    thresholds = t.profiles.select("profile_id", (c("profile_id") % 70).cast("int").alias("match_min"))
    return dg.new_matches(t.profiles, usable, notified, now(), thresholds, home_cities=HOME_CITIES, retrieved=pairs).select(
        "profile_id", "listing_id", "canonical_key", "total", "position"
    )


@query("subscribers", """
SELECT c_custkey AS user_id, lower(c_name) || '@x.example.com' AS email FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'
""")
def subscribers(t):
    customers = t.read("customer").withColumnRenamed("c_custkey", "user_id")
    settings = customers.select("user_id", (c("c_acctbal") > 0).alias("match_email"))
    mail = F.when(c("c_mktsegment") != "MACHINERY", F.concat(F.lower("c_name"), F.lit("@x.example.com"))).otherwise("")
    return dg.subscribers(settings, customers.select("user_id", mail.alias("email"))).select("user_id", "email")
