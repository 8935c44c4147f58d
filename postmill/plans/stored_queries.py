"""Changes to stored tables, and feeds landed as files; each works in a new folder of the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions import text as tx
from postmill.operators import applications as ap
from postmill.plans import sqltext as s
from postmill.plans.registry import query
from postmill.plans.source_queries import UPSERT_SQL, old_and_new_listings
from postmill.plans.tables import now
from postmill.sources import feeds as fd
from postmill.sources import listings as ls
from postmill.sources.versions import BucketTable, appending_absent, removing
from postmill.streaming.jobs import shared_folder

c = F.col
BUCKETS = 16


def _ddl(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _stored(t, df, name, *keys):
    """`df` as change 0 of a new table."""
    table = BucketTable(t.spark, shared_folder(t.spark, name), keys, _ddl(df), BUCKETS)
    table.change(0, df, lambda before, rows: rows)
    return table


@query("stored_upsert", UPSERT_SQL)
def stored_upsert(t):
    """The listing upsert as a change of a bucketed table."""
    old, new = old_and_new_listings(t)
    table = _stored(t, old, "listings", "platform", "url")
    table.change(1, new, ls.upsert_listings)
    return table.read().select(
        "platform", "url", "title", F.unix_seconds("posted_at").alias("posted_s"), F.unix_seconds("first_seen_at").alias("first_seen_s"),
        F.unix_seconds("last_seen_at").alias("last_seen_s"), "error_count",
    )


@query("expired_tables", s.with_(s.LISTINGS, s.APPLICATIONS) + """,
a AS (SELECT application_id, status, application_id % 300 AS listing_id FROM applications)
SELECT 'listing' AS kind, listing_id AS id, CASE WHEN listing_id % 5 = 0 THEN 'expired' ELSE status END AS status FROM base_listings
UNION ALL
SELECT 'application', application_id, CASE WHEN listing_id % 5 = 0 AND status IN ('needs_review', 'manual_required', 'queued', 'preparing') THEN 'skipped' ELSE status END FROM a
""")
def expired_tables(t):
    """Listings that are gone expire in their table; their pending applications close in theirs."""
    listings = t.base_listings.select("listing_id", "status", "last_checked_at")
    applications = t.applications.select("application_id", "status", (c("application_id") % 300).alias("listing_id"), F.lit(None).cast("string").alias("message"))
    listed, applied = _stored(t, listings, "listings", "listing_id"), _stored(t, applications, "applications", "listing_id")
    gone = listings.filter("listing_id % 5 = 0").select("listing_id")
    listed.change(1, gone, lambda before, ids: ls.expire(before, ids, now()))
    closed = t.applications.select((c("application_id") % 300).alias("listing_id")).filter("listing_id % 5 = 0").distinct()
    applied.change(1, closed, lambda before, ids: ap.close_pending(before, ids, "closed"))
    return listed.read().select(F.lit("listing").alias("kind"), c("listing_id").alias("id"), "status").unionByName(
        applied.read().select(F.lit("application").alias("kind"), c("application_id").alias("id"), "status")
    )


@query("stored_purge", s.with_(s.APPLICATIONS) + """
SELECT application_id, user_id, status FROM applications WHERE NOT (user_id % 7 = 0 AND status <> 'sent')
UNION ALL SELECT 100000000 + c_custkey, c_custkey, 'queued' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey NOT IN (SELECT user_id FROM applications WHERE status = 'sent')
""")
def stored_purge(t):
    """Unsent applications of users with a new CV go; users who have none then get one: a purge, then an insert if absent."""
    table = _stored(t, t.applications.select("application_id", "user_id", "status"), "applications", "user_id")
    renewed = t.read("customer").filter("c_custkey % 7 = 0").select(c("c_custkey").alias("user_id"))
    table.change(1, renewed, removing(["user_id"], unless=c("status") == "sent"))
    first = renewed.select((c("user_id") + 100_000_000).alias("application_id"), "user_id", F.lit("queued").alias("status"))
    table.change(2, first, appending_absent(["user_id"]))
    return table.read()


# --- feeds ---------------------------------------------------------------------------------------

_PAGE = 8000
_TOKENS = ["the", "und", "que"]
_FEED_SQL = f"""
WITH d AS (
  SELECT doc_id, source, ['greenhouse', 'lever', 'remoteok-api', 'rss'][1 + doc_id % 4] AS kind, doc_id // {_PAGE} AS page, regexp_replace(text, '[<>&\\]]', ' ', 'g') AS text
  FROM documents WHERE text IS NOT NULL
), r AS (
  SELECT doc_id, kind, source || '-' || kind || '-' || page AS feed, {s.squeeze('text')} AS description, {s.squeeze("'Role ' || doc_id")} AS title,
    right(source, 1) IN ('1', '4', '7') AS away FROM d
), k AS (
  SELECT *, CASE WHEN kind = 'greenhouse' THEN feed WHEN kind = 'lever' THEN feed ELSE 'Firm ' || doc_id % 10 END AS company FROM r
  WHERE {' OR '.join(f"contains({s.norm("title || ' ' || description")}, '{w}')" for w in _TOKENS)}
), n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY doc_id) AS pos FROM k)
SELECT feed AS platform, title, company, CASE WHEN kind = 'rss' THEN NULL ELSE doc_id::VARCHAR END AS external_id, 'https://x.example/' || doc_id AS url,
  CASE WHEN kind IN ('rss', 'remoteok-api') THEN 'Remote' ELSE 'City ' || doc_id % 9 END AS location, md5(CASE WHEN description = '' THEN title ELSE description END) AS description_md5,
  CASE WHEN kind IN ('lever', 'greenhouse') THEN 1704067200 + doc_id END AS posted_s
FROM n WHERE NOT away OR pos <= 12
"""


def _landed(t):
    """documents as pages of feeds in four formats, one folder a feed, a feed for every source, format and _PAGE ids."""
    kinds, i = F.array(*map(F.lit, ["greenhouse", "lever", "remoteok-api", "rss"])), c("doc_id")
    text = F.regexp_replace("text", "[<>&\\]]", " ")
    docs = t.documents.filter(c("text").isNotNull()).select(
        "doc_id", F.get(kinds, F.pmod(i, F.lit(4)).cast("int")).alias("kind"), F.floor(i / _PAGE).alias("page"), "source", text.alias("text"),
        F.concat(F.lit("Role "), i).alias("title"), F.concat(F.lit("https://x.example/"), i).alias("url"), F.concat(F.lit("City "), i % 9).alias("city"),
        F.concat(F.lit("Firm "), i % 10).alias("firm"), (i + 1_704_067_200).alias("posted"),
    ).withColumn("feed", F.concat_ws("-", "source", "kind", "page"))
    item = F.when(c("kind") == "greenhouse", F.to_json(F.struct(
        i.alias("id"), "title", c("url").alias("absolute_url"), F.struct(c("city").alias("name")).alias("location"), c("text").alias("content"),
        F.date_format(F.timestamp_seconds("posted"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    ))).when(c("kind") == "lever", F.to_json(F.struct(
        i.alias("id"), c("title").alias("text"), c("url").alias("hostedUrl"), F.struct(c("city").alias("location")).alias("categories"), c("text").alias("descriptionPlain"),
        (c("posted") * 1000).alias("createdAt"),
    ))).when(c("kind") == "remoteok-api", F.to_json(F.struct(
        i.alias("id"), c("title").alias("position"), "url", c("firm").alias("company"), c("text").alias("description"), F.array(F.lit("x")).alias("tags"),
    ))).otherwise(F.concat(
        F.lit("<item><title>"), "firm", F.lit(": "), "title", F.lit("</title><link>"), "url", F.lit("</link><description><![CDATA["), "text", F.lit("]]></description></item>"),
    ))
    pages = docs.groupBy("feed", "kind", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    items = F.when(c("kind") == "rss", F.array_join("items", "\n")).otherwise(F.array_join("items", ",\n"))
    body = F.when(c("kind") == "greenhouse", F.concat(F.lit('{"jobs": ['), items, F.lit("]}"))).when(c("kind") == "lever", F.concat(F.lit("["), items, F.lit("]"))).when(
        c("kind") == "remoteok-api", F.concat(F.lit('[{"legal": "notice"}, '), items, F.lit("]"))).otherwise(F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")))
    folder = shared_folder(t.spark, "feeds")
    pages.select(c("feed"), body.alias("value")).write.partitionBy("feed").text(folder)
    registry = pages.select(
        c("feed").alias("source"), F.concat(F.lit("feed="), "feed").alias("feed"), F.when(c("kind") == "rss", "rss").otherwise("json-api").alias("access_method"),
        c("kind").alias("platform_type"), F.when(F.right("source", F.lit(1)).isin("1", "4", "7"), "US").alias("country"),
    )
    return folder, registry


@query("landed_feeds", _FEED_SQL)
def landed_feeds(t):
    folder, registry = _landed(t)
    rows = fd.read_feeds(t.spark, folder, registry, _TOKENS)
    return rows.select(
        "platform", "title", "company", "external_id", "url", "location", F.md5("description").alias("description_md5"), F.unix_seconds("posted_at").alias("posted_s")
    )
