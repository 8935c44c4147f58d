"""Streaming jobs run over the event table until it is exhausted; results come back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.plans import sqltext as s
from postmill.plans.registry import query
from postmill.plans.source_queries import _HEALTH
from postmill.sources.versions import BucketTable, replacing
from postmill.streaming import health as sh
from postmill.streaming import jobs as st

c = F.col


def _events(t):
    """events as a file stream with an instant as event time."""
    schema = t.read("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return stream.withColumn("ts", c("ts").cast("timestamp"))


def _mark(t):
    """The last watermark of a query over all events, as a literal."""
    newest = t.read("events").agg(F.max(c("ts").cast("timestamp"))).first()[0]
    return F.lit(newest) - F.expr("INTERVAL 1 HOUR")


def _table(t, stream, name):
    path = st.shared_folder(t.spark, name)
    st.run_to_table(stream, path)
    return t.spark.read.parquet(path)


@query("streaming_ingest", """
SELECT user_id, event_type, last(event_id ORDER BY ts, event_id) AS event_id, round(last(value ORDER BY ts, event_id), 6) AS value, epoch_us(min(ts)) AS first_seen_us, epoch_us(max(ts)) AS last_seen_us,
  count(*) AS sightings
FROM events GROUP BY user_id, event_type
""")
def streaming_ingest(t):
    """Every event arrives from two boards; its second copy is dropped, then sightings are merged into a bucketed table."""
    path = st.shared_folder(t.spark, "ingest")
    keys = ["user_id", "event_type"]
    arrived = _events(t).withColumn("board", F.explode(F.array(F.lit("a"), F.lit("b")))).drop("props")
    fresh = st.fresh_listings(arrived, "40 days", c("event_id").cast("string")).drop("url_key", "board")
    kinds = {f.name: f.dataType.simpleString() for f in fresh.schema}
    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", first_seen timestamp, sightings long"
    table = BucketTable(t.spark, path, tuple(keys), schema, buckets=8)
    st.run_batches(fresh, path, st.into_table(table, st.newest_rows(keys, counted="sightings")))
    return table.read().select(
        *keys, "event_id", F.round("value", 6).alias("value"), F.unix_micros("first_seen").alias("first_seen_us"),
        F.unix_micros("ts").alias("last_seen_us"), "sightings",
    )


@query("streaming_health", s.with_(s.CRAWL_LOG, _HEALTH) + "SELECT source, total_runs, empty_runs, consecutive_failures AS failures, blocked FROM verdicts")
def streaming_health(t):
    path = st.shared_folder(t.spark, "health")
    failed = c("event_type") == "error"
    runs = _events(t).select(
        c("user_id").alias("source"), "ts", "event_id", c("event_type").alias("status"),
        F.when(failed | (c("event_type") == "view"), 0).otherwise(F.floor("value").cast("int") + 1).alias("parsed"),
        F.when(failed, 0).otherwise(F.floor("value").cast("int") + 2).alias("discovered"), F.lit(1).alias("searched"),
        F.when(failed & (c("value") > 60), "HTTP 403").alias("message"),
    )
    table = BucketTable(t.spark, path, ("source",), sh.health_schema(runs), buckets=8)
    st.run_batches(sh.source_states(runs), path, st.into_table(table, replacing(["source"])), "update")
    return table.read().select("source", "total_runs", "empty_runs", "failures", "blocked")


_MARK = "(SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query("windowed_matches", f"""
SELECT epoch_us(start) AS start_us, event_type, n FROM (SELECT time_bucket(INTERVAL 24 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2), {_MARK}
WHERE start + INTERVAL 24 HOUR <= mark
""")
def windowed_matches(t):
    counts = _table(t, st.windowed_counts(_events(t), "event_type"), "windows")
    return counts.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("sliding_matches", f"""
SELECT epoch_us(start) AS start_us, event_type, n FROM (
  SELECT start, event_type, count(*) AS n FROM (
    SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start, event_type FROM events, (SELECT unnest(range(0, 4)) AS k)) GROUP BY 1, 2), {_MARK}
WHERE start + INTERVAL 24 HOUR <= mark
""")
def sliding_matches(t):
    counts = _table(t, st.windowed_counts(_events(t), "event_type", slide="6 hours"), "sliding")
    return counts.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("crawl_bursts", f"""
SELECT epoch_us(start) AS start_us, event_type, n FROM (
  SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM (
    SELECT *, sum(CASE WHEN ts - prev <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM (
      SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events)) GROUP BY event_type, g), {_MARK}
WHERE finish <= mark
""")
def crawl_bursts(t):
    bursts = _table(t, st.crawl_bursts(_events(t), "event_type"), "bursts")
    return bursts.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("expired_stream", f"""
SELECT listing_id, last_seen_ms FROM (
  SELECT user_id AS listing_id, epoch_us(max(ts)) // 1000 AS last_seen_ms, max(ts) + INTERVAL 1 DAY AS finish FROM (
    SELECT *, sum(CASE WHEN ts - prev <= INTERVAL 1 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, g), {_MARK}
WHERE finish <= mark
""")
def expired_stream(t):
    """Every time a listing was not seen for a day, also of one that came back later."""
    gone = st.expired_listings(_events(t).select(c("user_id").alias("listing_id"), "ts"), days=1)
    return _table(t, gone, "expired").select("listing_id", F.unix_millis("last_seen").alias("last_seen_ms"))


_SEARCH_STREAM = """
WITH e AS (
  SELECT event_id AS search_id, user_id % 40 AS fingerprint, CASE WHEN user_id % 7 > 0 THEN user_id % 5 END AS owner, ts,
    event_type <> 'error' AS completed, event_type = 'view' AS is_copy, CAST(floor(value) AS INT) % 4 AS results FROM events
)
"""


def _searches(t):
    i = c("user_id")
    return _events(t).select(
        c("event_id").alias("search_id"), (i % 40).cast("string").alias("fingerprint"), F.when(i % 7 > 0, i % 5).alias("user_id"), "ts",
        (c("event_type") != "error").alias("completed"), (c("event_type") == "view").alias("is_copy"), (F.floor("value").cast("int") % 4).alias("result_count"),
    )


@query("reuse_stream", _SEARCH_STREAM + f"""
SELECT search_id, reused_id FROM (
  SELECT p.search_id, p.ts, q.search_id AS reused_id, row_number() OVER (PARTITION BY p.search_id ORDER BY q.ts DESC, q.search_id DESC) AS k FROM e p JOIN e q
    ON p.fingerprint = q.fingerprint AND p.owner IS NOT DISTINCT FROM q.owner AND q.completed AND NOT q.is_copy AND q.results > 0
    AND (q.ts < p.ts OR q.ts = p.ts AND q.search_id < p.search_id) AND q.ts > p.ts - INTERVAL 6 HOUR), {_MARK}
WHERE k = 1 AND ts <= mark - INTERVAL 6 HOUR
""")
def reuse_stream(t):
    """The newest original per search; searches younger than the watermark and the time to live are still open."""
    found = _table(t, st.reused_searches(_searches(t)), "reuse")
    mark = _mark(t) - F.expr("INTERVAL 6 HOURS")
    return found.filter(c("ts") <= mark).select("search_id", "reused_id")
