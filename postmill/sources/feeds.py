"""Structured feeds landed as files: board APIs and RSS, all of them in one scan and one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.functions import quality as ql
from postmill.functions import text as tx
from postmill.sources.listings import CRAWLED

FOREIGN_FEED_LIMIT = 12

#: Where each board keeps its items and their fields: fixed by the boards' formats.
ITEMS = {"greenhouse": "$.jobs", "lever": "$", "remoteok-api": "$"}
FIELDS = {
    "greenhouse": {
        "id": "$.id", "title": "$.title", "url": "$.absolute_url", "location": "$.location.name", "description": "$.content", "posted": "$.updated_at",
    },
    "lever": {
        "id": "$.id", "title": "$.text", "url": "$.hostedUrl", "location": "$.categories.location", "description": "$.descriptionPlain",
        "other_description": "$.description", "posted_ms": "$.createdAt",
    },
    "remoteok-api": {
        "id": "$.id", "title": "$.position", "url": "$.url", "company": "$.company", "location": "$.location", "description": "$.description", "posted": "$.date",
    },
}
RSS = "rss"
RSS_FIELDS = {"title": "title", "url": "link", "location": "region", "description": "description", "posted": "pubDate"}


def _text(c: Column) -> Column:
    return tx.clean_html(c.cast("string"))


def _optional(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def rss_date(c: Column) -> Column:
    """RFC 822 dates; the weekday carries no information and Spark's parser rejects it."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(bare, r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c)
    )


def reader_kind(access_method: Column, platform_type: Column) -> Column:
    """What reads a feed; null for types that nothing reads, which yield no rows and no error."""
    return F.when(access_method == "rss", RSS).when(platform_type.isin(list(ITEMS)), platform_type)


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(feed, body) of every file below `folder`; the feed is the first name on its path from there, without an ending."""
    below = F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + _quoted(folder.rstrip("/").split("://")[-1].lstrip("/")) + "/+", "")
    name = F.regexp_replace(F.substring_index(below, "/", 1), r"\.[A-Za-z0-9]+$", "")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("feed"), F.col("value").alias("body"))


def _quoted(text: str) -> str:
    return r"\Q" + text.replace("\\E", "\\E\\\\E\\Q") + r"\E"


def _items(kind: Column, body: Column) -> Column:
    """Items of a feed in its order: a parsed value for boards, the block's text for RSS."""
    json = F.try_parse_json(F.when(kind != RSS, body))
    boards = F.coalesce(*[F.when(kind == k, F.try_variant_get(json, path, "array<variant>")) for k, path in ITEMS.items()])
    blocks = F.split(F.when(kind == RSS, body), r"(?i)<item\b[^>]*>")
    return F.coalesce(
        F.transform(boards, lambda v: F.struct(v.alias("json"), F.lit(None).cast("string").alias("block"))),
        F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks), F.lit(1))), lambda b: F.struct(F.lit(None).cast("variant").alias("json"), b.alias("block"))),
    )


def _field(name: str) -> Column:
    """A field of the item by its board's path or its RSS tag, as text."""
    kind, item = F.col("kind"), F.col("item")
    found = [F.when(kind == k, F.try_variant_get(item["json"], paths[name], "string")) for k, paths in FIELDS.items() if name in paths]
    if name in RSS_FIELDS:
        tag = RSS_FIELDS[name]
        inner = F.regexp_extract(item["block"], rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)
        found.append(F.when(kind == RSS, F.regexp_replace(inner, r"<!\[CDATA\[|\]\]>", "")))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _posted() -> Column:
    item = F.col("item")["json"]
    number = F.schema_of_variant(F.try_variant_get(item, FIELDS["lever"]["posted_ms"], "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    millis = F.when((F.col("kind") == "lever") & number, F.try_variant_get(item, FIELDS["lever"]["posted_ms"], "double").cast("long"))
    return F.coalesce(F.timestamp_millis(millis), F.when(F.col("kind") == RSS, rss_date(_field("posted"))).otherwise(F.try_to_timestamp(_field("posted"))))


def read_feeds(spark: SparkSession, folder: str, registry: DataFrame, tokens: list[str], foreign_limit: int | None = FOREIGN_FEED_LIMIT) -> DataFrame:
    """Listings of all landed feeds that the registry knows: one scan, one join, one explode, whatever the number of feeds.

    Registry: source, feed (name of its file or folder below `folder`), access_method, platform_type, country (null is
    home). Items without title or URL are skipped; those with none of the `tokens` too. A foreign source gives its first
    `foreign_limit` items, in feed order. Texts are whole. A file that can't be parsed, a feed that nobody
    registered and a type that nobody reads give no rows. Only one file at a time is held whole.
    """
    c = F.col
    known = registry.select(
        "source", "feed", F.coalesce("country", F.lit("TR")).alias("country"), reader_kind(c("access_method"), c("platform_type")).alias("kind")
    ).filter(c("kind").isNotNull())
    items = landed_files(spark, folder).join(known, "feed").select("source", "country", "kind", F.posexplode(_items(c("kind"), c("body"))).alias("pos", "item"))

    remote, board = c("kind").isin("remoteok-api", RSS), c("kind")
    title, cut = _text(_field("title")), F.instr("_title", ":")
    two_part = (board == RSS) & (cut > 1)
    name = F.trim(F.regexp_replace("source", "(?i)^(greenhouse|lever):\\s*", ""))
    tags = F.when(board == "remoteok-api", F.array_join(F.coalesce(F.try_variant_get(c("item")["json"], "$.tags", "array<string>"), F.array().cast("array<string>")), " "))
    none = F.array().cast("array<string>")
    # generators run once an item; projections would be computed again by the filters on what they give
    made = F.struct(
        c("source").alias("platform"), F.lit("tech").alias("category"), _field("id").alias("external_id"),
        F.when(two_part, F.trim(F.substring("_title", cut + 1, F.length("_title")))).otherwise(c("_title")).alias("title"),
        F.when(two_part, F.trim(F.substring("_title", F.lit(1), cut - 1))).when(board == "remoteok-api", _optional(_text(_field("company"))))
        .when(board != RSS, name).alias("company"),
        F.coalesce(_optional(_text(_field("location"))), F.when(remote, "Remote")).alias("location"), F.when(remote, "remote").alias("work_mode"),
        _text(F.coalesce(_field("description"), _field("other_description"))).alias("_description"), none.alias("requirements"), none.alias("candidate_criteria"),
        _text(_field("url")).alias("url"), F.lit(" ".join(tokens[:3])).alias("source_query"), _posted().alias("posted_at"), tags.alias("_tags"),
    )
    rows = items.select("*", F.explode(F.array(title)).alias("_title")).select("pos", "country", F.inline(F.array(made)))
    complete = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    wanted = ql.matches_any_token(F.concat_ws(" ", "title", "_tags", "_description"), tx.lit_array(tokens))
    kept = rows.filter(complete & wanted).withColumn("description", F.when(c("_description") != "", c("_description")).otherwise(c("title")))
    return capped_foreign(kept, c("country") == "TR", foreign_limit).select(*CRAWLED)


def capped_foreign(listings: DataFrame, home: Column, limit: int | None = FOREIGN_FEED_LIMIT) -> DataFrame:
    """At most `limit` listings per foreign source, in feed order (column `pos`); home sources don't pass the window."""
    if limit is None:
        return listings
    by = Window.partitionBy("platform").orderBy("pos", "url")
    first = listings.filter(~home).withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= limit).drop("_rank")
    return listings.filter(home).unionByName(first)
