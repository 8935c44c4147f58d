"""Listing tables: import, upsert, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions import text as tx

SAMPLE_SCHEMA = T.StructType([
    T.StructField("platform", T.StringType()),
    T.StructField("baseUrl", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("externalId", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("workMode", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("requirements", T.ArrayType(T.StringType())),
    T.StructField("candidateCriteria", T.ArrayType(T.StringType())),
    T.StructField("url", T.StringType()),
    T.StructField("postedAt", T.StringType()),
    T.StructField("sourceQuery", T.StringType()),
])

# columns every ingest path delivers
CRAWLED = [
    "platform", "category", "external_id", "title", "company", "location", "work_mode", "description",
    "requirements", "candidate_criteria", "url", "source_query", "posted_at",
]


def category_of(c: Column) -> Column:
    return F.when(c.isin("tech", "public"), c).otherwise("general")


def read_listing_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of listings; rows without title or URL are skipped."""
    c = F.col
    none = F.array().cast("array<string>")
    raw = spark.read.schema(SAMPLE_SCHEMA).option("multiLine", True).json(path)
    return raw.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")).select(
        "platform", category_of(c("category")).alias("category"), c("externalId").alias("external_id"), "title",
        "company", "location", tx.known_work_mode(F.lower(F.trim("workMode"))).alias("work_mode"), "description",
        F.coalesce("requirements", none).alias("requirements"),
        F.coalesce("candidateCriteria", none).alias("candidate_criteria"), "url",
        c("sourceQuery").alias("source_query"), F.try_to_timestamp("postedAt").alias("posted_at"),
    )


def base_url_of(name: Column) -> Column:
    slug = F.regexp_replace(tx.turkish_lower(name), "[^a-z0-9]+", "")
    return F.concat(F.lit("https://www."), F.when(slug == "", F.lit("kaynak")).otherwise(slug), F.lit(".com"))


def upsert_sources(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources by name: known ones stay, new ones get a category and a derived base URL."""
    fresh = seen.groupBy("name").agg(F.first("base_url", ignorenulls=True).alias("_url"), F.min("category").alias("_category"))
    return existing.join(fresh, "name", "full_outer").select(
        "name",
        F.coalesce("base_url", F.when(F.col("_url") != "", F.col("_url")), base_url_of(F.col("name"))).alias("base_url"),
        F.coalesce("category", category_of(F.col("_category"))).alias("category"),
    )


def seed_registry(existing: DataFrame, seeds: DataFrame, overwrite: list[str]) -> DataFrame:
    """Seed rows by name: `overwrite` columns take the seed value, counters and state stay."""
    old, new = existing.alias("o"), seeds.alias("n")
    columns = [
        F.coalesce(F.col(f"n.{x}"), F.col(f"o.{x}")).alias(x) if x in overwrite and x in seeds.columns
        else F.coalesce(F.col(f"o.{x}"), F.col(f"n.{x}")).alias(x) if x in seeds.columns
        else F.col(f"o.{x}").alias(x)
        for x in existing.columns if x != "name"
    ]
    return old.join(new, "name", "full_outer").select("name", *columns)


def prepare_rows(crawled: DataFrame, now: Column, checked: bool = True) -> DataFrame:
    """Crawled rows as table rows: whole texts and lists, content hash, life-cycle columns."""
    def listed(name: str) -> Column:
        items = F.filter(F.coalesce(name, F.array().cast("array<string>")), lambda x: x != "")
        return items.alias(name)

    c = F.col
    rows = crawled.select(
        "platform", "category", "external_id", "title", "company", "location",
        tx.known_work_mode(c("work_mode")).alias("work_mode"),
        F.coalesce("description", F.lit("")).alias("description"),
        listed("requirements"), listed("candidate_criteria"), "url", "source_query", "posted_at",
    )
    return rows.select(
        "*", tx.content_hash(c("title"), c("company"), c("description"), c("requirements")).alias("content_hash"),
        F.lit("active").alias("status"), F.lit(0).alias("error_count"), now.alias("first_seen_at"),
        now.alias("last_seen_at"), (now if checked else F.lit(None).cast("timestamp")).alias("last_checked_at"),
    )


KEEP_IF_NULL = ["posted_at", "source_query", "last_checked_at"]


def upsert_listings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after the batch, one row per (platform, url).

    Content comes from the newest row, `KEEP_IF_NULL` columns from the newest row that has a value,
    first_seen_at from the oldest. All of it is one aggregation with map-side combine, so a URL or
    platform with very many versions does not need a window.
    """
    versions = existing.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    keys = ["platform", "url"]
    at = F.struct("_v", "last_seen_at", "content_hash")
    content = [x for x in existing.columns if x not in [*keys, *KEEP_IF_NULL, "first_seen_at", "last_seen_at"]]
    merged = versions.groupBy(*keys).agg(
        F.max_by(F.struct(*content), at).alias("_row"),
        *[F.max_by(x, F.when(F.col(x).isNotNull(), at)).alias(x) for x in KEEP_IF_NULL],
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
    )
    return merged.select(
        *[F.col(f"_row.{x}").alias(x) if x in content else F.col(x) for x in existing.columns]
    )


def write_listings(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").partitionBy("status").parquet(path)


def read_active(spark: SparkSession, path: str, sources: DataFrame | None = None) -> DataFrame:
    """Active listings, joined to their sources; the status filter prunes partitions."""
    active = spark.read.parquet(path).filter("status = 'active'").withColumn(
        "location", tx.dedupe_location_segments(F.col("location"))
    )
    return active if sources is None else active.join(sources, active["platform"] == sources["name"])


def expire(listings: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    flag = gone.select("listing_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False))
    return (
        listings.join(flag, "listing_id", "left")
        .withColumn("status", F.when(hit, "expired").otherwise(F.col("status")))
        .withColumn("last_checked_at", F.when(hit, now).otherwise(F.col("last_checked_at")))
        .drop("_gone")
    )


def verification_queue(listings: DataFrame, limit: int = 50) -> DataFrame:
    """Never-checked listings first, then the longest unchecked."""
    return (
        listings.filter(F.col("status").isin("active", "stale"))
        .orderBy(F.asc_nulls_first("last_checked_at"), "listing_id").limit(max(1, min(500, limit)))
    )
