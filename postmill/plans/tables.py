"""The driver tables seen as listings, profiles, crawl log, applications and so on.

Invented prose has no job vocabulary, so structured fields are derived from ids and lengths;
the same derivations are written in SQL in `sqltext`.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import text as tx

NOW = 1_707_955_200  # 2024-02-15 00:00:00 UTC
DAY = 86_400
HOME_CITIES = ["en", "de"]


def now() -> Column:
    return F.timestamp_seconds(F.lit(NOW))


def at(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        # zone-less times of the tables are read as UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, key: str, *columns: str, by: tuple[str, ...] = (), tasks: int = 1) -> DataFrame:
        """Text tables in too few splits are spread over the cores; big ones are read as they lie. The rows are the same.

        Where a row costs much, more `tasks` a core keep each short; `by` are further columns that rows are dealt by.
        """
        df = self.read(name)
        if columns:
            df = df.select(*columns)
        parts = tasks * self.spark.sparkContext.defaultParallelism
        return df.repartition(parts, key, *by) if df.rdd.getNumPartitions() < parts else df

    def dealt(self, df: DataFrame, key: str, tasks: int = 4) -> DataFrame:
        """`df` dealt by `key` into `tasks` a core at least. Rows that are few bytes but much work keep that number,
        where an exchange without one would be merged into a few tasks by its bytes."""
        parts = max(tasks * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return df.repartition(parts, key)

    @cached_property
    def documents(self) -> DataFrame:
        return self.spread("documents", "doc_id")

    @cached_property
    def pages(self) -> DataFrame:
        return self.spread("pages", "page_id")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    @cached_property
    def orders(self) -> DataFrame:
        return self.read("orders")

    @cached_property
    def base_listings(self) -> DataFrame:
        """Listings without the parsed requirement lines."""
        c = F.col
        title = F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 100))
        docs = self.documents.select("doc_id", "lang", "source", "n_chars", "text", title.alias("title"))
        source, n, i = c("source"), c("n_chars"), c("doc_id")
        return docs.select(
            i.alias("listing_id"),
            source.alias("platform"),
            c("lang").alias("country"),
            F.lit("general").alias("category"),
            "title",
            F.concat_ws(" ", "lang", F.substring_index(tx.normalize(c("title")), " ", 1)).alias("company"),
            F.when(n % 5 != 0, F.concat_ws(", ", "lang", "source")).alias("location"),
            F.when(source.isin("src0", "src5"), "remote").when(source.isin("src1", "src6"), "hybrid")
            .when(source == "src2", "onsite").alias("work_mode"),
            c("text").alias("description"),
            F.concat(
                F.lit("https://"), source, F.lit(".example.com/jobs/"), tx.slugify(F.substring("title", 1, 60)),
                F.when(i % 2 == 0, "/").otherwise(""),
            ).alias("url"),
            F.when(n < 100, "stale").otherwise("active").alias("status"),
            (F.lit(NOW) - (i % 40) * DAY - i).alias("last_seen"),
            at(F.lit(NOW) - (i % 40) * DAY - i).alias("last_seen_at"),
            at(F.lit(NOW) - (n % 45) * DAY).alias("posted_at"),
            at(F.lit(NOW) - (i % 97) * 3600).alias("first_seen_at"),
            F.when(i % 7 != 0, at(F.lit(NOW) - (i % 13) * DAY)).alias("last_checked_at"),
            "n_chars",
        )

    @cached_property
    def listings(self) -> DataFrame:
        return self.parsed(self.base_listings)

    def parsed(self, listings: DataFrame) -> DataFrame:
        """Listings with requirement lines (the whole text, twelve words a line) and criteria lines."""
        c = F.col
        n = c("n_chars")
        # signs go before words are taken, so a word of signs alone leaves none behind; one pass cuts the lines
        plain = F.translate(tx.fold(F.coalesce("description", F.lit(""))), ".+#", "")
        words = F.array_join(F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0)), " ")
        lines = F.regexp_extract_all(words, F.lit("(?:[^ ]++ ){0,11}[^ ]++"), F.lit(0))
        requirements = F.filter(lines, lambda x: F.length(x) >= 8)
        criteria = F.filter(
            F.array(
                F.when(n % 7 == 0, F.lit("Tecrübe Tecrübesiz")).otherwise(
                    F.concat(F.lit("Tecrübe En az "), (n % 7).cast("string"), F.lit(" yıl tecrübeli"))
                ),
                F.when(n % 3 == 0, "Eğitim Seviyesi Üniversite(Mezun)")
                .when(n % 3 == 1, "Eğitim Seviyesi Lise(Mezun), Üniversite(Öğrenci)"),
                F.when(n % 4 == 0, "Yabancı Dil İngilizce(Okuma : İleri, Yazma : İyi)"),
            ),
            lambda x: x.isNotNull(),
        )
        return listings.withColumn("requirements", requirements).withColumn("candidate_criteria", criteria)

    @cached_property
    def profiles(self) -> DataFrame:
        c = F.col
        i = c("item_id")
        rows = self.read("benchmark").select(
            "item_id", tx.words(F.regexp_replace(tx.normalize(c("text")), "[.+#]", "")).alias("w")
        )

        def phrase(start: int) -> Column:
            return F.array_join(F.slice("w", start, 2), " ")

        def some(start: int, least: int) -> Column:
            return F.filter(F.array_distinct(F.slice("w", start, F.greatest(F.size("w"), F.lit(1)))), lambda x: F.length(x) >= least)

        none = F.array().cast("array<string>")
        return rows.select(
            i.alias("profile_id"), phrase(1).alias("target_role"), F.array(phrase(1), phrase(3)).alias("titles"),
            some(5, 4).alias("skills"), some(8, 3).alias("keywords"), F.array(phrase(5)).alias("query_variations"),
            F.when(i % 2 == 0, F.array(F.lit("İngilizce"))).when(i % 4 == 1, F.array(F.lit("Almanca"))).otherwise(none).alias("languages"),
            F.when(i % 3 == 0, F.array(F.lit("en"))).otherwise(none).alias("locations"),
            F.when(i % 3 == 0, "cities").otherwise("all-turkey").alias("location_mode"),
            F.when(i % 4 == 1, "remote").when(i % 4 == 2, "hybrid").otherwise("any").alias("work_mode"),
            F.when(i % 5 == 0, "stajyer").when(i % 5 == 1, "Junior").when(i % 5 == 2, "senior").alias("seniority"),
            F.when(i % 11 == 0, "stajyer").alias("desired_seniority"),
            F.when(i % 10 != 7, (i % 9).cast("int")).alias("years_of_experience"),
            F.when(i % 3 == 0, "lise").when(i % 3 == 1, "Lisans öğrenci").when(i % 7 == 2, "yüksek lisans").alias("education_level"),
        )

    @cached_property
    def crawl_log(self) -> DataFrame:
        """events as crawl runs: `error` is a failed run, half of the others parsed nothing."""
        c = F.col
        failed = c("event_type") == "error"
        parsed = F.when(failed | (c("event_type") == "view"), 0).otherwise(F.floor("value").cast("int") + 1)
        return self.events.select(
            c("user_id").alias("source"), c("ts").cast("timestamp").alias("ts"), "event_id", c("event_type").alias("status"),
            parsed.alias("parsed"),
            F.when(failed, 0).otherwise(F.floor("value").cast("int") + 2).alias("discovered"),
            F.lit(1).alias("searched"),
            F.when(failed & (c("value") > 60), "HTTP 403").alias("message"),
        )

    @cached_property
    def scan_log(self) -> DataFrame:
        c = F.col
        return self.events.select(
            c("user_id").alias("source"), c("ts").cast("timestamp").alias("ts"), "event_id",
            (c("event_type") != "error").alias("succeeded"),
            F.floor("value").cast("int").alias("new_jobs"), F.floor(c("value") / 2).cast("int").alias("relevant_jobs"),
            F.floor(c("value") / 5).cast("int").alias("duplicate_jobs"),
            (c("value") > 250).alias("rate_limited"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        """supplier as source registry."""
        c = F.col
        i = c("s_suppkey")
        kinds = ["general-board", "niche-board", "ats", "remote-board", "company-career", "aggregator"]
        tags = ["tech,genel", "saglik", "finans", "genel", "tech", "egitim,genel", "muhendislik"]
        table = F.array(*[F.lit(k) for k in kinds])
        labels = F.array(*[F.lit(t) for t in tags])
        return self.read("supplier").select(
            c("s_name").alias("name"), F.when(c("s_nationkey") < 15, "TR").otherwise("US").alias("country"),
            F.get(table, (i % 6).cast("int")).alias("source_type"),
            F.when(i % 17 == 0, "candidate").otherwise("active").alias("status"),
            (i % 60 + 1).cast("int").alias("priority"),
            (F.pmod(c("s_acctbal"), F.lit(100.0)) / 100).alias("reliability"),
            F.when(i % 5 != 0, at(F.lit(NOW) - (i % 72) * 3600)).alias("last_scanned_at"),
            (i % 4).cast("int").alias("total_scans"), F.when(i % 3 == 0, 0).otherwise((i % 4).cast("int")).alias("successful_scans"),
            (i % 23).cast("int").alias("new_jobs"), (i % 11).cast("int").alias("relevant_jobs"),
            (i % 7).cast("int").alias("duplicate_jobs"), F.get(labels, (i % 7).cast("int")).alias("profession_tags"),
        )

    @cached_property
    def applications(self) -> DataFrame:
        """orders as applications of customers."""
        c = F.col
        k = c("o_orderkey")
        status = (
            F.when(c("o_orderstatus") == "O", F.when(k % 2 == 0, "needs_review").otherwise("manual_required"))
            .when(c("o_orderstatus") == "F", F.when(k % 5 == 0, "failed").otherwise("sent"))
            .otherwise(F.when(k % 3 == 0, "queued").when(k % 3 == 1, "preparing").otherwise("skipped"))
        )
        return self.orders.select(
            k.alias("application_id"), c("o_custkey").alias("user_id"), c("o_orderkey").alias("listing_key"),
            status.alias("status"), F.floor(c("o_totalprice") / 5000).cast("int").alias("score"),
            c("o_orderdate").cast("timestamp").alias("created_at"), c("o_orderpriority").alias("priority"),
        )
