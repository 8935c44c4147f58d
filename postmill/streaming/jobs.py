"""Streaming forms of the batch jobs. Inputs carry an event time `ts` (TIMESTAMP)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.functions import text as tx
from postmill.session import ensure_checkpoint_dir
from postmill.sources.versions import BucketTable, Merge


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- tables behind foreachBatch ---------------------------------------------------------------


def into_table(table: BucketTable, merge: Merge):
    """foreachBatch function: batch N is change N of the table, so a batch that is run again changes nothing."""
    def run(batch: DataFrame, batch_id: int) -> None:
        table.change(batch_id, batch, merge)

    return run


# --- K1 ingest -------------------------------------------------------------------------------


def fresh_listings(stream: DataFrame, horizon: str = "7 days", key: Column | None = None) -> DataFrame:
    """First sighting of every URL within the horizon."""
    return (
        stream.withWatermark("ts", horizon)
        .withColumn("url_key", tx.url_key(F.col("url")) if key is None else key)
        .dropDuplicatesWithinWatermark(["url_key"])
    )


def newest_rows(keys: list[str], at: str = "ts", tie: str = "event_id", counted: str | None = None) -> Merge:
    """Newest row per key by (at, tie); first sighting kept as `first_seen`; column `counted` adds up sightings."""
    def merge(before: DataFrame, batch: DataFrame) -> DataFrame:
        rows = batch.withColumn("first_seen", F.col(at))
        if counted:
            rows = rows.withColumn(counted, F.lit(1).cast("long"))
        every = before.unionByName(rows)
        folded = ["first_seen", counted] if counted else ["first_seen"]
        others = [c for c in rows.columns if c not in [*keys, *folded]]
        total = [F.sum(counted).alias(counted)] if counted else []
        merged = every.groupBy(*keys).agg(
            F.max_by(F.struct(*others), F.struct(at, tie)).alias("_row"), F.min("first_seen").alias("first_seen"), *total
        )
        return merged.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others], *folded)

    return merge


# --- K3, K6 windows ---------------------------------------------------------------------------


def windowed_counts(stream: DataFrame, key: str, late: str = "1 hour", size: str = "24 hours", slide: str | None = None) -> DataFrame:
    """Rows per key and window; rows later than the watermark are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        stream.withWatermark("ts", late).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


def crawl_bursts(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a source: runs with no pause longer than the gap."""
    return (
        stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
    )


# --- K4 expiry --------------------------------------------------------------------------------


def expired_listings(stream: DataFrame, days: int = lx.EXPIRE_AFTER_DAYS, late: str = "1 hour") -> DataFrame:
    """(listing_id, last_seen) whenever a listing was not seen for `days` of event time.

    A listing's sightings with no pause of `days` are one session, which ends `days` after the last of them: its
    expiry. A listing that comes back expires again later. The result doesn't depend on how rows fall into batches.
    Sessions are merged within each input partition first, so a listing with very many sightings sends a few rows.
    """
    return (
        stream.withWatermark("ts", late).groupBy(F.session_window("ts", f"{days} days"), "listing_id").agg(F.max("ts").alias("last_seen"))
        .select("listing_id", "last_seen")
    )


# --- K5 reuse ---------------------------------------------------------------------------------


def _newest_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every search of the groups with the newest original before it in its group: one sort, whatever the number of pairs.

    Ids without value tell nothing about the order within a moment: such a search follows no original of its own moment,
    such an original precedes nothing of its own moment and stands back behind the others there.
    """
    for batch in batches:
        lists = batch.column("rows")
        rows, ids = lists.flatten(), lists.flatten().field("id")
        group = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        us, asked, usable = (rows.field(n).to_numpy(zero_copy_only=False) for n in ("us", "asked", "usable"))
        rank = pc.rank(ids, tiebreaker="dense").to_numpy(zero_copy_only=False).astype("int64")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        # searches first, then originals: a search doesn't precede itself
        row = np.r_[np.flatnonzero(asked), np.flatnonzero(usable)]
        original = np.r_[np.zeros(asked.sum(), bool), np.ones(usable.sum(), bool)]
        class_ = np.where(known[row], 1, np.where(original, 2, 0))
        order = np.lexsort((original, rank[row], class_, us[row], group[row]))
        row, original, class_ = row[order], original[order], class_[order]
        for again in (True, False):
            before = np.r_[-1, np.maximum.accumulate(np.where(original, np.arange(len(row)), -1))][:-1]
            near = row[before]
            if again:
                late = original & (class_ == 2) & (before >= 0) & (group[near] == group[row]) & (us[near] == us[row]) & known[near]
                row, original, class_ = row[~late], original[~late], class_[~late]
        same = np.r_[False, (group[row][1:] == group[row][:-1]) & (us[row][1:] == us[row][:-1]) & (rank[row][1:] == rank[row][:-1]) & ~original[:-1]]
        found = ~original & ~same & (before >= 0) & (group[near] == group[row])
        search, newest = row[found], near[found]
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(search)), pa.array(us[search], pa.int64()), ids.take(pa.array(newest)), pa.array(us[newest], pa.int64())],
            names=["search_id", "us", "reused_id", "done_us"],
        )


def reused_searches(searches: DataFrame, ttl: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(search_id, ts, reused_id, completed_at): for each search with one, the newest original whose result it may take.

    Searches as in `operators.reuse.reusable_results`: an original is completed, no copy, has results, the same fingerprint
    and user (unknown users match each other) and lies before the search, by less than `ttl` (a number and a unit). Ties in time go by id.
    Rows gather per key in windows of twice `ttl`, `ttl` apart: a search belongs to the second half of one, where every
    original it may take is with it; the first half keeps originals only. A closed window is sorted once, so a fingerprint with very
    many searches costs no pairs, and its windows go to different tasks. A search is given out when its window closes, at most
    `ttl` and `late` after it, and never changes. State lasts for twice `ttl` and `late`.
    """
    c, (number, unit) = F.col, ttl.split()
    kind = searches.schema["search_id"].dataType.simpleString()
    usable = F.coalesce(c("completed") & ~c("is_copy") & (c("result_count") > 0), F.lit(False))
    placed = searches.withWatermark("ts", late).filter(c("fingerprint").isNotNull()).select(
        F.window("ts", f"{2 * int(number)} {unit}", ttl).alias("w"), "fingerprint", F.coalesce(c("user_id").cast("string"), F.lit("-")).alias("_user"),
        "ts", "search_id", usable.alias("usable"),
    ).withColumn("asked", F.expr(f"ts >= w.start + INTERVAL {ttl}"))
    row = F.struct(F.unix_micros("ts").alias("us"), c("search_id").alias("id"), "asked", "usable")
    groups = placed.filter(c("asked") | c("usable")).groupBy("w", "fingerprint", "_user").agg(F.collect_list(row).alias("rows"))
    pairs = groups.select("rows").mapInArrow(_newest_before, f"search_id {kind}, us long, reused_id {kind}, done_us long").select(
        "search_id", F.timestamp_micros("us").alias("ts"), "reused_id", F.timestamp_micros("done_us").alias("completed_at"))
    return pairs.filter(F.expr(f"completed_at > ts - INTERVAL {ttl}"))


# --- running ----------------------------------------------------------------------------------

#: Settings a query takes when it starts: state on disk of the executors, sessions merged before the shuffle.
QUERY_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def query_settings(spark: SparkSession) -> Iterator[None]:
    """QUERY_SETTINGS for the queries started within; the session has its own again afterwards."""
    before = {k: spark.conf.get(k, None) for k in QUERY_SETTINGS}
    for k, v in QUERY_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Process everything available into a parquet table."""
    with query_settings(stream.sparkSession):
        stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
            "checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, path: str, batch_function, mode: str = "append") -> int:
    """Process everything available through foreachBatch; returns the last batch id."""
    with query_settings(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).foreachBatch(batch_function).option(
            "checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return query.lastProgress["batchId"] if query.lastProgress else 0
