import time
import uuid
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postmill.operators import health as hl
from postmill.operators import reuse as ru
from postmill.sources.versions import BucketTable, replacing
from postmill.streaming import health as sh
from postmill.streaming import jobs as st

c = F.col


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """The event table in six files in time order, so that a stream needs six batches."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", c("ts").cast("timestamp"))
    folder = str(tmp_path_factory.mktemp("events"))
    edges = events.selectExpr("percentile(unix_micros(ts), array(0.17, 0.33, 0.5, 0.67, 0.83)) as e").collect()[0]["e"]
    part = sum((F.when(F.unix_micros("ts") > e, 1).otherwise(0) for e in edges), F.lit(0))
    for i in range(6):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    return events, folder


def stream(spark, log):
    events, folder = log
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def runs(df):
    failed = c("event_type") == "error"
    return df.select(
        c("user_id").alias("source"), "ts", "event_id", c("event_type").alias("status"), F.when(failed, 0).otherwise(3).alias("parsed"),
        F.lit(4).alias("discovered"), F.lit(1).alias("searched"), F.when(failed, "403").alias("message"),
    )


NAMES = ["source", "total_runs", "empty_runs", "failures", "last_success_at", "last_checked_at", "last_status", "last_parsed_count", "last_discovered_count", "blocked",
         "requires_javascript"]


def fold_health(spark, runs_stream, path, late):
    table = BucketTable(spark, path, ("source",), sh.health_schema(runs_stream), buckets=4)
    last = st.run_batches(sh.source_states(runs_stream, late), path, st.into_table(table, replacing(["source"])), "update")
    return last, table


def same_health(table, everything):
    want = hl.source_health(everything).withColumnRenamed("consecutive_failures", "failures").select(*NAMES).collect()
    assert sorted(map(str, table.read().select(*NAMES).collect())) == sorted(map(str, want))


def test_health_stream_equals_batch_and_settles_old_failures(spark, log, tmp_path):
    """Files in time order, a watermark of minutes: failures before it are counts only."""
    path = str(tmp_path / uuid.uuid4().hex)
    doomed = lambda df: df.withColumn("event_type", F.when(c("user_id") % 3 == 0, "error").otherwise(c("event_type")))
    last, table = fold_health(spark, runs(doomed(stream(spark, log))), path, "10 minutes")
    assert last >= 5
    same_health(table, runs(doomed(log[0])))
    state = spark.read.format("statestore").option("path", f"{path}-state")
    with st.query_settings(spark):
        kept = state.option("stateVarName", "failed").load().count()
        settled = state.option("stateVarName", "counters").load().select("value.settled").agg(F.sum("settled")).first()[0]
    failures = table.read().agg(F.sum("failures")).first()[0]
    assert kept + settled == failures and kept < failures / 4


def test_health_in_any_batch_order(spark, log, tmp_path):
    """Files dealt by hash, so runs arrive far out of order."""
    everything, folder = runs(log[0]).filter("event_id % 3 > 0"), str(tmp_path / "in")
    for number in range(5):
        everything.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == number).coalesce(1).write.mode("append").parquet(folder)
    shuffled = spark.readStream.schema(everything.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    last, table = fold_health(spark, shuffled, str(tmp_path / "out"), "400 days")
    assert last >= 4
    same_health(table, everything)


def test_health_takes_late_runs(spark, tmp_path):
    def rows(*given):
        made = [(1, f"2024-01-01 {h:02d}:00:00", k, "x", parsed, 4, 1, message) for h, k, parsed, message in given]
        names = "source int, ts string, event_id long, status string, parsed int, discovered int, searched int, message string"
        return spark.createDataFrame(made, names).withColumn("ts", c("ts").cast("timestamp"))

    parts = [rows((8, 1, 3, None), (9, 2, 0, "HTTP 403"), (10, 3, 0, "HTTP 403")), rows((7, 4, 3, None)), rows((9, 5, 5, None)), rows((10, 6, 0, None), (10, 2, 1, None))]
    folder, seen = str(tmp_path / "in"), []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(part.schema).parquet(folder)
        _, table = fold_health(spark, arriving, str(tmp_path / "late"), "1 day")
        row = table.read().first()
        seen.append((row.failures, row.blocked, row.last_success_at.hour))
    assert seen == [(2, True, 8), (2, True, 8), (1, True, 9), (2, False, 10)]


def test_repeated_batch_changes_nothing(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ("k",), "k long, ts timestamp, event_id long, first_seen timestamp, seen long", buckets=4)
    batch = spark.range(20).select((c("id") % 5).alias("k"), F.timestamp_seconds("id").alias("ts"), c("id").alias("event_id"))
    write = st.into_table(table, st.newest_rows(["k"], counted="seen"))
    for number in (0, 1, 1, 1):
        write(batch, number)
    assert sorted((r.k, r.seen, r.event_id, r.first_seen.second) for r in table.read().collect()) == [(k, 8, 15 + k, k) for k in range(5)]


def test_ingest_keeps_first_and_newest(spark, log, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    twice = stream(spark, log).withColumn("board", F.explode(F.array(F.lit("a"), F.lit("b")))).drop("props")
    fresh = st.fresh_listings(twice, "40 days", c("event_id").cast("string")).drop("url_key", "board")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema) + ", first_seen timestamp, sightings long"
    table = BucketTable(spark, path, ("user_id",), schema, buckets=4)
    st.run_batches(fresh, path, st.into_table(table, st.newest_rows(["user_id"], counted="sightings")))
    got = {r["user_id"]: (r["first_seen"], r["ts"], r["sightings"]) for r in table.read().collect()}
    want = log[0].groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    assert got == {r["user_id"]: (r["a"], r["b"], r["n"]) for r in want.collect()}


def test_ingest_drops_repeated_keys_within_the_horizon(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("U/", "2024-01-03 00:00:00"), ("v", "2024-01-03 00:00:00"), ("v", "2024-01-03 00:00:00"), ("u", "2024-02-20 00:00:00")]
    folder = str(tmp_path / "in")
    for k, (url, ts) in enumerate(rows):
        made = spark.createDataFrame([(f"https://x.example/{url}", ts, k)], "url string, ts string, event_id long")
        made.withColumn("ts", c("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema("url string, ts timestamp, event_id long").parquet(folder)
    out = str(tmp_path / "out")
    st.run_to_table(st.fresh_listings(source, "7 days", F.lower(F.rtrim("url", F.lit("/")))), out)
    assert spark.read.parquet(out).count() == 2  # one batch: the horizon runs from the first sighting of a key


def test_windows_equal_batch_below_the_watermark(spark, log, tmp_path):
    path = str(tmp_path / "w")
    st.run_to_table(st.windowed_counts(stream(spark, log), "event_type"), path)
    mark = log[0].agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).collect()[0][0]
    want = log[0].groupBy(F.window("ts", "24 hours"), "event_type").count().filter(c("window.end") <= F.lit(mark))
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.select("window.start", "event_type", "count").collect()))


def test_expiry_over_batches(spark, log, tmp_path):
    """Each pause of three days is an expiry, however the rows fall into batches; no Python runs."""
    path = str(tmp_path / "e")
    gone = st.expired_listings(stream(spark, log).select(c("user_id").alias("listing_id"), "ts"), days=3)
    st.run_to_table(gone, path)
    got = {(r["listing_id"], r["last_seen"]) for r in spark.read.parquet(path).collect()}
    times = {}
    for r in log[0].select("user_id", "ts").orderBy("ts").collect():
        times.setdefault(r.user_id, []).append(r.ts)
    mark, wait = max(t for own in times.values() for t in own) - timedelta(hours=1), timedelta(days=3)
    want = {(k, a) for k, own in times.items() for a, b in zip(own, [*own[1:], datetime.max]) if b - a > wait and a + wait <= mark}
    assert got == want and want


def test_expiry_merges_sessions_before_the_shuffle(spark, tmp_path):
    """One listing with very many sightings costs the shuffle a few rows."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 200_000, 1, 4).select(F.lit(1).cast("long").alias("listing_id"), F.timestamp_seconds(c("id") * 60).alias("ts")).write.parquet(folder)
    gone = st.expired_listings(spark.readStream.schema("listing_id long, ts timestamp").parquet(folder), days=30)
    with st.query_settings(spark):
        query = gone.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
        query.awaitTermination()
    plan = query._jsq.explainInternal(True) if hasattr(query._jsq, "explainInternal") else ""
    assert "Python" not in plan and "Pandas" not in plan
    assert sum(p["numInputRows"] for p in query.recentProgress) == 200_000
    assert max(o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]) <= 4


def test_reused_searches_equal_the_batch_job(spark, log, tmp_path):
    """Over six batches: the newest original of the same fingerprint and user, own and copied results left out."""
    def searches(df):
        i = c("user_id")
        return df.select(
            c("event_id").alias("search_id"), (i % 4).cast("string").alias("fingerprint"), F.when(i % 7 > 0, i % 2).alias("user_id"), "ts",
            (c("event_type") != "error").alias("completed"), (c("event_type") == "view").alias("is_copy"), (F.floor("value").cast("int") % 4).alias("result_count"),
        )

    path = str(tmp_path / "r")
    st.run_to_table(st.reused_searches(searches(stream(spark, log))), path)
    mark = log[0].agg(F.max("ts") - F.expr("INTERVAL 7 HOURS")).first()[0]
    got = {r.search_id: r.reused_id for r in spark.read.parquet(path).filter(c("ts") <= F.lit(mark)).collect()}
    batch = ru.reusable_results(searches(log[0])).filter(c("reused_id").isNotNull() & (c("ts") <= F.lit(mark)))
    assert got == {r.search_id: r.reused_id for r in batch.collect()} and len(got) > 100


def test_reuse_of_one_very_common_search(spark, tmp_path):
    """300,000 searches of one fingerprint within nine hours: ten thousand million pairs, none of them is made."""
    rows = spark.range(300_000).select(
        c("id").alias("search_id"), F.lit("f").alias("fingerprint"), F.lit(None).cast("long").alias("user_id"), F.timestamp_seconds(1_704_067_200 + F.floor(c("id") / 9)).alias("ts"),
        F.lit(True).alias("completed"), (c("id") % 3 > 0).alias("is_copy"), F.lit(1).alias("result_count"),
    )
    rows.unionByName(rows.filter("search_id = 0").withColumn("search_id", F.lit(-1).cast("long")).withColumn("ts", c("ts") + F.expr("INTERVAL 2 DAYS"))).write.parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    st.run_to_table(st.reused_searches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), path)
    got = spark.read.parquet(path)
    assert got.count() == 299_999 and got.filter("reused_id <> search_id - 1 - (search_id + 2) % 3").isEmpty()


def test_reuse_without_ids(spark):
    """Within a moment an id without value is neither before nor after another."""
    import pyarrow as pa

    rows = [dict(us=5, id=None, asked=True, usable=True), dict(us=5, id=3, asked=True, usable=True), dict(us=5, id=4, asked=True, usable=False),
            dict(us=7, id=None, asked=True, usable=True), dict(us=9, id=1, asked=True, usable=False), dict(us=9, id=1, asked=True, usable=False)]
    batch = pa.RecordBatch.from_pylist([{"rows": rows}, {"rows": rows[2:3]}], pa.schema([("rows", pa.list_(pa.struct([("us", pa.int64()), ("id", pa.int64()), ("asked", pa.bool_()), ("usable", pa.bool_())])))]))
    [out] = st._newest_before(iter([batch]))
    assert sorted((r["us"], str(r["search_id"]), r["reused_id"], r["done_us"]) for r in out.to_pylist()) == [(5, "4", 3, 5), (7, "None", 3, 5), (9, "1", None, 7)]


def test_runs_of_very_many_sources_shrink_at_once():
    n = 60_000
    runs = pd.DataFrame({
        "source": [i % 20_000 for i in range(n)], "ts": pd.to_datetime(range(n), unit="s"), "us": range(n), "event_id": range(n), "status": "x",
        "parsed": [int(i // 20_000 == 1) for i in range(n)], "discovered": 0, "searched": 1, "blocked": False,
    })
    started = time.monotonic()
    [out] = sh._summaries(iter([runs]))
    assert time.monotonic() - started < 8
    one = out[out["source"] == 7].iloc[0]
    assert len(out) == 20_000 and (one.total_runs, one.empty_runs, one.ok_us, one.at_id) == (3, 2, 20_007, 40_007) and list(one.failed_us) == [40_007]


def test_runs_without_time_count_in_the_totals_only():
    runs = pd.DataFrame({
        "source": [1, 1, 1, 2, 2, 3], "ts": pd.to_datetime([1, 2, None, None, 3, 4], unit="s"), "us": [1e6, 2e6, None, None, 3e6, 4e6], "event_id": range(6), "status": "x",
        "parsed": [1, 0, 0, 1, 0, 0], "discovered": 0, "searched": 1, "blocked": False,
    })
    [out] = sh._summaries(iter([runs]))
    assert [(r.total_runs, r.empty_runs, r.ok_us, list(r.failed_us)) for r in out.itertuples()] == [
        (3, 2, 10**6, [2 * 10**6]), (2, 1, sh.NEVER[0], []), (1, 1, sh.NEVER[0], [4 * 10**6])]
    assert out["at_us"].isna().tolist() == [True, True, False]
