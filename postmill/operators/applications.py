"""Application ledger: order, channel and status decisions, daily caps, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from postmill import lexicon as lx
from postmill.functions import extract as ex
from postmill.operators import ordered as od

SETTING_DEFAULTS = {
    "auto_apply": False, "auto_min": 80, "daily_limit": 10, "match_min": 0, "prepare_min": 40, "match_email": False,
}


def status_rank(status: Column) -> Column:
    """Position in the to-do order; unknown statuses come first, as FIELD() sorts them."""
    return F.array_position(F.array(*[F.lit(s) for s in lx.APPLICATION_STATUSES]), status)


def application_order() -> list[Column]:
    return [status_rank(F.col("status")), F.desc("score"), F.desc("created_at"), F.col("application_id")]


def list_applications(applications: DataFrame, listings: DataFrame, limit: int = 100) -> DataFrame:
    """First `limit` (1-200) applications per user with the current state of their listing."""
    by = Window.partitionBy("user_id").orderBy(*application_order())
    bounded = max(1, min(200, limit))
    ranked = applications.withColumn("position", F.row_number().over(by)).filter(F.col("position") <= bounded)
    state = listings.select("listing_id", F.col("status").alias("listing_status"))
    return ranked.join(state, "listing_id", "left")


def close_pending(applications: DataFrame, closed: DataFrame, reason: str) -> DataFrame:
    """Pending applications of closed listings become skipped; sent ones stay as they are."""
    gone = closed.select("listing_id").distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False)) & F.col("status").isin(lx.PENDING_STATUSES)
    joined = applications.join(gone, "listing_id", "left")
    message = F.col("message") if "message" in applications.columns else F.lit(None).cast("string")
    return joined.withColumn("message", F.when(hit, reason).otherwise(message)).withColumn(
        "status", F.when(hit, "skipped").otherwise(F.col("status"))
    ).drop("_gone")


def without_unsent(applications: DataFrame, users: DataFrame) -> DataFrame:
    """Drop what was not sent yet for users who stored a new CV."""
    renewed = users.select("user_id").distinct().withColumn("_new", F.lit(True))
    drop = F.coalesce("_new", F.lit(False)) & F.col("status").isin(lx.UNSENT_STATUSES)
    return applications.join(renewed, "user_id", "left").filter(~drop).drop("_new")


def without_users(cvs: DataFrame, users: DataFrame) -> DataFrame:
    return cvs.join(users.select("user_id").distinct(), "user_id", "left_anti")


def sent_today(applications: DataFrame, now: Column) -> DataFrame:
    return (
        applications.filter((F.col("status") == "sent") & (F.col("sent_at") >= F.date_trunc("day", now)))
        .groupBy("user_id").agg(F.count("*").alias("sent_today"))
    )


def merged_settings(stored: DataFrame, update: DataFrame) -> DataFrame:
    """Partial update per user: given values win, others keep the stored one, else the default."""
    joined = stored.alias("old").join(update.alias("new"), "user_id", "full_outer")
    columns = [
        F.coalesce(F.col(f"new.{name}"), F.col(f"old.{name}"), F.lit(default)).alias(name)
        for name, default in SETTING_DEFAULTS.items()
    ]
    return joined.select("user_id", *columns)


def decide(
    channel: Column, recipient: Column, confidence: Column, score: Column, within_limit: Column, has_file: Column,
    auto_apply: Column, auto_min: Column,
) -> Column:
    """struct(status, reason): portal applications are manual, automatic sending needs every condition"""
    waiting = [
        (~auto_apply, "auto_off"),
        (confidence == "low", "low_confidence"),
        (score < auto_min, "below_auto_score"),
        (~within_limit, "daily_limit"),
        (~has_file, "no_file"),
        (recipient.isNull(), "no_recipient"),
    ]
    reason = F.lit(None).cast("string")
    for rule, name in reversed(waiting):
        reason = F.when(rule, name).otherwise(reason)
    return F.struct(
        F.when(channel == "portal", "manual_required").when(reason.isNull(), "queued").otherwise("needs_review").alias("status"),
        F.when(channel == "portal", "no_address").otherwise(reason).alias("reason"),
    )


def prepared_batch(results: DataFrame, settings: DataFrame, limit: int = lx.PREPARE_LIMIT) -> DataFrame:
    """First `limit` results per user at or above the user's preparation score."""
    by = Window.partitionBy("user_id").orderBy("pos", "listing_id")
    enough = results.join(settings.select("user_id", "prepare_min"), "user_id").filter(F.col("score") >= F.col("prepare_min"))
    return enough.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= limit).drop("_rank", "prepare_min")


def prepare(results: DataFrame, settings: DataFrame, already_sent: DataFrame, limit: int = lx.PREPARE_LIMIT) -> DataFrame:
    """Channel, status and reason for the batch of each user, honouring the daily cap.

    Results: user_id, listing_id, pos, score, confidence, has_file, description, requirements,
    candidate_criteria. Only candidates that would be sent use up the cap, in result order.
    """
    c = F.col
    batch = prepared_batch(results, settings, limit)
    channel = ex.application_channel(c("description"), c("requirements"), c("candidate_criteria"))
    rows = (
        batch.withColumn("_c", channel)
        .withColumn("channel", c("_c.channel")).withColumn("recipient_email", c("_c.recipient_email")).drop("_c")
        .join(settings.select("user_id", "auto_apply", "auto_min", "daily_limit"), "user_id")
        .join(already_sent, "user_id", "left")
    )
    wants = decide(
        c("channel"), c("recipient_email"), c("confidence"), c("score"), F.lit(True), c("has_file"), c("auto_apply"),
        c("auto_min"),
    )["status"] == "queued"
    # a batch is at most `limit` rows per user
    before = Window.partitionBy("user_id").orderBy("pos", "listing_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(wants.cast("int")).over(before), F.lit(0)) + F.coalesce("sent_today", F.lit(0))
    decision = decide(
        c("channel"), c("recipient_email"), c("confidence"), c("score"), c("_used") < c("daily_limit"), c("has_file"),
        c("auto_apply"), c("auto_min"),
    )
    return (
        rows.withColumn("_used", used).withColumn("_d", decision)
        .withColumn("status", c("_d.status")).withColumn("reason", c("_d.reason"))
        .drop("_used", "_d", "sent_today", "auto_apply", "auto_min", "daily_limit")
    )


def capped_sends(wanted: DataFrame, limit: int, day: Column, order: list[Column]) -> DataFrame:
    """Flag the first `limit` automatic sends per user and day."""
    return od.first_n_flag(wanted.withColumn("day", day), ["user_id", "day"], order, limit, "send")


def preparation_summary(results: DataFrame, prepared: DataFrame, settings: DataFrame) -> DataFrame:
    """Per user: prepared packages by outcome and results below the preparation score."""
    c = F.col
    below = (
        results.join(settings.select("user_id", "prepare_min"), "user_id").groupBy("user_id")
        .agg(F.count_if(c("score") < c("prepare_min")).alias("below_threshold"))
    )
    done = prepared.groupBy("user_id").agg(
        F.count("*").alias("prepared"), F.count_if(c("status") == "queued").alias("auto_sent"),
        F.count_if(c("status") == "needs_review").alias("needs_review"),
        F.count_if(c("status") == "manual_required").alias("manual_required"),
        F.count_if(c("status") == "failed").alias("failed"),
    )
    names = ["prepared", "auto_sent", "needs_review", "manual_required", "failed"]
    return below.join(done, "user_id", "left").select(
        "user_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names], "below_threshold"
    )


def latest_per_user(df: DataFrame, at: Column, *columns: str) -> DataFrame:
    """Newest row per user as one aggregate."""
    newest = df.groupBy("user_id").agg(F.max_by(F.struct(*columns), at).alias("_row"))
    return newest.select("user_id", *[F.col(f"_row.{c}").alias(c) for c in columns])


def primary_cv(cvs: DataFrame) -> DataFrame:
    return latest_per_user(cvs.filter("is_primary"), F.struct("updated_at", "cv_id"), "cv_id", "updated_at")
