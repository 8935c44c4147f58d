"""Result reuse: an equal search of the same user within the time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill import lexicon as lx
from postmill.operators import ordered as od


def reusable_results(searches: DataFrame, ttl_hours: float = lx.REUSE_TTL_HOURS) -> DataFrame:
    """Searches with `reused_id`: the newest earlier original with results and the same fingerprint.

    Searches: search_id, user_id (may be NULL), fingerprint, ts, completed, is_copy, result_count.
    Copies are never a source, so reuse cannot stretch the time to live. NULL users match each
    other only. The as-of lookup runs over segments; one fingerprint may hold any number of rows.
    """
    c = F.col
    usable = c("completed") & ~c("is_copy") & (c("result_count") > 0)
    keyed = searches.withColumn("_user", F.coalesce(c("user_id").cast("string"), F.lit("-")))
    source = F.when(usable, F.struct(c("search_id").alias("id"), c("ts").alias("ts")))
    found = od.last_before(keyed, ["fingerprint", "_user"], ["ts", "search_id"], source, "_source")
    age = F.unix_micros("ts") - F.unix_micros(c("_source.ts"))
    fresh = (age < int(ttl_hours * 3_600_000_000)) & (F.lit(ttl_hours) > 0)
    return found.withColumn("reused_id", F.when(fresh, c("_source.id"))).drop("_user", "_source")
