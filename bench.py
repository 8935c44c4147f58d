"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from postmill.plans import load_queries  # noqa: E402
from postmill.plans.registry import QUERIES  # noqa: E402
from postmill.session import build_session  # noqa: E402

HEADLINE = [
    "clean_pages", "page_links", "normalize_docs", "content_hash_dups", "near_duplicate_pairs", "duplicate_groups", "term_retrieval",
    "cheap_score_topk", "eligibility", "ranked_listings", "skill_heatmap", "section_lines", "contact_emails", "source_health",
    "health_levels", "circuit_breaker", "ttl_reuse", "listing_upsert", "status_counts", "app_order", "latest_per_user", "daily_cap",
    "freshness_bands", "windowed_matches",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    load_queries()
    QUERIES["status_counts"](spark, folder).collect()  # warm the JVM
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
