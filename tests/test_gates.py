"""Counts taken during a write against the reports that read the table."""

from pyspark.sql import functions as F

from postmill.functions import quality as ql
from postmill.operators import analytics as an
from postmill.operators import gates

c = F.col


def test_counts_of_a_write_equal_the_reports(spark, tmp_path):
    rows = [(k, k - k % 3, f"Role {k}", "Just a moment" if k % 5 == 0 else "text", f"https://x/jobs/{'role' if k % 4 else 'cook-in-town'}-{k}-abcdef", k % 2 == 0) for k in range(60)]
    grouped = spark.createDataFrame(rows, "listing_id long, group_id long, title string, description string, url string, eligible boolean")
    seen = gates.write_observed(grouped, str(tmp_path / "t"), {"total": F.count(F.lit(1)), **gates.group_metrics(), **gates.listing_metrics(), **gates.result_metrics()})
    written = spark.read.parquet(str(tmp_path / "t"))
    assert written.count() == seen["total"] == 60
    part = lambda *names: {n: seen[n] for n in names}
    assert gates.duplicate_gate(spark, part("total", "removed")).collect() == an.duplicate_rate(written).collect()
    assert gates.listing_gate(spark, part("total", "blocked", "crossed")).collect() == an.bad_listing_rate(written).collect()
    assert seen["blocked"] == 12 and gates.pass_gate(spark, part("total", "eligible")).first().pass_percent == 50


def test_an_empty_table_has_zero_counts(spark, tmp_path):
    empty = spark.createDataFrame([], "listing_id long, group_id long, title string, description string, url string")
    seen = gates.write_observed(empty, str(tmp_path / "e"), gates.group_metrics() | gates.listing_metrics())
    assert set(seen.values()) == {0} and gates.duplicate_gate(spark, {n: seen[n] for n in ("total", "removed")}).first().duplicate_percent == 0


def test_a_word_far_down_blocks_no_listing(spark):
    text = F.lit("A long description. " * 40 + "Solve the captcha to apply.")
    found = spark.range(1).select(ql.is_blocked_page(F.lit("Cook"), text), ql.is_blocked_page(F.lit("Cook"), text, None), ql.is_blocked_page(F.lit("Captcha"), text)).first()
    assert tuple(found) == (False, True, True)
