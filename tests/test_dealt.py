from pyspark.sql import functions as F

from postmill.plans.matching_queries import evaluated, score_components
from postmill.plans.tables import Tables


def _tables(spark, folder) -> Tables:
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma upsilon "
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit(text * 3).alias("text"), F.lit("en").alias("lang"), F.lit("src2").alias("source"), F.lit(len(text) * 3).cast("long").alias("n_chars")
    )
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.range(20).select(F.col("id").alias("item_id"), F.lit(text).alias("text")).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return Tables(spark, str(folder))


def test_few_bytes_of_pairs_are_evaluated_in_many_tasks(spark, tmp_path):
    """Pairs cost much for their bytes, so they keep their tasks instead of being merged by size."""
    t = _tables(spark, tmp_path)
    least = 4 * spark.sparkContext.defaultParallelism
    for pairs in (evaluated(t).select("profile_id", "listing_id"), score_components(t).select("profile_id", "listing_id")):
        sizes = pairs.rdd.glom().map(len).collect()
        assert len(sizes) >= least
        assert sum(sizes) > 0 and max(sizes) < sum(sizes) / 4


def test_a_listing_of_many_rows_keeps_them_all(spark, tmp_path):
    """Dealing changes no row, with ids repeated or null."""
    t = Tables(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c")], "listing_id long, x string")
    assert sorted(map(str, t.dealt(rows, "listing_id").collect())) == sorted(map(str, rows.collect()))
