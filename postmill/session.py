"""Session helpers: a sane default session and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "postmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs were planned for.

    Joins carry no broadcast hints: Catalyst and AQE broadcast a side only when its
    measured size is below the threshold and otherwise shuffle, splitting skewed
    partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="postmill-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def small(side: DataFrame, rows: int = 200_000) -> DataFrame:
    """`side` (cheap to count), marked for broadcast if it has at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(side) if side.count() <= rows else side


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder, so that lost executors do not matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
