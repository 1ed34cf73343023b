"""Session settings, and cutting a small result off from the scans behind it."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # what a settled frame was written to goes when nothing refers to it any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # no Python stack per column expression: plans of many columns build several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # elsewhere executors have folders of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldtally-"))
    return context.getCheckpointDir()


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listed(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` reads, its folders listed by a few tasks a core: one for each of very many folders costs more than the listing."""
    before = int(spark.conf.get(LISTING))
    spark.conf.set(LISTING, max(1, min(before, 4 * spark.sparkContext.defaultParallelism)))
    try:
        return read()
    finally:
        spark.conf.set(LISTING, before)


def settle(df: DataFrame) -> DataFrame:
    """Write a small aggregated frame to the shared folder, so that no later step rescans."""
    folder = shared_folder(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def settle_all(*frames: DataFrame) -> list[DataFrame]:
    """Settles independent frames, their jobs running side by side."""
    shared_folder(frames[0].sparkSession)
    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        return list(pool.map(settle, frames))
