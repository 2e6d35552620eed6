"""Control-plane queries: job claims, stale jobs, lock-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STALE_SECONDS, ATTEMPTS = 180, 3
FAILURES, LOCK_SECONDS = 5, 300


def claimable(jobs: DataFrame) -> DataFrame:
    """Queued jobs of regions in which no job runs; jobs without a region always."""
    running = jobs.filter("status = 'running' and region is not null").select("region").distinct()
    queued = jobs.filter("status = 'queued'")
    return queued.filter("region is not null").join(running, "region", "left_anti").unionByName(queued.filter("region is null"))


def stale(jobs: DataFrame, now: float) -> DataFrame:
    """Running jobs whose heartbeat stopped, with what becomes of them."""
    late = jobs.filter((F.col("status") == "running") & (F.lit(now) - F.col("heartbeat") > STALE_SECONDS))
    return late.withColumn("next_status", F.when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("queued"))


def locked_out(failures: DataFrame) -> DataFrame:
    """Adds ``locked``: five failures or more within 300 seconds up to this one."""
    recent = Window.partitionBy("user").orderBy("at").rangeBetween(-LOCK_SECONDS, 0)
    return failures.withColumn("locked", F.count(F.lit(1)).over(recent) >= FAILURES)
