"""Incoming field observations: validation, deduplication, regions, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted() -> Column:
    """Whether an observation's coordinates, class and certainty make sense."""
    return F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.coalesce(F.col("class_id").between(1, 7), F.lit(True)) & F.col("certainty").between(1, 3)


def deduplicated(stream: DataFrame, key: str, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once, although clients send again until they hear back."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


#: Regions that a row is held against; a catalogue has dozens.
MOST_REGIONS = 10_000


def located(stream: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds the first region (lowest id) whose bounds hold the observation; null if none does.

    The regions become one row with an array, so that a stream needs no state, and
    every observation stays, repeated ones too.
    """
    box = F.struct("region_id", "west", "east", "south", "north")
    listed = regions.agg(F.sort_array(F.collect_list(box)).alias("_regions"))
    if (count := regions.count()) > MOST_REGIONS:
        raise ValueError(f"{count} regions are too many to hold each row against")
    inside = lambda b: F.col("lon").between(b["west"], b["east"]) & F.col("lat").between(b["south"], b["north"])
    met = stream.crossJoin(F.broadcast(listed))
    return met.withColumn("region_id", F.get(F.filter("_regions", inside), F.lit(0))["region_id"]).drop("_regions")


def windowed_counts(stream: DataFrame, at: str, key: str, length: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out."""
    timed = stream.withWatermark(at, late) if stream.isStreaming else stream
    return timed.groupBy(F.window(at, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs all that is there now and returns the result table."""
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)
