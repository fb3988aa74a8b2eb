"""Event streams: windowed counts with late data, rate limits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The events of a folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, every: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each type in tumbling windows; rows later than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def limited(events: DataFrame, most: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, allowed): per-user windows that open with a first request; the state is one start and count."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["at", "event_id"], kind="stable")
        allowed = []
        for at in rows["at"]:
            now = at.timestamp()
            if opened is None or now - opened >= seconds:
                opened, used = now, 0
            used += 1
            allowed.append(used <= most)
        state.update((opened, used))
        state.setTimeoutTimestamp(int((opened + seconds + 3600) * 1000))
        yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "allowed": allowed})

    timed = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "opened double, used long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
