"""Rate limits and caches over request rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limited(requests: DataFrame, most: int, seconds: int = 60, key: str = "domain") -> DataFrame:
    """The first ``most`` requests of each key in each tumbling window."""
    bucket = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds)
    order = Window.partitionBy(key, "bucket").orderBy("ts", "id")
    return requests.withColumn("bucket", bucket).withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("bucket", "r")


def limited_from_first(requests: DataFrame, most: int, seconds: int = 60, key: str = "domain") -> DataFrame:
    """(key, id, allowed): windows open at a key's first request and close ``seconds`` later. One key's requests are folded in order."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "id"], kind="stable")
        opened, used, allowed = None, 0, []
        for ts in part["ts"]:
            if opened is None or (ts - opened).total_seconds() >= seconds:
                opened, used = ts, 0
            used += 1
            allowed.append(used <= most)
        return pd.DataFrame({key: part[key], "id": part["id"], "allowed": allowed})

    rows = requests.select(key, "id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy(key).applyInPandas(fold, f"{key} {dict(rows.dtypes)[key]}, id {dict(rows.dtypes)['id']}, allowed boolean")


def cached(entries: DataFrame, now: str, hours: int = 24, most: int = 1000) -> DataFrame:
    """The newest entry of each address that is no older than ``hours``; at most ``most``, the newest."""
    key = F.regexp_replace(F.lower("url"), "/+$", "")
    fresh = entries.withColumn("key", key).where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours"))
    newest = fresh.groupBy("key").agg(F.max(F.struct("ts", *[c for c in entries.columns if c != "ts"])).alias("e")).select("key", "e.*")
    return newest.orderBy(F.desc("ts"), "key").limit(most)
