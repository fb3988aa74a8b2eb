"""Session factory with the settings the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "codelathe", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides any setting.

    ``spark.sql.shuffle.partitions`` is left to the caller or the cluster:
    adaptive execution coalesces small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_REMOTE" not in os.environ and master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
