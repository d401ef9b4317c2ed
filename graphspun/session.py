"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: On a cluster, leave these to the cluster's own configuration where it has them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows that Python is given at once are bounded by their bytes, not by their number alone: texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("graphspun").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
