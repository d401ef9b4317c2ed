"""The page manifest from a stream of new entities: each becomes a page row, and a slug that comes again makes no second page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphspun.functions.columns import page_path


def manifest_stream(entities: DataFrame, kind: str, slug: str = "slug", arrived: str | None = None, late: str = "1 day") -> DataFrame:
    """(kind, lookup_name, path) of a stream. With `arrived`, a timestamp column, slugs are remembered for `late` only, so that the state stays bounded."""
    rows = entities.where(F.col(slug).isNotNull())
    rows = rows.withWatermark(arrived, late).dropDuplicatesWithinWatermark([slug]) if arrived else rows.dropDuplicates([slug])
    return rows.select(F.lit(kind).alias("kind"), F.col(slug).alias("lookup_name"), page_path(kind, F.col(slug)).alias("path"))


def write_stream(manifest: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last call, exactly once, then stops."""
    return manifest.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start()
