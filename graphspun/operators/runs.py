"""Runs of neighbouring numbers merged into ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, group: Sequence[str], chapter: str, number: str, pos: str) -> DataFrame:
    """(group, chapter, first, last, n, run): in the order of `pos`, rows of one chapter whose numbers rise by one are one run.

    A repeated number, a gap, a fall or another chapter begins a new run. `run` counts a group's runs from 1.
    """
    order = Window.partitionBy(*group).orderBy(pos)
    new = ~((F.col(chapter).eqNullSafe(F.lag(chapter).over(order))) & (F.col(number) == F.lag(number).over(order) + 1))
    marked = df.withColumn("_new", F.coalesce(new, F.lit(True)).cast("long"))
    marked = marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*group, "run").agg(F.first(chapter).alias(chapter), F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"))


def chapter_islands(df: DataFrame, group: Sequence[str], chapter: str, number: str) -> DataFrame:
    """(group, chapter, first, last, n): islands() in the order of chapter and number, without the count of runs.

    No run crosses a chapter, so a task holds a chapter at a time, not a group. In a group the runs are ordered by chapter and first.
    """
    order = Window.partitionBy(*group, chapter).orderBy(number)
    marked = df.withColumn("_new", F.coalesce(F.col(number) != F.lag(number).over(order) + 1, F.lit(True)).cast("long"))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*group, chapter, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def island_label(chapter: str = "chapter") -> F.Column:
    """chapter:first, or chapter:first-last."""
    return F.concat(F.col(chapter).cast("string"), F.lit(":"), F.col("first").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("last").cast("string"))).otherwise(F.lit("")))
