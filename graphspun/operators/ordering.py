"""Positions in an order, pages of it, and groups in the order in which they are first seen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspun.sources.scratch import written


def nulls_last(name: str, descending: bool = False) -> Column:
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def numbered(df: DataFrame, by: str, tie: Sequence[str], descending: bool = False, out: str = "pos", small: int = 16 << 20) -> DataFrame:
    """Adds the row's position from 1 in the order of `by`, nulls last, then `tie`.

    Rows that Spark estimates at no more than `small` bytes, a task's worth, are numbered by one window. More are not: they are dealt
    into ranges of (by, tie), sorted and written once to the shared folder with their place in the range. The rows before a range are
    the sum of the ranges' counts, of which there are as many as partitions.
    """
    order = [nulls_last(by, descending), *[F.col(t) for t in tie]]
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= small:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranges = written(ranges, "positions")  # the id is the partition's number, then 33 bits of the row's
    counts = ranges.groupBy(F.shiftright("_at", 33).alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_of", before.alias("_before")))  # a row per partition
    pos = (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return ranges.join(offsets, F.shiftright("_at", 33) == F.col("_of")).withColumn(out, pos).drop("_at", "_of", "_before")


def numbered_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "pos", small: int = 16 << 20, parts: int | None = None) -> DataFrame:
    """Adds the row's position from 1 in its group, in `order`, nulls last; for groups of any size, the columns of `group` not null.

    Few rows are numbered by one window a group. More are dealt into ranges of (group, order) as in numbered(); the rows of a group before
    a range are the sum of its counts there. There are as many counts as ranges and groups; few of them are broadcast.
    """
    sort = [*[F.col(g) for g in group], *[nulls_last(o) for o in order]]
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= small:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*[nulls_last(o) for o in order])).cast("long"))
    ranges = (df.repartitionByRange(parts, *sort) if parts else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    ranges = written(ranges.withColumn("_at", F.monotonically_increasing_id()), "positions").withColumn("_of", F.shiftright("_at", 33))
    counts = ranges.groupBy("_of", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_of", *group, (before - F.col("_from") + 1).alias("_shift"))
    if offsets.limit((1 << 17) + 1).count() <= 1 << 17:
        offsets = F.broadcast(offsets)
    return ranges.join(offsets, ["_of", *group]).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_of", "_shift")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """`limit` rows from `offset` on; a limit of -1 is all the rest. The order must end in a unique column."""
    rest = df.orderBy(*order).offset(offset) if offset else df.orderBy(*order)
    return rest if limit < 0 else rest.limit(limit)


def has_more(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """(shown, more): the rows on the first page, and whether there is another; one row more than the page is looked at."""
    n = F.count(F.lit(1))
    return page(df, order, limit + 1).agg(F.least(n, F.lit(limit)).cast("long").alias("shown"), (n > limit).alias("more"))


def grouped(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], rows: str = "rows", out: str = "pos") -> DataFrame:
    """(key, pos, rows): rows by key, and the groups numbered from 1 in the order in which the rows' order first meets them. A null key is a group of its own, the last."""
    sort = [c for o in order for c in (F.col(o).isNull(), F.col(o))]
    row = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sort)], F.struct(*fields).alias("row"))
    groups = df.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.min(F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sort)])).alias("_first"))
    pos = F.row_number().over(Window.orderBy(F.col(key).isNull(), "_first")).cast("long")  # a row per group: letters, years
    return groups.select(key, pos.alias(out), F.transform("_rows", lambda x: x["row"]).alias(rows))


def group_ends(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], out: str = "pos") -> DataFrame:
    """(key, pos, n, first, last): grouped() without the rows themselves, for groups of any size: all is combined before the shuffle."""
    sort = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(c for o in order for c in (F.col(o).isNull(), F.col(o)))])
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(sort).alias("_first"), F.min_by(F.struct(*fields), sort).alias("first"), F.max_by(F.struct(*fields), sort).alias("last"))
    pos = F.row_number().over(Window.orderBy(F.col(key).isNull(), "_first")).cast("long")  # a row per group
    return groups.select(key, pos.alias(out), "n", "first", "last")
