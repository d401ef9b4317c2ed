"""What the operators share: the library's code on the executors, text normalisation, running totals."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspun.sources.scratch import release, shared_dir, written

__all__ = ["before_in_group", "fresh", "kept_rows", "n_words", "one_space", "plain_text", "release", "row_key", "shared_dir", "ship", "slices", "written"]

def ship(spark: SparkSession) -> None:
    """Gives the executors this library, once a session, so that it need not be on their Python path. Called by every operator that runs Python there."""
    context = spark.sparkContext
    if getattr(context, "_graphspun_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir():  # the library came as an archive, which is with the executors already
        return
    folder = tempfile.mkdtemp(prefix="graphspun-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/graphspun.zip", "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(f"{folder}/graphspun.zip")
    context._graphspun_shipped = True


def plain_text(text: str | Column) -> Column:
    """Text with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def one_space(text: str | Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space. Bytes are replaced in place; only a text that then has a double space meets a pattern."""
    out = plain_text(text)
    for c in "\t\n\x0b\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " +", " ")).otherwise(out)


def n_words(text: str | Column) -> Column:
    """Number of runs of other characters than ASCII white space, as a long."""
    stripped = F.trim(one_space(text))
    return F.when(stripped == "", F.lit(0)).otherwise(F.length(stripped) - F.length(F.replace(stripped, F.lit(" "), F.lit(""))) + 1).cast("long")


def row_key(id_: Column, text_hash: Column) -> Column:
    """What tells rows apart: the id and a hash of the text, as one string without nulls, so that a join and what follows it share a partitioning."""
    return F.concat_ws("/", F.coalesce(id_.cast("string"), F.lit("-")), text_hash.cast("string"))


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not among `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_rows(docs: DataFrame, key: Column, kept: DataFrame, once: bool) -> DataFrame:
    """The rows of `docs`, with all their columns, whose key is in the column `key` of `kept`; with `once`, one row of each key."""
    name = fresh(docs.columns, "_key")
    out = docs.withColumn(name, key).join(kept.select(F.col("key").alias(name)).distinct(), name, "left_semi")
    return (out.dropDuplicates([name]) if once else out).drop(name)


def slices(n: int) -> int:
    """In how many slices n ordered rows are cut for running totals: their square root, so that neither a slice nor the list of slices grows in proportion."""
    return max(1, math.isqrt(max(0, n)))


def before_in_group(df: DataFrame, group: str, slice_: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the earlier rows of the row's `group`.

    `slice_` must rise with `order`. A group is never gathered in one task: its slices are summed
    apart, then the slices' sums are run through, then each slice by itself.
    """
    sums = df.groupBy(group, slice_).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col(slice_).alias("_s"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col(slice_) == F.col("_s")), "left")
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_g", "_s", "_offset")
