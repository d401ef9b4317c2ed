"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source is given a budget of words. Whole epochs of the source come first; what then remains of
the budget takes documents in the order of exponential keys divided by their quality weights, until the
sizes' running total reaches it; the document on the border is taken if that comes nearer.

Defined results. Text null: size 0. Source null: a source of its own, sorted last. Id null: drawn like
any other. Equal keys: by id, then by the text's hash. Repeated rows: each counts; rows alike in id and text have one key. All sizes 0, or an
empty table: targets 0, nothing taken. A quality that is null or not a number counts as 1; others are held within 1e-9 and 1e9. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspun.llm.common import before_in_group, fresh, n_words, plain_text, row_key, slices, written


def typical_prose(text: Column, size: Column) -> Column:
    """Quality weight in (0.05, 1]: how near the mean length of a word is to that of prose, six characters with its space."""
    mean = F.length(plain_text(text)) / F.greatest(size, F.lit(1))
    return F.greatest(F.lit(0.05), F.exp(-F.abs(mean - 6.0) / 6.0))


def source_targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Adds `target` to (source, source_size, rank): shares of the sum by weight, none above `most` times its own size.

    Sources above their limit are set to it and the rest is shared anew, by weight; each round needs two
    sums from the sources, which stay distributed. A round ends the work or sets at least one source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    total = float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"])
    level = 0.0
    while True:
        full = F.col("limit") <= F.col("weight") * F.lit(level)
        free, fixed = rows.agg(F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0))).first()
        new = (total - fixed) / free if free else level
        if new <= level:
            return rows.withColumn("target", F.least(F.col("limit"), F.col("weight") * F.lit(level))).drop("weight", "limit")
        level = new


def ranked(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of `column` with their `rank` from 0 in code-point order, null last, counted range by range."""
    order = [F.col(column).isNull(), F.col(column)]
    ranges = written(df.select(column).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "mix-ranks")
    parts = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranges.join(parts.select("_part", start.alias("_start")), "_part").select(column, (F.col("_start") + own).cast("long").alias("rank"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and epochs (how often the whole document is taken).

    `quality`: a positive column of `docs`; typical_prose() if none is given.
    """
    size = n_words(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), plain_text(text_col)).alias("_text_hash"), (typical_prose(F.col(text_col), size) if quality is None else quality.cast("double")).alias("_quality"))
    rows = written(rows, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = written(sums.join(ranked(sums, "source").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-sources")
    sources = source_targets(sources, weights, most)
    cuts = slices(sources.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0])

    # 52 bits of a hash as a number in (0, 1), the same in every run.
    draw = ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_text_hash")), 12)) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = F.coalesce(F.nanvl("_quality", F.lit(1.0)), F.lit(1.0))
    keyed = rows.withColumn("_key", -F.log(draw) / F.least(F.greatest(weight, F.lit(1e-9)), F.lit(1e9)))
    # A key's logarithm is that of an exponential number less that of a weight: whatever the weights, no stretch of length 1 / cuts of it holds more than 0.37 / cuts of the rows.
    keyed = keyed.withColumn("_slice", F.floor(F.log("_key") * F.lit(float(cuts))).cast("int"))
    part = before_in_group(keyed, "source", "_slice", [F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("_text_hash")], "size", "_before")
    s = sources.select(F.col("source").alias("_source"), "source_size", "target")
    joined = part.join(s, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2.0 < rest)
    epochs = whole + more.cast("long")
    return joined.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * epochs).alias("taken"), epochs.alias("epochs"), F.col("_text_hash").alias("text_hash"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None) -> DataFrame:
    """The documents with all their columns, each as often as it is taken. Rows that repeat an id and a text are one row that is taken as often as all of them."""
    key, times, copy = (fresh(docs.columns, n) for n in ("_key", "_times", "_copy"))
    taken = mix(docs, weights, most, seed, id_col, text_col, source_col, quality).groupBy(row_key(F.col("doc_id"), F.col("text_hash")).alias(key)).agg(F.sum("epochs").cast("int").alias(times)).where(F.col(times) > 0)
    held = docs.withColumn(key, row_key(F.col(id_col), F.xxhash64(F.lit(seed), plain_text(text_col)))).join(taken, key).dropDuplicates([key])
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(key, times, copy)
