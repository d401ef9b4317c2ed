"""Token counts with a digest cache.

Counts are stored by the digest of the normalised content and the digest of the tokenizer's version.
Documents are joined to the stored counts; of those that find none, each distinct text is encoded once and
its count appended. Digests are compared before any text moves: a text that occurs once is encoded where it is
read, and only texts that occur again are brought together. The only normalisation that leaves a count as it is, is null to empty.

Defined results. Text null: as the empty text, 0 bytes. Id null and repeated rows: each listed. Texts of any
length are encoded whole. Two rows of the cache with one digest, left by jobs that ran at the same time, count as one.
Empty table: no rows; nothing is appended. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspun.llm.common import plain_text, ship, written
from graphspun.llm.tokens import count_tokens, version

_SCHEMA = "digest binary, n_tokens long"


def stored(spark: SparkSession, cache_path: str, tokenizer_path: str) -> DataFrame | None:
    """The counts that the cache has for this version of the tokenizer; None if it has none."""
    try:
        found = spark.read.schema(_SCHEMA).parquet(f"{cache_path}/{version(tokenizer_path)}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", broadcast_digests: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Digests that select texts are broadcast if they are
    at most `broadcast_digests`, and joined by a shuffle if not."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-rows")
    known = stored(spark, cache_path, tokenizer_path)
    missing = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    missing = written(missing if known is None else missing.join(known, "digest", "left_anti"), "token-misses")
    again = missing.where("n > 1").select("digest")
    n_missing, n_again = missing.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0))).first()
    small = lambda df, n: F.broadcast(df) if n <= broadcast_digests else df
    wanted = texts.select("digest", "text")
    if known is not None:
        wanted = wanted.join(small(missing.select("digest"), n_missing), "digest", "left_semi")
    once = wanted.join(small(again, n_again), "digest", "left_anti")
    twice = wanted.join(small(again, n_again), "digest", "left_semi").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [count_tokens(tokenizer_path, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    once.unionByName(twice).mapInArrow(count, _SCHEMA).write.mode("append").parquet(f"{cache_path}/{version(tokenizer_path)}")
    # Written, so that the join has a bare exchange on either side and the rows of one very common text can be split.
    counts = written(stored(spark, cache_path, tokenizer_path), "token-counts")
    joined = rows.join(counts, "digest")
    return joined.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
