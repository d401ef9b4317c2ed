"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Defined results. Text null: empty. Id null: sorts last, so such a row stays only in a group that
has no other id. Rows that repeat an id and a text: each is listed and carries the same decision;
survivors() keeps one of them. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import kept_rows, one_space, row_key, written


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = md5_128, broadcast_hashes: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Hashes are grouped first, without the texts. Then the texts whose hash occurs again, and only they, are
    grouped by (hash, whole text): equal keys are compared byte by byte, and what a task has read is
    combined before the shuffle, so a group of copies is a row per task however large it is. At most
    `broadcast_hashes` such hashes are sent to the tasks that read texts; more are joined by a shuffle.
    Documents find their group by the hash; where two texts share a hash, and only there, by hash and text.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), one_space(text_col).alias("_text")).withColumn("_h", digest(F.col("_text")))
    rows = written(texts.select("doc_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha")), "exact-hashes")
    by_hash = written(rows.groupBy("_h").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    again = by_hash.where("group_size > 1").select("_h")
    side = F.broadcast(again) if again.count() <= broadcast_hashes else again
    by_bytes = texts.join(side, "_h", "left_semi").groupBy("_h", "_text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shared = written(by_bytes.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_h"), "exact-collisions")
    groups = by_hash.select("_h", "keep_id", "group_size")
    joined = rows.join(groups, "_h")
    if not shared.isEmpty():
        apart = texts.join(shared, "_h", "left_semi").select("doc_id", "_h", "_text").join(by_bytes, ["_h", "_text"])
        joined = rows.join(groups.join(shared, "_h", "left_anti"), "_h").unionByName(apart.select("doc_id", "_h", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size"))
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return kept_rows(docs, row_key(F.col(id_col), F.sha2(one_space(text_col), 256)), kept, once=True)
