"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of character 4-grams over letters (all else is a space), in shards of sorted key arrays that hold
every language's n-grams, all of them. Texts meet the shards in lots (see kn_shards). The language with the lowest
cross-entropy per character is chosen. The score is a posterior whose sharpness is calibrated on documents kept from training; a
text whose cross-entropy is beyond nearly all of its language's calibration documents is marked rejected.

Sizes. Counts are summed in Spark over all documents, and no n-gram is left out. Calibration takes the least hashes of each 64th
different text, `calibration` at most; all other labelled documents are learned from, and all of a language of
which calibration would take more than half.

Defined results. Text null or without letters: `und`, score 0. Id null: such rows are used for training. Lang null or
`und`: never learned. No language learned: every row is `und`. Ties: the first language in code-point order. Repeated rows: each
counts and is listed. Very long texts are scored whole. Other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import plain_text
from graphspun.llm.kn_shards import Sharded, score, train_shards

ORDER = 4


class Models(NamedTuple):
    """The sharded models, and what calibration found: sharpness of the posterior, and each language's highest accepted cross-entropy."""

    sharded: Sharded
    sharpness: float
    worst: tuple[float, ...]


def posterior(cross: np.ndarray, chars: np.ndarray, sharpness: float) -> np.ndarray:
    """Probability of each language; evidence grows with the square root of the length, since a text's n-grams depend on each other."""
    x = -cross * (sharpness * np.sqrt(np.maximum(chars, 1)))[:, None]
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def set_aside(known: DataFrame, calibration: int) -> Column:
    """Which rows of (lang, text) are for calibration only: those of the `calibration` least hashes of each 64th different text, but none of a language that would lose more than half of its rows."""
    h = F.xxhash64("text")
    drawn = (F.pmod(h, F.lit(64)) == 0) & F.col("text").isNotNull()
    least = known.where(drawn).select(h.alias("h")).distinct().orderBy("h").limit(calibration)
    top = least.agg(F.max("h")).first()[0]
    if top is None:
        return F.lit(False)
    aside = drawn & (h <= F.lit(top))
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(aside.cast("long")).alias("a")).where("2 * a > n").select("lang").collect()
    return F.coalesce(aside & ~F.col("lang").isin([r[0] for r in most]) if most else aside, F.lit(False))


def fit(docs: DataFrame, calibration: int = 4096, quantile: float = 0.999) -> Models | None:
    """Models of rows (lang, text); None if there is no language to learn."""
    known = docs.where("lang is not null and lang <> 'und'").select("lang", "text")
    aside = set_aside(known, calibration)
    sharded = train_shards(known.where(~aside), ORDER, letters=True)
    langs = sharded.langs
    if not langs:
        return None
    kept = known.where(aside).dropDuplicates(["lang", "text"])
    rows = score(kept, sharded).where("letters").toPandas()
    rows = rows[rows["lang"].isin(langs)]
    if not len(rows):
        return Models(sharded, 1.0, (float("inf"),) * len(langs))
    chars = rows["n_chars"].to_numpy()
    cross = -np.stack(rows["totals"]) / chars[:, None]
    own = np.array([langs.index(x) for x in rows["lang"]])
    loss = lambda s: -np.log(np.maximum(posterior(cross, chars, s)[np.arange(len(own)), own], 1e-12)).mean()
    sharpness = min((float(s) for s in np.geomspace(0.25, 16, 25)), key=loss)
    worst = tuple(float(np.quantile(cross[own == i, i], quantile)) * 1.25 if (own == i).any() else float("inf") for i in range(len(langs)))
    return Models(sharded, sharpness, worst)


def predict(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy (of the language chosen), rejected."""
    rows = docs.select(F.col(id_col).alias("doc_id"), plain_text(text_col).alias("text"))
    if models is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    langs, n = models.sharded.langs, F.greatest("n_chars", F.lit(1))
    scored = score(rows, models.sharded).select("doc_id", "letters", (F.sqrt(n) * models.sharpness).alias("sharp"), F.transform("totals", lambda t: -t / n).alias("cross"))
    scored = scored.withColumn("lowest", F.array_min("cross")).withColumn("best", F.array_position("cross", F.col("lowest")).cast("int"))
    # posterior(), of the language with the lowest cross-entropy; the first of several.
    own = 1 / F.aggregate("cross", F.lit(0.0), lambda sum_, c: sum_ + F.exp((F.col("lowest") - c) * F.col("sharp")))
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("best"))
    return scored.select("doc_id", F.when(F.col("letters"), of(langs)).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), own).otherwise(0.0).alias("score"), F.when(F.col("letters"), F.col("lowest")).alias("cross_entropy"), (~F.col("letters") | (F.col("lowest") > of(models.worst))).alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the checksum of the id's decimal text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score, cross_entropy, rejected."""
    models = fit(docs.where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "text"))
    return predict(docs, models).withColumn("held_out", held_out())
