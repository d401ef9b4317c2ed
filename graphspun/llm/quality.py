"""Quality classifier: perplexity under an n-gram model of trusted text, against quantiles by language.

The model is character 5-grams with interpolated modified Kneser-Ney smoothing, one per language, trained
on all trusted text but a quarter of the documents that is held out. Its counts lie in shards, and the documents' n-grams are joined
with them, lot by lot (see kn_shards); a document's log probability adds up what the join brings. A document is kept if its mean is no
worse than a high quantile of the held-out trusted documents of its language and length class.

Defined results. Trusted is an id that some label calls quality 1 and none calls another quality or toxic; labels that contradict each
other make it untrusted, and a null quality or toxic says nothing. Toxic documents are not learned from; nothing else is done to them,
since the model judges how a text is written. Text null: empty. No characters, or a language that is null or without a model: no
perplexity, kept. Too few held-out documents in a length class: the language's quantile; in the language: the quantile of all languages'
distances from their means, added to the language's mean; in all of them, or none in the language: kept. Id
null: never trusted, judged like any other. Repeated rows: each is judged. No labels, or an empty table: all rows are
kept. Texts of any length are scored whole. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import kept_rows, plain_text, row_key, written
from graphspun.llm.kn_shards import score, train_shards

ORDER = 5
#: Upper ends of the length classes, in characters.
CLASSES = (64, 256, 1024)


def _held_out(doc_id: str = "doc_id") -> F.Column:
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(3)), F.lit(4)) == 3


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of labels (doc_id, quality, toxic): called good, and by no label anything else."""
    says = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0)) == 1
    quality, toxic = F.col("quality"), F.col("toxic")
    return labels.where("doc_id is not null").groupBy("doc_id").agg(says(quality == 1).alias("_good"), says((quality != 1) | (toxic != 0)).alias("_bad")).where("_good and not _bad").select("doc_id")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, least: int = 40, broadcast_ids: int = 500_000, lot_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n_chars, perplexity (of a character), threshold, kept, text_hash.

    labels: doc_id, quality, toxic. At most `broadcast_ids` of the trusted ids are broadcast; more are joined by a
    shuffle. `least`: held-out documents that a quantile needs. `lot_chars`: characters that meet the model at once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(lang_col).cast("string").alias("lang"), plain_text(text_col).alias("text"))
    trusted = written(trusted_ids(labels), "trusted")
    learn = trusted.where(~_held_out())
    side = F.broadcast(learn) if learn.count() <= broadcast_ids else learn
    model = train_shards(rows.select("doc_id", "lang", "text").join(side, "doc_id", "left_semi"), ORDER, letters=False)
    classes = F.lit(len(CLASSES))
    for i, end in reversed(list(enumerate(CLASSES))):
        classes = F.when(F.col("n_chars") < end, F.lit(i)).otherwise(classes)
    cross = -F.get("totals", F.lit(0)) / F.col("n_chars")
    scored = score(rows, model, "lang", lot_chars).withColumn("cross", cross).withColumn("class", classes).drop("letters", "totals")
    scored = written(scored, "perplexities")
    known = scored.where("cross is not null").join(trusted.where(_held_out()), "doc_id", "left_semi").select("lang", "class", "cross")
    of = F.percentile_approx("cross", F.lit(quantile), F.lit(10_000))
    limit = F.when(F.count(F.lit(1)) >= least, of).alias("limit")
    by_class = known.groupBy("lang", "class").agg(limit)
    by_lang = known.groupBy("lang").agg(limit.alias("lang_limit"), F.avg("cross").alias("mean"))
    apart = known.join(F.broadcast(by_lang), "lang").select((F.col("cross") - F.col("mean")).alias("cross")).agg(limit.alias("apart")).first()["apart"]
    by_lang = by_lang.select("lang", F.coalesce("lang_limit", F.col("mean") + F.lit(apart).cast("double")).alias("lang_limit"))
    # A few rows for each language that has a model; those languages are held by the driver already.
    joined = scored.join(F.broadcast(by_class), ["lang", "class"], "left").join(F.broadcast(by_lang), "lang", "left")
    threshold = F.coalesce("limit", "lang_limit")
    return joined.select("doc_id", "lang", "n_chars", F.exp("cross").alias("perplexity"), F.exp(threshold).alias("threshold"), F.coalesce(F.col("cross") <= threshold, F.lit(True)).alias("kept"), "text_hash")


def survivors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; repeated rows stay repeated."""
    kept = judge(docs, labels, id_col=id_col, text_col=text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    return kept_rows(docs, row_key(F.col(id_col), F.xxhash64(text_col)), kept, once=False)
