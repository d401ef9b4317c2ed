"""Character n-grams of texts, and their counts over a whole corpus, by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import ship
from graphspun.llm.kneser_ney import counted, grams, letter_table, raw_table

#: Characters that are held at once. Longer texts are read in pieces; a piece sees what stands before it, so its n-grams are those of the whole text.
SEGMENT = 1 << 20


def table_of(letters: bool) -> np.ndarray:
    return letter_table() if letters else raw_table()


def _before(text: str, at: int, order: int, table: np.ndarray) -> tuple[str, int]:
    """The end of text[:at] that has order-1 characters at least once its runs of spaces are one, and how many it has."""
    reach = 8 * order
    while True:
        part = text[max(0, at - reach) : at]
        n = len(grams([part], 1, table)[0])
        if n >= order - 1 or reach >= at:
            return part, n
        reach *= 2


def gram_lots(texts: list[str], order: int, table: np.ndarray, segment: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, number of keys of each piece, number of the text of each piece), in lots of about `segment` characters."""
    segment = segment or SEGMENT
    lot, owner, skip, held = [], [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, size = grams(lot, order, table)
        over = np.array(skip)
        if over.any():
            first = np.cumsum(size) - size
            keep = np.ones(len(keys), bool)
            for i in np.flatnonzero(over):
                keep[first[i] : first[i] + over[i]] = False
            keys, size = keys[keep], size - over
        return keys, size, np.array(owner)

    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), segment):
            before, n = _before(t, at, order, table) if at else ("", 0)
            lot.append(before + t[at : at + segment])
            owner.append(i)
            skip.append(n)
            held += len(lot[-1])
            if held >= segment:
                yield out()
                lot, owner, skip, held = [], [], [], 0
    if lot:
        yield out()


def ngram_counts(docs: DataFrame, order: int, letters: bool, keep: int = 1 << 21) -> DataFrame:
    """(lang, key, n) over all rows of (lang, text). A task sums up to `keep` n-grams before it passes them on."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, n = counted(*(np.concatenate(x) for x in zip(*held.pop(lang))))
            return pa.RecordBatch.from_pydict({"lang": pa.array([lang]).take(pa.array(np.zeros(len(keys), np.int32))), "key": keys, "n": n})

        table = table_of(letters)
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for keys, _, _ in gram_lots([texts[i] for i in np.flatnonzero(langs == lang)], order, table):
                    held.setdefault(lang, []).append(counted(keys))
                    if sum(len(k) for k, _ in held[lang]) >= keep:
                        merged = counted(*(np.concatenate(x) for x in zip(*held[lang])))
                        held[lang] = [merged]
                        if len(merged[0]) >= keep // 2:
                            yield out(lang)
        for lang in sorted(held):
            yield out(lang)

    return docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
