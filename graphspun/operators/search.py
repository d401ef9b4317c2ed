"""Search in texts and names: a literal, case-insensitive part of the text, in pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspun.operators.ordering import page

#: Shorter inputs are not searched.
LEAST = 3


def matches(text: Column, query: str) -> Column:
    return F.contains(F.lower(text), F.lit(query.lower()))


def found(df: DataFrame, query: str, columns: Sequence[str], aliases: str | None = None) -> DataFrame:
    """Rows of which a column, or one of the aliases in a list column, holds the query; none for an input that is too short."""
    if len(query) < LEAST:
        return df.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(matches(F.col(c), query), F.lit(False))
    if aliases:
        hit = hit | F.coalesce(F.exists(aliases, lambda a: matches(a, query)), F.lit(False))
    return df.where(hit)


def search_texts(df: DataFrame, query: str, text: str, key: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(found(df, query, [text]), [F.col(key).asc()], limit, offset)


def search_names(df: DataFrame, query: str, name: str, key: str, limit: int = 3, offset: int = 0, aliases: str | None = None) -> DataFrame:
    return page(found(df, query, [name], aliases), [F.col(name).asc_nulls_last(), F.col(key).asc()], limit, offset)


_REFERENCE = re.compile(r"(?P<chapter>.*\S)\s*:\s*(?P<first>[0-9]+)(?:\s*[-–]\s*(?P<last>[0-9]+))?")


def by_reference(verses: DataFrame, query: str, ref: str = "full_ref") -> DataFrame:
    """Verses by reference: `Book 3:16` is one verse, `Book 3:16-18` a range in its chapter, `Book 3` the chapter; anything else finds none here."""
    parts = F.lower(F.regexp_replace(F.trim(F.col(ref)), r"\s+", " "))
    want = " ".join(query.lower().split())
    chapter, number = F.split_part(parts, F.lit(":"), F.lit(1)), F.split_part(parts, F.lit(":"), F.lit(2)).try_cast("bigint")
    found = _REFERENCE.fullmatch(want)
    if not found:
        return verses.where(chapter == want)
    return verses.where((chapter == found["chapter"]) & number.between(int(found["first"]), int(found["last"] or found["first"])))


def search_reference(verses: DataFrame, query: str, ref: str = "full_ref", key: str = "verse_id", limit: int = 10, offset: int = 0) -> DataFrame:
    return page(by_reference(verses, query, ref), [F.col(key).asc()], limit, offset)


def appended(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages one after the other, with their number from 1; what occurs on two pages stays twice."""
    out = pages[0].withColumn("page", F.lit(1))
    for i, p in enumerate(pages[1:], 2):
        out = out.unionByName(p.withColumn("page", F.lit(i)))
    return out
