"""Kneser-Ney models of any size: shards of n-gram counts, and texts in lots that are joined with them.

A model's n-grams of two characters and more lie in shards, by the two characters before the last: all n-grams and
contexts that one probability needs are in one shard. A shard is one row, in sorted arrays of packed keys that are searched by bisection.
Only discounts, and the single characters of each language (at most 4096), are global.

Texts are dealt into lots of a bounded number of characters, by a hash of their row. A lot lists its different n-grams
shard by shard; these lists meet the shards in a join, and the log probabilities come back to the lot, where each
text's are added up. So an n-gram that is frequent in a lot travels once, and neither the model nor anything of its
size is broadcast or comes to the driver. Lists and lots are bounded; `units` of lots that meet a shard at once are, too.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import ship, written
from graphspun.llm.kneser_ney import BITS, CODES, SPACE, Level, discounts, logp, train
from graphspun.llm.ngram_counts import gram_lots, ngram_counts, table_of

#: Shards are so many parts by the second last character times so many by the one before it.
LAST, BEFORE = 32, 8
_MIX = 40503


class Sharded(NamedTuple):
    """shards: (shard, model), a row each; singles: the single characters of each language."""

    shards: DataFrame
    singles: dict[str, Level]
    order: int
    letters: bool

    @property
    def langs(self) -> list[str]:
        return sorted(self.singles)


def _part(key: Column, at: int, parts: int) -> Column:
    code = F.shiftright(key, BITS * at).bitwiseAND(F.lit(CODES - 1))
    return F.pmod(F.shiftright(code * F.lit(_MIX), 8), F.lit(parts)).cast("int")


def shard_of(keys: np.ndarray) -> np.ndarray:
    """As _part() does: the shard of each key."""
    last, before = keys >> BITS & (CODES - 1), keys >> 2 * BITS & (CODES - 1)
    return (last * _MIX >> 8) % LAST * BEFORE + (before * _MIX >> 8) % BEFORE


def train_shards(docs: DataFrame, order: int, letters: bool) -> Sharded:
    """One model for each language of the rows (lang, text)."""
    counts = written(ngram_counts(docs, order, letters), "ngram-counts")
    level, tables = counts, {order: counts}
    for n in range(order - 1, 0, -1):
        level = tables[n] = level.groupBy("lang", F.col("key").bitwiseAND((1 << BITS * n) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    tables[2] = written(tables[2], "ngram-pairs")
    tables[1] = tables[2].groupBy("lang", F.col("key").bitwiseAND((1 << BITS) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    once = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    found = {n: {r["lang"]: discounts(*(r[f"n{i}"] for i in (1, 2, 3, 4))) for r in t.groupBy("lang").agg(*once).collect()} for n, t in tables.items()}
    singles: dict[str, Level] = {}
    for lang, rows in tables[1].toPandas().groupby("lang"):  # at most CODES rows for a language
        rows = rows.sort_values("key")
        singles[lang] = train(rows["key"].to_numpy(), rows["n"].to_numpy(), 1, lambda n, c, d=found[1][lang]: d)[0]

    def by_lang(table: pa.Table) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, rows in table.select(["lang", "key", "n"]).to_pandas().sort_values("key").groupby("lang"):
            yield lang, rows["key"].to_numpy(), rows["n"].to_numpy()

    def pairs(table: pa.Table) -> pa.Table:
        levels = {lang: train(k, n, 2, lambda i, c, lang=lang: found[i][lang], [singles[lang]])[1] for lang, k, n in by_lang(table)}
        return pa.table({"part": table.column("part").slice(0, 1), "pairs": pa.array([pickle.dumps(levels)], pa.binary())})

    def shard(table: pa.Table, second: pa.Table) -> pa.Table:
        levels = {lang: [x] for lang, x in pickle.loads(second.column("pairs")[0].as_py()).items()}
        for lang, k, n in by_lang(table):
            levels[lang] = train(k, n, order, lambda i, c, lang=lang: found[i][lang], [singles[lang], *levels[lang]])[1:]
        return pa.table({"shard": second.column("_shard").slice(0, 1), "model": pa.array([pickle.dumps(levels)], pa.binary())})

    of_pairs = written(tables[2].withColumn("part", _part(F.col("key"), 1, LAST)).groupBy("part").applyInArrow(pairs, "part int, pairs binary"), "ngram-second")
    dealt = counts.withColumn("shard", _part(F.col("key"), 1, LAST) * BEFORE + _part(F.col("key"), 2, BEFORE))
    second = of_pairs.select(F.explode(F.sequence(F.col("part") * BEFORE, F.col("part") * BEFORE + BEFORE - 1)).alias("_shard"), "pairs")
    shards = dealt.groupBy("shard").cogroup(second.groupBy("_shard")).applyInArrow(shard, "shard int, model binary")
    return Sharded(written(shards, "ngram-model"), singles, order, letters)


def _look_up(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """logp() of keys that may be longer than the levels, where a shard has no longer n-grams."""
    return logp(levels, keys & ((1 << BITS * len(levels)) - 1))


@cache
def _press(level: int) -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=level).compress


@cache
def _unpress() -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor().decompress


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the bytes of their differences, first bytes first."""
    return _press(1)(np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(_unpress()(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(flat.T).view("<i8").ravel())


def _texts(column: pa.ChunkedArray) -> list[str]:
    return [_unpress()(x.as_py()).decode() for x in column]


def _by_lang(langs: list) -> Iterator[tuple[str | None, np.ndarray]]:
    names = np.array(langs, object)
    for lang in sorted({x for x in langs if x is not None}):
        yield lang, np.flatnonzero(names == lang)


def score(rows: DataFrame, model: Sharded, by: str | None = None, lot_chars: int = 16_000_000, units: int = 512) -> DataFrame:
    """The rows without their text, and with n_chars, letters (whether there is one) and totals: the sum of the log probabilities
    of the text's characters, in each language of model.langs; with `by`, a column of languages, in the row's own alone, and empty if that
    has no model. n_chars is then 0.

    Column names that begin with an underscore are in use here.
    """
    spark = rows.sparkSession
    ship(spark)
    order, letters, langs, singles = model.order, model.letters, model.langs, model.singles
    if by is None:  # a list has a value for each language
        lot_chars = max(1 << 20, lot_chars * 8 // max(8, len(langs)))
    n_lots = 1 + (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // lot_chars
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    known = frozenset(langs)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _press(3)
        for b in batches:
            seen: dict[tuple, int] = {}  # rows of a batch that are alike in all columns go as one, with how many they are
            times = np.zeros(b.num_rows, np.int32)
            for i, row in enumerate(zip(*(b.column(j).to_pylist() for j in range(b.num_columns - 1)))):
                times[seen.setdefault(row, i)] += 1
            first = np.flatnonzero(times)
            b = b.take(pa.array(first))
            text = pa.array([press((t or "").encode()) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(b.num_columns - 1)), pa.array(times[first]), text], names=["_lot", *names, "_times", "_text"])

    lot = F.pmod(F.xxhash64(F.xxhash64("text"), *[F.col(f"`{c}`") for c in names]), F.lit(n_lots))
    # Rows that are alike have one text hash; it travels so that rows with different texts are never taken for one.
    dealt = rows.select(lot.alias("_lot"), *names, F.xxhash64("text").alias("_hash"), "text")
    names = [*names, "_hash"]
    kinds += ", _hash long"
    dealt = dealt.mapInArrow(deal, f"_lot long, {kinds}, _times int, _text binary").repartition("_lot")

    def of_lot(table: pa.Table) -> Iterator[tuple[str | None, np.ndarray, list[str]]]:
        """(language, rows, texts); one language of None for all rows without `by`."""
        texts = _texts(table.column("_text"))
        if by is None:
            yield None, np.arange(len(texts)), texts
            return
        for lang, which in _by_lang(table.column(by).to_pylist()):
            if lang in known:
                yield lang, which, [texts[i] for i in which]

    def lists(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        number, codes = table.column("_lot")[0].as_py(), table_of(letters)
        for lang, _, texts in of_lot(table):
            keys = np.unique(np.concatenate([np.unique(k) for k, _, _ in gram_lots(texts, order, codes)]))
            at = shard_of(keys)
            turn = np.argsort(at, kind="stable")
            keys, at = keys[turn], at[turn]
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
            out += [(number, lang, int(at[s]), _packed(keys[s:e])) for s, e in zip(start.tolist(), np.append(start, len(at))[1:].tolist())]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"_lot": pa.array(cols[0], pa.int64()), "_lang": pa.array(cols[1], pa.string()), "_shard": pa.array(cols[2], pa.int32()), "_keys": pa.array(cols[3], pa.binary())})

    def look_up(wanted: pa.Table, shard: pa.Table) -> pa.Table:
        own = pickle.loads(shard.column("model")[0].as_py()) if len(shard) else {}
        packed = [x.as_py() for x in wanted.column("_keys")]
        keys = [_unpacked(x) for x in packed]
        values: list = [None] * len(keys)
        if by is None:
            all_keys, back = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
            p = np.stack([_look_up([singles[x], *own.get(x, [])], all_keys) for x in langs], axis=1)[back]
            ends = np.cumsum([len(k) for k in keys])
            values = [x.astype("<f4").tobytes() for x in np.split(p, ends[:-1])] if keys else []
        else:
            for lang, which in _by_lang(wanted.column("_lang").to_pylist()):
                all_keys, back = np.unique(np.concatenate([keys[i] for i in which]), return_inverse=True)
                p = _look_up([singles[lang], *own.get(lang, [])], all_keys)[back]
                for i, x in zip(which.tolist(), np.split(p, np.cumsum([len(keys[i]) for i in which])[:-1])):
                    values[i] = x.astype("<f4").tobytes()
        return pa.table({"_of": wanted.column("_lot"), "_lang": wanted.column("_lang"), "_keys": pa.array(packed, pa.binary()), "_values": pa.array(values, pa.binary())})

    def add_up(table: pa.Table, found: pa.Table) -> pa.Table:
        n, width = len(table), 1 if by else len(langs)
        totals, chars, has = np.zeros((n, width)), np.zeros(n, np.int64), np.zeros(n, bool)
        of = np.array(found.column("_lang").to_pylist(), object)
        codes = table_of(letters)
        for lang, which, texts in of_lot(table):
            own = [i for i in range(len(of)) if of[i] == lang]
            keys = np.concatenate([np.empty(0, np.int64), *(_unpacked(found.column("_keys")[i].as_py()) for i in own)])
            values = np.frombuffer(b"".join(found.column("_values")[i].as_py() for i in own), "<f4").reshape(-1, width)
            index = pd.Index(keys)
            for k, size, owner in gram_lots(texts, order, codes):
                at = index.get_indexer(k)
                if len(at) and at.min() < 0:
                    raise RuntimeError("a lot has n-grams that it did not list")
                ends = np.cumsum(size)
                some = size > 0
                if some.any():
                    sums = np.add.reduceat(values[at], (ends - size)[some], axis=0, dtype=np.float64)
                    np.add.at(totals, which[owner[some]], sums)
                np.add.at(chars, which[owner], size)
                seen = np.concatenate(([0], np.cumsum(k & (CODES - 1) != SPACE)))
                np.logical_or.at(has, which[owner], seen[ends] > seen[ends - size])
        sums_of = pa.array([t.tolist() if c or by is None else [] for t, c in zip(totals, chars)], pa.list_(pa.float64()))
        plain = pa.table({c: table.column(c) for c in names[:-1]} | {"n_chars": pa.array(chars), "letters": pa.array(has), "totals": sums_of})
        return plain.take(pa.array(np.repeat(np.arange(n), table.column("_times").to_numpy())))

    wanted = dealt.groupBy("_lot").applyInArrow(lists, "_lot long, _lang string, _shard int, _keys binary")
    split = max(1, -(-n_lots // units))
    wanted = wanted.withColumn("_unit", F.pmod(F.xxhash64("_lot", F.lit(3)), F.lit(split)).cast("int"))
    shards = model.shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(split - 1))).alias("_u"), "model")
    found = wanted.groupBy("_shard", "_unit").cogroup(shards.groupBy("shard", "_u")).applyInArrow(look_up, "_of long, _lang string, _keys binary, _values binary")
    kinds = kinds.removesuffix(", _hash long")
    return dealt.groupBy("_lot").cogroup(found.groupBy("_of")).applyInArrow(add_up, f"{kinds}, n_chars long, letters boolean, totals array<double>")
