"""Packing documents into token sequences by first-fit decreasing.

A document's ids are cut into pieces of the capacity and a rest. Pieces of full length are sequences by
themselves; the rests are packed within randomised groups of documents, longest first, each into the first
sequence that has room. A tournament tree over the room left finds that sequence in logarithmic time. Only
lengths and checksums travel to the groups, never texts or ids.

Defined results. Text null: empty; every document ends with the end id, so none is without a piece. Id null:
packed like any other. Ties in length: by id, then by checksum. Repeated rows: each is packed; they are dealt over all groups. Empty table: no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import ship
from graphspun.llm.tokens import open_file


class Tournament:
    """Room left in the bins, as a tree of maxima; bins open in order."""

    def __init__(self, bins: int, capacity: int):
        self.base = 1 << max(0, math.ceil(math.log2(max(1, bins))))
        self.room = [capacity] * (2 * self.base)

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room for `length`, and the room it had."""
        room, at = self.room, 1
        while at < self.base:
            at *= 2
            if room[at] < length:
                at += 1
        had = room[at]
        room[at] = had - length
        bin_ = at - self.base
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) for each length, in the order given; equal lengths keep their order."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


def cut_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_tokens, crcs, spread): the checksum of each piece's ids, as little-endian unsigned 32-bit integers, in order; spread tells
    rows that are alike apart: 0 for the first of a task that has an id, else a number that hangs on the task and on how many came before."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId() + 1, Counter()
        for b in batches:
            encode, n, crcs, spread = open_file(tokenizer_path).ids, [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(t.as_py() or "") + end
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)])
                row = hash((str(d), n[-1], crcs[-1][-1]))
                spread.append(0 if d is not None and not seen[row] else task << 32 | seen[row])
                seen[row] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(spread, pa.int64())], names=["doc_id", "doc_tokens", "crcs", "spread"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, doc_tokens long, crcs array<long>, spread long")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 1024, group: int = 2048, seed: int = 23, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `group`: about so many documents are packed together."""
    groups = max(1, docs.count() // group)
    rows = cut_tokens(docs, tokenizer_path, end_id, capacity, id_col, text_col)
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", F.element_at("crcs", -1), "spread"), F.lit(groups))).drop("spread")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("_last", pa.array([c[-1] for c in table.column("crcs").to_pylist()], pa.int64()))
        table = table.sort_by([("doc_id", "ascending"), ("_last", "ascending")])
        tokens, number = table.column("doc_tokens").to_numpy(), table.column("_group")[0].as_py()
        rest = tokens % capacity
        crcs = np.array([x for c in table.column("crcs").to_pylist() for x in c], np.int64)
        pieces = -(-tokens // capacity)
        owner = np.repeat(np.arange(len(tokens)), pieces)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, tokens[owner] - start)
        full = length == capacity
        sequence, offset = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        sequence[full] = np.arange(full.sum())
        packed, offset[~full] = first_fit_decreasing(rest[rest > 0], capacity)
        sequence[~full] = full.sum() + packed
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(owner)), "start": start, "length": length, "ids_crc32": crcs, "doc_tokens": tokens[owner], "sequence_id": (number << 32) + sequence, "offset": offset})

    return rows.groupBy("_group").applyInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
