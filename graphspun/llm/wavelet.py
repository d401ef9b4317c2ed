"""Token ids in shards, each a wavelet matrix.

A shard holds the ids of a run of documents as bit planes, from the highest bit down; in each plane the ids
with a 0 come first in the next. With counts of ones before every block the planes answer, without unpacking
the ids: the token at a place, how often a token occurs before a place, and where its k-th occurrence is.

Format of a shard: the mark WVM2, then little-endian unsigned 64-bit integers (documents, tokens, bits, end id, length of
the compressed head, length of the table of frames), the head by zstd (an Arrow stream of the doc ids, of any type, and their token counts),
the counts of ones before each block of BLOCK bits, plane by plane, as unsigned 32-bit integers, the table of the frames'
lengths likewise, and the frames: FRAME blocks of a plane each, by zstd. A shard is opened without reading a frame; a question unpacks those that it meets.
Shards are rows of a Parquet table, written by Spark, so any store that Spark writes to will do.

Defined results. Text null: empty, only the end id. Id of any type that has an order; null: after all others. Equal ids: by the checksum of the
token ids; rows equal in both are alike. Texts of any length lie whole in one shard. Empty table: no shards, no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspun.llm.common import ship, written
from graphspun.llm.tokens import open_file

_MARK = b"WVM2"
#: Bits of a block, whose ones are counted in the file; blocks of a frame, which is compressed by itself.
BLOCK, FRAME = 1024, 256
_WORDS = BLOCK // 64
_BELOW = np.array([(1 << i) - 1 for i in range(65)], np.uint64)


@cache
def _press() -> Callable[[bytes], bytes]:
    return zstandard.ZstdCompressor(level=1).compress


@cache
def _unpress() -> Callable[[bytes], bytes]:
    return zstandard.ZstdDecompressor().decompress


class Plane:
    """The bits of one level: 64-bit words, lowest bit first, and the ones before each block and in all."""

    def __init__(self, before: np.ndarray, frames: list[bytes] | None = None, words: np.ndarray | None = None):
        self.before, self.frames = before, frames or []
        self.words = np.zeros((len(before) - 1, _WORDS), np.uint64) if words is None else words
        self.missing = np.full(len(self.frames), words is None)

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        raw = np.packbits(bits, bitorder="little").tobytes()
        words = np.frombuffer(raw + bytes((len(bits) // BLOCK + 1) * BLOCK // 8 - len(raw)), "<u8").reshape(-1, _WORDS)
        return cls(np.concatenate(([0], np.cumsum(np.bitwise_count(words).sum(1, dtype=np.int64)))).astype(np.uint32), None, words)

    def packed(self) -> list[bytes]:
        return [_press()(self.words[at : at + FRAME].tobytes()) for at in range(0, len(self.words), FRAME)]

    def _load(self, frames: np.ndarray) -> None:
        for f in frames[self.missing[frames]].tolist():
            self.words[f * FRAME : (f + 1) * FRAME] = np.frombuffer(_unpress()(self.frames[f]), "<u8").reshape(-1, _WORDS)
            self.missing[f] = False

    def _blocks(self, blocks: np.ndarray) -> np.ndarray:
        if self.missing.any():
            self._load(np.unique(blocks // FRAME))
        return self.words[blocks]

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def bits(self, n: int) -> np.ndarray:
        self._load(np.flatnonzero(self.missing))
        return np.unpackbits(self.words.reshape(-1).view(np.uint8), count=n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        words = self._blocks(at // BLOCK)[np.arange(len(at)), at % BLOCK // 64]
        return (words >> (at % 64).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        block = at // BLOCK
        below = _BELOW[np.clip((at % BLOCK)[:, None] - 64 * np.arange(_WORDS), 0, 64)]
        return self.before[block].astype(np.int64) + np.bitwise_count(self._blocks(block) & below).sum(1, dtype=np.int64)

    def select(self, one: bool, k: np.ndarray) -> np.ndarray:
        """Where the ones (or zeros) number k are, from 0."""
        counts = self.before[:-1].astype(np.int64)
        counts = counts if one else np.arange(len(counts)) * BLOCK - counts
        block = np.searchsorted(counts, k, side="right") - 1
        words = self._blocks(block) if one else ~self._blocks(block)
        k, row = k - counts[block], np.arange(len(k))
        ends = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (ends <= k[:, None]).sum(1)
        k = k - np.where(word > 0, ends[row, word - 1], 0)
        bits = np.unpackbits(words[row, word][:, None].view(np.uint8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) <= k[:, None]).sum(1)


class WaveletMatrix:
    """n ids in planes, that of the highest bit first. Places and numbers of occurrences count from 0; many are asked for at once."""

    def __init__(self, planes: list[Plane], n: int):
        self.n, self.bits, self.planes = n, len(planes), planes

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        planes, now = [], ids
        for level in reversed(range(max(1, int(ids.max(initial=0)).bit_length()))):
            one = (now & now.dtype.type(1 << level)).astype(bool)
            planes.append(Plane.of(one))
            now = np.concatenate((now.compress(~one), now.compress(one)))
        return cls(planes, len(ids))

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            one, before = self.planes[level].bits(self.n), np.empty_like(now)
            ones, rest = np.flatnonzero(one), np.flatnonzero(~one)
            before[rest] = now[: len(rest)]
            before[ones] = now[len(rest) :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now

    def accesses(self, at: np.ndarray) -> np.ndarray:
        """The ids at the places."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError(at)
        token = np.zeros(len(at), np.int64)
        for plane in self.planes:
            one, before = plane.get(at), plane.ones(at)
            token = token << 1 | one
            at = np.where(one, self.n - plane.total + before, at - before)
        return token

    def _below(self, token: int, to: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the token's occurrences begin below the last plane, and where those before the places end."""
        if token < 0 or token >> self.bits:
            return 0, np.zeros(len(to), np.int64)
        at = np.concatenate(([0], np.clip(to, 0, self.n)))
        for level, plane in enumerate(self.planes):
            before = plane.ones(at)
            at = self.n - plane.total + before if token >> (self.bits - 1 - level) & 1 else at - before
        return int(at[0]), at[1:]

    def ranks(self, token: int, to: np.ndarray) -> np.ndarray:
        """How often the token occurs before each place."""
        lo, hi = self._below(token, np.asarray(to, np.int64))
        return hi - lo

    def selects(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of the token's occurrences number k."""
        k = np.asarray(k, np.int64)
        lo, hi = self._below(token, np.array([self.n]))
        if len(k) and not (0 <= k.min() and k.max() < hi[0] - lo):
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(self.bits)):
            plane, one = self.planes[level], bool(token >> (self.bits - 1 - level) & 1)
            at = plane.select(one, at - (self.n - plane.total) if one else at)
        return at

    def access(self, at: int) -> int:
        return int(self.accesses(np.array([at]))[0])

    def rank(self, token: int, to: int | None = None) -> int:
        """How often the token occurs in the first `to` places (all, if None)."""
        return int(self.ranks(token, np.array([self.n if to is None else to]))[0])

    def select(self, token: int, k: int) -> int:
        return int(self.selects(token, np.array([k]))[0])


def pack_shard(doc_ids: pa.Array, counts: list[int], ids: np.ndarray, end_id: int) -> bytes:
    matrix, out = WaveletMatrix.of(ids), pa.BufferOutputStream()
    table = pa.table({"doc_id": doc_ids, "n": pa.array(counts, pa.int64())})
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    head = _press()(out.getvalue().to_pybytes())
    frames = [f for p in matrix.planes for f in p.packed()]
    before = b"".join(p.before.astype("<u4").tobytes() for p in matrix.planes)
    return _MARK + struct.pack("<6Q", len(doc_ids), matrix.n, matrix.bits, end_id, len(head), 4 * len(frames)) + head + before + np.array(list(map(len, frames)), "<u4").tobytes() + b"".join(frames)


def open_shard(shard: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix, int]:
    """(doc ids, token counts, wavelet matrix, end id) of a shard."""
    if shard[:4] != _MARK:
        raise ValueError("not a shard")
    _, n, bits, end_id, head, table = struct.unpack_from("<6Q", shard, 4)
    at, blocks = 52 + head, n // BLOCK + 1
    rows = pa.ipc.open_stream(_unpress()(shard[52:at])).read_all()
    before = np.frombuffer(shard, "<u4", bits * (blocks + 1), at).reshape(bits, -1)
    at += before.nbytes
    ends = at + table + np.cumsum(np.frombuffer(shard, "<u4", table // 4, at), dtype=np.int64)
    frames = [shard[s:e] for s, e in zip([at + table, *ends[:-1].tolist()], ends.tolist())]
    each = -(-blocks // FRAME)
    planes = [Plane(before[i], frames[i * each : (i + 1) * each]) for i in range(bits)]
    ids = rows.column("doc_id").combine_chunks()
    return ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, rows.column("n").to_numpy(), WaveletMatrix(planes, n), end_id


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents in ascending id order as a table of shards (part, seq, n_docs, n_tokens, shard)."""

    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids_of, ids, crc = open_file(tokenizer_path).ids, [], []
            for t in b.column(1):
                four = np.append(np.frombuffer(ids_of(t.as_py() or ""), "<u4"), np.uint32(end_id)).astype("<u4")
                crc.append(zlib.crc32(four.tobytes()))
                short = four.max() < 1 << 16
                ids.append(_press()((four.astype("<u2") if short else four).tobytes()) + (b"2" if short else b"4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "crc", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, names, ids, held, kind = TaskContext.get().partitionId(), 0, [], [], 0, pa.null()

        def row() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            blob = pack_shard(pa.array(names, kind), list(map(len, ids)), all_ids, end_id)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([len(all_ids)], pa.int64()), "shard": pa.array([blob], pa.binary())})

        for b in batches:
            kind = b.column(0).type
            for d, x in zip(b.column(0), b.column(1)):
                x = x.as_py()
                ids.append(np.frombuffer(_unpress()(x[:-1]), f"<u{x[-1:].decode()}"))
                names.append(d.as_py())
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield row()
                    seq, names, ids, held = seq + 1, [], [], 0
        if names:
            yield row()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    encoded = written(rows.mapInArrow(encode, f"doc_id {id_type}, crc long, ids binary"), "token-ids")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("crc"), F.col("_spread")]
    ordered = encoded.withColumn("_spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    shards_ = ordered.mapInArrow(shards, "part int, seq int, n_docs long, n_tokens long, shard binary")
    # Of the id only its type: with it the shards can be read without opening one.
    shards_.withColumn("id_type", F.lit(None).cast(id_type)).write.option("compression", "none").parquet(path)


def _id_type(table: DataFrame) -> str:
    return table.schema["id_type"].dataType.simpleString()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), and ends: how often the
    end id occurs in the document, by rank. That each document ends where select finds the last of them is checked."""
    ship(spark)
    table = spark.read.parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, shard in zip(*(b.column(i) for i in range(3))):
                docs, counts, matrix, end_id = open_shard(shard.as_py())
                four = matrix.ids().astype("<u4").tobytes()
                at = np.cumsum(counts)
                crc = [zlib.crc32(four[4 * s : 4 * e]) for s, e in zip((at - counts).tolist(), at.tolist())]
                ranks = matrix.ranks(end_id, at)
                if (matrix.selects(end_id, ranks - 1) != at - 1).any():
                    raise ValueError(f"shard {part}, {seq}: a document does not end with the end id")
                same = lambda x: pa.array(np.full(len(docs), x.as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([same(part), same(seq), docs, pa.array(at - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array(np.diff(ranks, prepend=0))], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32", "ends"])

    rows = table.select("part", "seq", "shard").mapInArrow(decode, f"part int, seq int, doc_id {_id_type(table)}, inside long, n_tokens long, ids_crc32 long, ends long")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # as many rows as the writer had partitions
    parts = parts.select("part", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("_part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    starts = table.select("part", "seq", inner.alias("_start")).join(parts, "part")
    joined = rows.join(starts, ["part", "seq"])
    return joined.select("doc_id", (F.col("_part_start") + F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ends")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, places) of the documents in which a token occurs: its places in the document from 0. Rank counts them, select
    finds them; ids are not unpacked, and of the planes only the frames that the token leads to."""
    ship(spark)
    table = spark.read.parquet(path)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0):
                docs, counts, matrix, _ = open_shard(shard.as_py())
                ends = np.cumsum(counts)
                ranks = matrix.ranks(token, ends)
                per = np.diff(ranks, prepend=0)
                places = matrix.selects(token, np.arange(ranks[-1] if len(ranks) else 0)) - np.repeat(ends - counts, per)
                some = np.flatnonzero(per)
                offsets = pa.array(np.concatenate(([0], np.cumsum(per[some]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(places))], names=["doc_id", "places"])

    return table.select("shard").mapInArrow(find, f"doc_id {_id_type(table)}, places array<long>")
