"""SimHash near-dedup with vantage-point trees.

Fingerprints of 64 bits a word come from the hashes of word shingles. Equal fingerprints (of near texts: equal sets of shingles) are one point. A
vantage-point tree, grown from a bounded sample of the points, cuts the space: each inner node has a
vantage point and a radius, and a point goes inside or outside by its Hamming distance. Each point has one
home leaf. Its query ball also visits those earlier leaves that the triangle bounds do not rule out, so
each pair within the distance meets in one leaf at least. In a leaf the points are sorted by their
distance to the leaf's own vantage point, and only the ring that the bounds leave open is compared.
A leaf emits links from each point to the least point of its local group, not all pairs; the components
are then found in Spark.

Two settings. near_groups() links fingerprints of one word at most `within` bits apart. near_texts() links texts that
share `ratio` of their shingles: there the fingerprints have four words and a wide radius, for which a tree prunes
little, so points are also cut into bands by their number of different shingles: texts that share 0.8 of their
shingles are at most 1.25 times as long as each other, and so lie in one band or in neighbouring ones. What the
fingerprints link is then checked: within each of their groups, texts are linked again by their sets of shingles. Fingerprints and
bands come from the same sets, so a passage that repeats more often in one of two texts does not part them.

Sizes. The sample and the number of leaves grow with the square root of the number of points, so both the
tree, which every task holds, and a leaf grow with the square root. A leaf that near copies crowd beyond four times the mean, or beyond `block`
rows, is cut into blocks, and each pair of its blocks is a task of its own; so no task holds more than two.

Defined results. Text null or without words: fingerprint zero, linked like any other. Fewer words than a
shingle: the whole sequence is the one shingle. A bit that is set in exactly half of the hashes is 0. Id
null: never the least of its group unless the whole group is null; its row is still returned. Repeated
rows: each is listed. Empty table: no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from graphspun.llm.common import kept_rows, row_key, ship, slices, written
from graphspun.llm.components import components
from graphspun.llm.unionfind import Forest

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = 1 << 22
#: Sets of at most so many shingles also meet those that have one more by their sums, and are checked up to a wider distance.
SHORT, WIDE = 16, 96


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42, words: int = 1) -> tuple[np.ndarray, int]:
    """(the fingerprint's words of 64 bits, number of shingles) of one text; very long texts are counted in blocks of shingles.

    One word: XXH64 of each shingle. More: two words each from 128-bit XXH3 with the seeds from `seed` on.
    """
    found = (text or "").encode().translate(_LOWER).split()
    if not found:
        return np.zeros(words, np.uint64), 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(found))
    n, bits = len(found) - size + 1, 64 * words
    digest = xxhash.xxh64_intdigest if words == 1 else xxhash.xxh3_128_digest
    ones = np.zeros(bits, np.int64)
    for at in range(0, n, 1 << 14):
        to = min(n, at + (1 << 14))
        shingles = [joined[s:e] for s, e in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist())]
        if words == 1:
            hashes = np.fromiter((digest(x, seed) for x in shingles), np.uint64, to - at).view(np.uint8).reshape(-1, 8)
        else:
            hashes = np.concatenate([np.frombuffer(b"".join([digest(x, seed + k) for x in shingles]), np.uint8).reshape(-1, 16) for k in range(words // 2)], axis=1)
        full = (to - at) // 255 * 255
        bit = np.unpackbits(hashes, axis=1, bitorder="little")
        if full:
            ones += bit[:full].reshape(-1, 255, bits).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bit[full:].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64), n


def set_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of a set of hashes, each of them counted once; each word of a hash is the next one of SplitMix64 from there on."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        x = hashes[at : at + (1 << 14), None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def set_fingerprints(docs: DataFrame, shingle: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints() of the sets of shingles, by which texts are checked: how often a shingle occurs in a text makes no difference.
    digest: 128 bits of the set itself, since different sets may have one fingerprint. own, less: of sets of at most SHORT + 1
    shingles the sum of the hashes, and the sums without one of them; null for larger sets."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            flat = np.concatenate([set_fingerprint(x, words) for x in sets]) if sets else np.empty(0, np.uint64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * words), pa.array(flat.view(np.int64)))
            digest = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            sums = [x.sum(dtype=np.uint64) if len(x) <= SHORT + 1 else None for x in sets]
            own = pa.array([None if a is None else int(a.view(np.int64)) for a in sums], pa.int64())
            less = pa.array([None if a is None else (a - x).view(np.int64) for a, x in zip(sums, sets)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array([len(x) for x in sets], pa.int64()), digest, own, less], names=["doc_id", "text_hash", "fp", "shingles", "digest", "own", "less"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp array<long>, shingles long, digest binary, own long, less array<long>")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, shingles): fp is the fingerprint's words as signed longs."""

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(t.as_py(), shingle, seed, words) for t in b.column(2)]
            flat = np.concatenate([f for f, _ in found]) if found else np.empty(0, np.uint64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * words), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array([n for _, n in found], pa.int64())], names=["doc_id", "text_hash", "fp", "shingles"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp array<long>, shingles long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """Arrays of the inner nodes: vantage point, radius, children; a child below 0 is leaf -child - 1."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.point, self.radius, self.inside, self.outside, self.leaves = [], [], [], [], 0
        self.rng = np.random.default_rng(seed)
        self.top = self._grow(np.unique(sample), max(0, int(np.ceil(np.log2(max(1, leaves))))))
        self.point = np.array(self.point, np.uint64)

    def _grow(self, points: np.ndarray, depth: int) -> int:
        """Of a few vantage points that are tried, the one whose distances spread most lets the fewest balls cross its border."""
        best = None
        if depth and len(points) >= 8:
            for p in points[self.rng.integers(0, len(points), 12)]:
                d = distance(points, p)
                for r in sorted({int(np.median(d)), int(np.median(d)) - 1}):
                    share = (d <= r).mean()
                    if 0.2 <= share <= 0.8:
                        cost = ((d <= r + 2) & (d > r - 2)).mean() + abs(share - 0.5) / 2
                        if best is None or cost < best[0]:
                            best = cost, p, r, d
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, p, r, d = best
        at = len(self.point)
        self.point.append(p)
        self.radius.append(r)
        self.inside.append(0)
        self.outside.append(0)
        self.inside[at] = self._grow(points[d <= r], depth - 1)
        self.outside[at] = self._grow(points[d > r], depth - 1)
        return at

    def visit(self, points: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, is home, is before home): all leaves that the ball may reach."""
        found = []
        work = [(self.top, np.arange(len(points)), np.ones(len(points), bool))] if len(points) else []
        while work:
            node, which, home = work.pop()
            if not len(which):
                continue
            if node < 0:
                found.append((which, np.full(len(which), -node - 1), home))
                continue
            d, r = distance(points[which], self.point[node]), self.radius[node]
            to_in, to_out = d - within <= r, d + within > r
            work.append((self.inside[node], which[to_in], home[to_in] & (d[to_in] <= r)))
            work.append((self.outside[node], which[to_out], home[to_out] & (d[to_out] > r)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
        which, leaf, home = (np.concatenate(x) for x in zip(*found))
        at = np.empty(len(points), np.int64)
        at[which[home]] = leaf[home]
        return which, leaf, home, leaf < at[which]


def leaf_links(points: np.ndarray, home: np.ndarray, within: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, index of the least of its local group) among the home points and between them and the visitors.

    points: one row of words each. Pairs are linked if they differ in at most `within` bits, and in at most `first`
    of the first word. The ring rule: pairs whose distances to a vantage point differ by more than `first` are out.
    """
    d = distance(points[:, 0], points[0, 0])
    order = np.argsort(d, kind="stable")
    points, home, d = points[order], home[order], d[order]
    members = np.flatnonzero(home)
    forest, md, mp, word = Forest(len(points)), d[members], points[members], np.ascontiguousarray(points[members, 0])
    at = 0
    while at < len(points):
        lo = np.searchsorted(md, d[at] - first)
        to = min(len(points), at + 4096)
        while True:
            hi = np.searchsorted(md, d[to - 1] + first, side="right")
            if (hi - lo) * (to - at) <= _BITS or to - at == 1:
                break
            to = at + max(1, (to - at) // 2)
        for m in range(lo, hi, _BITS):
            end = min(hi, m + _BITS)
            i, j = np.nonzero(np.bitwise_count(points[at:to, 0, None] ^ word[None, m:end]) <= first)
            i, j = i + at, j + m
            if points.shape[1] > 1:
                near = np.bitwise_count(points[i] ^ mp[j]).sum(1, dtype=np.int64) <= within
                i, j = i[near], j[near]
            forest.link(i, members[j])
        at = to
    linked = np.flatnonzero(forest.root != np.arange(len(points)))
    return order[linked], order[forest.root[linked]]


def fingerprint_links(points: DataFrame, within: int, first: int, ratio: float | None = None, sample_base: int = 64, block: int = 1 << 16) -> DataFrame:
    """Links (x, y) between the rows (point, fp, shingles): those that join the same points as all pairs at most `within` bits
    apart would, of which the first word differs by `first` at most and, given a ratio, the numbers of shingles by no more than that."""
    spark = points.sparkSession
    ship(spark)
    n = points.count()
    leaves = max(1, slices(n) // (64 if ratio else 16))
    share = min(1.0, sample_base * leaves / max(1, n))
    word = points.select(F.col("fp")[0].alias("w"))
    sampled = word.where(F.pmod(F.hash("w"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toPandas() if n else pd.DataFrame({"w": []})
    tree = VantageTree(sampled["w"].to_numpy(np.int64).view(np.uint64) if len(sampled) else np.zeros(1, np.uint64), leaves)
    held = spark.sparkContext.broadcast(tree)
    step = np.log(1 / ratio) if ratio else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(b.num_rows, -1)
            band = np.floor(np.log(np.maximum(b.column(2).to_numpy(zero_copy_only=False), 1)) / step + 1e-9).astype(np.int64) if step else np.zeros(b.num_rows, np.int64)
            for at in range(0, b.num_rows, 8192):
                which, leaf, home, before = held.value.visit(np.ascontiguousarray(fp[at : at + 8192, 0]), first)
                which, own = which + at, home | before
                # In its own band a point meets the leaves up to its home, in the band below all that its ball reaches.
                parts = [(which[own], leaf[own], band[which[own]], home[own])]
                if step:
                    parts.append((which, leaf, band[which] - 1, np.zeros(len(which), bool)))
                for w, to, of, at_home in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(to), b.column(0).take(pa.array(w)), b.column(1).take(pa.array(w)), pa.array(at_home)], names=["band", "leaf", "point", "fp", "home"])

    def link(group: pa.Table) -> pa.Table:
        home = group.column("home").to_numpy(zero_copy_only=False)
        if not home.any():
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
        point = group.column("point").to_numpy()
        fp = group.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(point), -1)
        x, y = leaf_links(fp, home, within, first)
        return pa.table({"x": point[x], "y": point[y]})

    placed = written(points.select("point", "fp", "shingles").mapInArrow(place, "band long, leaf long, point long, fp array<long>, home boolean"), "leaves")
    return in_units(placed, ["band", "leaf"], block).applyInArrow(link, "x long, y long")


def short_links(points: DataFrame, ratio: float) -> DataFrame:
    """Links (x, y) from each point to those whose set is its own without one shingle, if that keeps `ratio` of it: by a join of sums, so
    that none is missed. With few shingles the fingerprints of such texts may be far apart."""
    less = points.where((F.col("shingles") <= SHORT + 1) & (F.col("shingles") - 1 >= F.lit(ratio) * F.col("shingles"))).select(F.col("point").alias("x"), F.explode("less").alias("_less"))
    return less.join(points.where(F.col("shingles") <= SHORT).select(F.col("own").alias("_own"), F.col("point").alias("y")), F.col("_less") == F.col("_own")).select("x", "y")


def in_units(rows: DataFrame, group: list[str], block: int, size: Column | None = None, most: int = 1 << 22, least: int = 1 << 12) -> GroupedData:
    """The rows by group; groups of more than `block` rows, or of more than four times their mean but not below `least`, or whose rows'
    `size` adds up to more than `most`, are dealt into blocks by their point, and each pair of blocks is a unit."""
    sizes = written(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.lit(0) if size is None else size).alias("_size")), "group-sizes")
    mean = sizes.agg(F.avg("_n")).first()[0] or 0
    blocks = F.greatest(F.ceil(F.col("_n") / F.lit(min(block, max(least, int(4 * mean))))), F.ceil(F.col("_size") / F.lit(most)))
    crowded = sizes.select(*group, blocks.alias("_blocks")).where("_blocks > 1")
    if crowded.isEmpty():
        return rows.groupBy(*group)
    cut = rows.join(crowded, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("point", F.lit(5)), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cut = cut.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_blocks", "_own", "_other")
    return cut.groupBy(*group, "_i", "_j")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    found = (text or "").encode().translate(_LOWER).split()
    size = min(shingle, len(found))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + size])) for i in range(len(found) - size + 1)) if found else (), np.uint64))


def shared(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def checked_links(fp: np.ndarray, sets: list[np.ndarray], within: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (index, least of its group) by similarities of at least `ratio`, among pairs whose fingerprints are near: at most `within`
    bits apart, or WIDE where one has at most SHORT shingles.

    Pairs are tried nearest first, one for each row and round, and only while their groups differ: a group of n
    copies takes about n trials, and a pair is left out only if its ends are linked already.
    """
    n, size, forest = len(fp), np.array([len(x) for x in sets]), Forest(len(fp))
    step = max(1, _BITS // max(1, n))
    for at in range(0, n, step):
        to = min(n, at + step)
        d = np.zeros((to - at, n), np.int16)
        for w in range(fp.shape[1]):
            d += np.bitwise_count(fp[at:to, w, None] ^ fp[None, :, w])
        small, large = np.minimum(size[at:to, None], size[None]), np.maximum(size[at:to, None], size[None])
        i, j = np.nonzero((d <= np.where(small <= SHORT, max(within, WIDE), within)) & (small >= ratio * large) & (np.arange(at, to)[:, None] < np.arange(n)[None]))
        order = np.argsort(d[i, j], kind="stable")
        i, j = i[order] + at, j[order]
        while True:
            apart = forest.root[i] != forest.root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            first = np.unique(i, return_index=True)[1]
            good = np.array([shared(sets[a], sets[b]) >= ratio for a, b in zip(i[first].tolist(), j[first].tolist())])
            forest.link(i[first][good], j[first][good])
            rest = np.ones(len(i), bool)
            rest[first] = False
            i, j = i[rest], j[rest]
    linked = np.flatnonzero(forest.root != np.arange(n))
    return linked, forest.root[linked]


def verified_links(docs: DataFrame, points: DataFrame, groups: DataFrame, shingle: int, ratio: float, within: int, id_col: str, text_col: str, block: int = 1 << 12, most: int = 1 << 22, broadcast_keys: int = 1 << 17) -> DataFrame:
    """Links (x, y) between the points of each group (vertex, component) whose texts share `ratio` of their shingles. Only the texts of such
    points move, each once; the keys that find them are broadcast if they are few, and joined by a shuffle if not. A task has about two
    blocks of at most `block` points and `most` shingles."""
    wanted = written(points.join(groups, F.col("point") == F.col("vertex")).select("point", "component", "fp", row_key(F.col("least.doc_id"), F.col("least.text_hash")).alias("_key")), "near-candidates")
    side = F.broadcast(wanted) if wanted.count() <= broadcast_keys else wanted
    texts = docs.select(row_key(F.col(id_col), F.xxhash64(text_col)).alias("_key"), F.col(text_col).alias("text")).join(side, "_key").select("component", "point", "fp", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column(3)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["component", "point", "fp", "shingles"])

    def link(group: pa.Table) -> pa.Table:
        point, first = np.unique(group.column("point").to_numpy(), return_index=True)  # rows that repeat an id and a text are one point
        group = group.take(pa.array(first))
        fp = group.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(point), -1)
        lists = group.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        x, y = checked_links(fp, np.split(flat, ends[:-1]), within, ratio)
        return pa.table({"x": point[x], "y": point[y]})

    sets = written(texts.mapInArrow(hashed, "component long, point long, fp array<long>, shingles array<long>"), "shingle-sets")
    return in_units(sets, ["component"], block, F.size("shingles"), most).applyInArrow(link, "x long, y long")


def _groups(docs: DataFrame, within: int, first: int, ratio: float | None, shingle: int, seed: int, words: int, id_col: str, text_col: str) -> DataFrame:
    found = set_fingerprints(docs, shingle, words, id_col, text_col) if ratio else fingerprints(docs, shingle, seed, words, id_col, text_col)
    rows = written(found, "fingerprints")
    key, same = ("digest", ["digest", "fp", "shingles", "own", "less"]) if ratio else ("fp", ["fp"])  # with a ratio, only texts of one set are one point: all others are checked
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least")
    points = rows.groupBy(*same).agg(least, F.max("shingles").alias("most"))
    points = written(points.select(F.monotonically_increasing_id().alias("point"), *[c for c in same if c != "shingles"], F.col("most").alias("shingles"), "least"), "points")
    links = fingerprint_links(points, within, first, ratio)
    groups = components(links.unionByName(short_links(points, ratio)) if ratio else links, "x", "y")
    if ratio:
        groups = components(verified_links(docs, points, groups, shingle, ratio, within, id_col, text_col), "x", "y")
    of_point = points.join(groups, F.col("point") == F.col("vertex"), "left").withColumn("top", F.coalesce("component", "point"))
    tops = of_point.groupBy("top").agg(F.min("least").alias("first"))
    named = written(of_point.join(tops, "top").select(F.col(key).alias("_of"), "first"), "point-groups")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    joined = rows.join(named, F.col(key) == F.col("_of"))
    return joined.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), kept.alias("kept"), "text_hash")


def near_groups(docs: DataFrame, within: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint as 16 hexadecimal digits, component_id (the least doc_id that links lead to), kept, text_hash.

    kept: the row whose doc_id is component_id; of several such, those whose text has the least hash.
    """
    return _groups(docs, within, within, None, shingle, seed, 1, id_col, text_col).withColumn("fp", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))).withColumnRenamed("fp", "fingerprint")


def near_texts(docs: DataFrame, shingle: int = 5, ratio: float = 0.8, within: int = 64, first: int = 22, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, component_id, kept, text_hash, where texts that share `ratio` of their shingles are linked.

    Fingerprints of 256 bits at most `within` apart find the pairs to check: two texts that share 0.8 of their
    shingles differ in 38 to 41 bits, give or take 6, and unrelated ones in 128, give or take 8. Only sets of five and four differ more,
    in 48; pairs of at most SHORT + 1 shingles of which one set has just one more than the other are found by sums, whatever their distance.
    """
    return _groups(docs, within, first, ratio, shingle, seed, 4, id_col, text_col).drop("fp")


def survivors(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of every group of near texts, with all its columns: that with the least id; of rows that repeat its id and text, one."""
    kept = near_texts(docs, shingle, id_col=id_col, text_col=text_col).where("kept").select(row_key(F.col("doc_id"), F.col("text_hash")).alias("key"))
    return kept_rows(docs, row_key(F.col(id_col), F.xxhash64(text_col)), kept, once=True)
