"""Embedding near-dedup by p-stable hashing, with exact cosine checks.

Normalised vectors of one label fall into buckets of several tables: a table quantises `k` random
projections, floor((a.v + b) / width), and hashes the k numbers. Vectors that share a bucket are compared
by cosine in double precision. Equal vectors are one point with a multiplicity. `k` and the number of
tables follow from the number of points and from the collision probability at the threshold, so that
buckets stay small as the input grows and a pair at the threshold is missed with the stated probability.

A pair is counted only in the first table in which it shares a bucket; so links are counted without ever
being listed, and a bucket emits counts and links to the least vector of a local group. A bucket of
more than `block` points is cut into blocks, and each pair of blocks is a task of its own.

Defined results. Label null, vector null, zero, empty, or with a null or non-finite component: linked with
nothing, its own component. Vectors of different length are not compared. Id null: linked like any other; never the
component's id unless all are null. Repeated rows: each counts as a vector. Empty table: no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspun.llm.common import ship, written
from graphspun.llm.components import components
from graphspun.llm.unionfind import Forest


def collision(distance: float, width: float) -> float:
    """The probability that one quantised Gaussian projection puts two points of this distance in one cell."""
    c = width / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def parameters(points: int, cosine: float, width: float, miss: float, bucket: int) -> tuple[int, int]:
    """(projections of a table, tables): so many projections that unrelated points of a set of this size share a bucket
    with about `bucket` others, and so many tables that a pair at the threshold is missed with probability `miss` at most."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(1.0, points / bucket)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))


class Tables:
    """The random projections, drawn from the seed for each vector length, and the hash of their quantised values."""

    def __init__(self, k: int, tables: int, width: float, seed: int):
        self.k, self.tables, self.width, self.seed, self.drawn = k, tables, width, seed, {}

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            self.drawn[dim] = rng.standard_normal((dim, self.k * self.tables)), rng.uniform(0, self.width, self.k * self.tables), rng.integers(1, 1 << 62, self.k, dtype=np.int64) | 1
        a, b, odd = self.drawn[dim]
        cells = np.floor((unit @ a + b) / self.width).astype(np.int64).reshape(len(unit), self.tables, self.k)
        mixed = ((cells * odd).sum(2, dtype=np.int64)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(33)).astype(np.int32)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if flat.dtype == np.int32 else flat.astype(np.float64)).reshape(-1, width)


def bucket_links(vectors: np.ndarray, sides: np.ndarray, many: np.ndarray, buckets: np.ndarray, table: int, cosine: float, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(links of each point, root of each point) among points of one bucket. Sides 0 and 1: only pairs across count; all sides 2: all pairs."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    n, links, forest = len(unit), np.zeros(len(unit), np.int64), Forest(len(unit))
    for at in range(0, n, rows):
        for to in range(at, n, rows):
            i, j = np.nonzero(unit[at : at + rows] @ unit[to : to + rows].T >= cosine)
            i, j = i + at, j + to
            own = (i < j) & ((sides[i] != sides[j]) | (sides[i] == 2))
            i, j = i[own], j[own]
            if not len(i):
                continue
            first = ~(buckets[i, :table] == buckets[j, :table]).any(1) if table else np.ones(len(i), bool)
            i, j = i[first], j[first]
            np.add.at(links, i, many[j])
            np.add.at(links, j, many[i])
            forest.link(i, j)
    return links, forest.root


def near_vectors(vectors: DataFrame, cosine: float = 0.93, width: float = 3.0, miss: float = 0.01, bucket: int = 512, block: int = 1024, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, F.struct(F.col(label_col).alias("label"), v.alias("v"))).alias("key"))
    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("many"))
    points = written(groups.select(F.monotonically_increasing_id().alias("point"), "key", "least", "many"), "vector-points")
    n = points.count()
    k, tables = parameters(n, cosine, width, miss, bucket)
    held = spark.sparkContext.broadcast(Tables(k, tables, width, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            out = np.zeros((b.num_rows, held.value.tables), np.int32)
            for dim in np.unique(sizes):
                which = np.flatnonzero(sizes == dim)
                unit = _matrix(b.column(1).take(pa.array(which)), dim)
                unit = unit / np.abs(unit).max(1, keepdims=True)
                out[which] = held.value.buckets(unit / np.linalg.norm(unit, axis=1, keepdims=True))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["point", "buckets"])

    hashed = points.select("point", F.col("key.v").alias("v")).mapInArrow(place, "point long, buckets array<int>")
    hashed = written(hashed, "vector-buckets")
    base = points.select("point", F.col("key.label").alias("label"), F.size("key.v").alias("dim"), F.col("key.v").alias("v"), "many").join(hashed, "point")
    entries = base.select("point", "label", "dim", F.posexplode("buckets").alias("t", "bucket"))
    sizes = entries.groupBy("label", "dim", "t", "bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    met = entries.join(sizes, ["label", "dim", "t", "bucket"]).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("point", F.lit(5)), F.col("_blocks")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("point", "label", "dim", "t", "bucket", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.when(F.col("_own") == F.col("_other"), F.lit(2)).when(F.col("_own") < F.col("_other"), F.lit(0)).otherwise(F.lit(1)).alias("side"))
    full = met.join(base.select("point", "v", "many", "buckets"), "point")

    def compare(group: pa.Table) -> pa.Table:
        point = group.column("point").to_numpy()
        if len(point) < 2:
            return pa.table({"point": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        vectors = _matrix(group.column("v"), group.column("dim")[0].as_py())
        vectors = vectors / np.abs(vectors).max(1, keepdims=True)
        links, root = bucket_links(vectors, group.column("side").to_numpy(), group.column("many").to_numpy(), _matrix(group.column("buckets"), held.value.tables), group.column("t")[0].as_py(), cosine)
        some = np.flatnonzero(links)
        return pa.table({"point": point[some], "links": links[some], "root": point[root[some]]})

    found = written(full.groupBy("label", "dim", "t", "bucket", "_i", "_j").applyInArrow(compare, "point long, links long, root long"), "vector-links")
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    groups = components(found, "point", "root")
    named = points.join(counts, "point", "left").join(groups, F.col("point") == F.col("vertex"), "left").select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "point").alias("top"))
    named = written(named, "vector-groups")
    tops = named.groupBy("top").agg(F.min("least").alias("component_id"))
    done = named.join(tops, "top").select(F.col("key").alias("_key"), "n_links", "component_id")
    joined = rows.join(done, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
