"""Parents with lists of their related rows, and predicates on related rows.

Each list is collected by itself, by its parent's key, before it meets the parent: several lists side by
side never multiply. Parents without related rows stay, with an empty list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(rows: Column, width: int) -> Column:
    """A list of structs of `width` sort fields and one last field `row`, sorted; only the rows remain."""
    return F.transform(F.array_sort(rows), lambda x: x["row"])


def collected(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str, distinct: bool = True) -> DataFrame:
    """(key, name): the children of each key as a list of structs, sorted by `order`, nulls last, then by all fields; an edge that is there twice counts once."""
    sort = [c for o in order for c in (F.col(o).isNull(), F.col(o))] + [F.col(f) for f in fields if f not in order]
    row = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(sort)], F.struct(*fields).alias("row"))
    gather = F.collect_set if distinct else F.collect_list
    return children.where(F.col(key).isNotNull()).groupBy(key).agg(in_order(gather(row), len(sort)).alias(name))


def expand(parents: DataFrame, key: str, children: DataFrame, child_key: str, order: Sequence[str], fields: Sequence[str], name: str, distinct: bool = True, narrow: bool = False) -> DataFrame:
    """`parents` with the list `name` of their children; an empty list where there are none.

    narrow: where few parents are left, only their children are collected: they meet the parents' keys in a semi join first.
    """
    if narrow:
        children = some(children, child_key, parents, key)
    kind = children.select(F.struct(*fields).alias("x")).schema["x"].dataType.simpleString()
    lists = collected(children.withColumn("_key", F.col(child_key)), "_key", order, fields, name, distinct)
    joined = parents.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))


def along_few(edge: DataFrame, to: str, nodes: DataFrame, key: str, few: int = 1 << 17) -> DataFrame:
    """along() for a node table that is usually small: up to `few` nodes, which are counted, are broadcast, so that the edges stay where they are."""
    return along(edge, to, F.broadcast(nodes) if nodes.limit(few + 1).count() <= few else nodes, key)


def along(edge: DataFrame, to: str, nodes: DataFrame, key: str) -> DataFrame:
    """An edge table with the columns of the nodes at its end `to`; edges to nowhere go."""
    return edge.withColumnRenamed(to, "_to").join(nodes, F.col("_to") == F.col(key)).drop("_to")


def some(parents: DataFrame, key: str, edge: DataFrame, edge_key: str) -> DataFrame:
    """Parents with at least one row in `edge`."""
    return parents.join(edge.select(F.col(edge_key).alias("_key")), F.col(key) == F.col("_key"), "left_semi")


def some_few(parents: DataFrame, key: str, edge: DataFrame, edge_key: str, parts: int, few: int = 1 << 18) -> DataFrame:
    """some() where the edge is usually small, such as that of one entity: up to `few` rows, which are counted, are broadcast; more meet the parents in `parts` partitions."""
    if edge.limit(few + 1).count() <= few:
        return some(parents, key, F.broadcast(edge.select(edge_key)), edge_key)
    return some(parents.repartition(parts, key), key, edge, edge_key)


def single(parents: DataFrame, key: str, edge: DataFrame, edge_key: str, to: str) -> DataFrame:
    """Parents with exactly one different `to` in `edge`. Its distinct pairs are combined before the shuffle."""
    once = edge.select(edge_key, to).distinct().groupBy(edge_key).count().where("count = 1")
    return some(parents, key, once, edge_key)


def shared(edge: DataFrame, of: str, by: str, parts: int) -> DataFrame:
    """(of, other, n): the pairs of others() with the number of `by` that they share, in partitions of bounded work.

    Edges are dealt by a hash of `by`, whose members are listed. Each pair is made once, the smaller member first, and combined with its
    like in its lot of `by` before it moves; both directions follow when all is counted.
    """
    rows = edge.where(F.col(of).isNotNull() & F.col(by).isNotNull()).withColumn("_lot", F.pmod(F.xxhash64(by), F.lit(64 * parts)))
    lists = rows.repartition(parts, "_lot").select("_lot", by, of).distinct().groupBy("_lot", by).agg(F.collect_list(of).alias("_all"))
    pairs = lists.where(F.size("_all") > 1).select("_lot", "_all", F.explode("_all").alias("_a")).select("_lot", "_a", F.explode(F.filter("_all", lambda x: x > F.col("_a"))).alias("_b"))
    combined = pairs.groupBy("_lot", "_a", "_b").agg(F.count(F.lit(1)).alias("_n")).select("_a", "_b", "_n")
    counted = combined.repartition(2 * parts, "_a", "_b").groupBy("_a", "_b").agg(F.sum("_n").alias("n"))
    both = F.explode(F.array(F.struct(F.col("_a").alias("of"), F.col("_b").alias("other")), F.struct(F.col("_b").alias("of"), F.col("_a").alias("other"))))
    return counted.select(both.alias("_pair"), "n").select(F.col("_pair.of").alias(of), F.col("_pair.other").alias("other"), "n")


def others(edge: DataFrame, of: str, *by: str) -> DataFrame:
    """(of, by, other): for each row of the edge table the other members that share all columns `by`, not itself.

    The result has as many rows as there are such pairs, so a `by` with very many members makes very many; a narrower `by` is the way to fewer.
    """
    pairs = edge.select(of, *by).distinct()
    mate = pairs.select(F.col(of).alias("other"), *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
    same = F.col(of) != F.col("other")
    for i, b in enumerate(by):
        same = same & (F.col(b) == F.col(f"_by{i}"))
    return pairs.join(mate, same).drop(*[f"_by{i}" for i in range(len(by))])


def summary(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """(key, n_{name}, first_{name}, last_{name}) of the list that collected() makes: its length, first and last row as structs, without the list; for keys of any number of children."""
    rows = children.where(F.col(key).isNotNull()).select(key, *{*order, *fields}).distinct()
    sort = F.struct(*[c.alias(f"s{i}") for i, c in enumerate([c for o in order for c in (F.col(o).isNull(), F.col(o))] + [F.col(f) for f in fields if f not in order])])
    row = F.struct(*fields)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min_by(row, sort).alias(f"first_{name}"), F.max_by(row, sort).alias(f"last_{name}"))


def first_related(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], count: str | None = None) -> DataFrame:
    """(key, fields): the first child of each key, nulls last; with `count`, how many there are."""
    sort = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(c for o in order for c in (F.col(o).isNull(), F.col(o)))])
    picks = [F.min_by(F.struct(*fields), sort).alias("_first")] + ([F.count(F.lit(1)).alias(count)] if count else [])
    return children.groupBy(key).agg(*picks).select(key, *[F.col(f"_first.{f}").alias(f) for f in fields], *([count] if count else []))


def ends(children: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, first, last): the first and the last child of each key, as structs."""
    sort = F.struct(*order)
    return children.groupBy(key).agg(F.min_by(F.struct(*fields), sort).alias("first"), F.max_by(F.struct(*fields), sort).alias("last"))
