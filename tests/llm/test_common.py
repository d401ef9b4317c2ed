import os
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphspun.llm import common
from graphspun.llm.components import components


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="a é\t\n\x0b\x0c\r \x1c", max_size=12)), min_size=1, max_size=20))
def test_spaces_and_words(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", common.one_space("t").alias("s"), common.n_words("t").alias("n")).collect():
        text = texts[r.i] or ""
        assert r.s == re.sub(r"[\x20\x09-\x0D]+", " ", text)
        assert r.n == len(re.findall(r"[^\x20\x09-\x0D]+", text))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 99), st.integers(0, 5)), max_size=40))
def test_running_sums(spark, rows):
    df = spark.createDataFrame([(g, k, v, i) for i, (g, k, v) in enumerate(rows)], "g string, k int, v int, i int").withColumn("s", (F.col("k") / 7).cast("int"))
    found = {r.i: r.before for r in common.before_in_group(df, "g", "s", [F.col("k"), F.col("i")], "v", "before").collect()}
    groups = defaultdict(list)
    for i, (g, k, v) in enumerate(rows):
        groups[g].append((k, i, v))
    expected = {}
    for members in groups.values():
        total = 0
        for _, i, v in sorted(members):
            expected[i] = total
            total += v
    assert found == expected


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
def test_components(spark, edges):
    root = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert Counter((r.vertex, r.component) for r in found) == Counter((v, find(v)) for v in root)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(300).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    star = spark.range(1000, 1400).select(F.lit(1400).cast("long").alias("x"), F.col("id").alias("y"))
    found = components(chain.unionByName(star), "x", "y")
    assert found.groupBy("component").count().orderBy("component").collect() == [(0, 301), (1000, 401)]


def test_written_tables_are_shared_and_removed(spark):
    df = common.written(spark.range(5), "test-table")
    path = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert common.shared_dir(spark) in path and df.count() == 5
    common.release()
    assert not os.path.exists(path)


def test_the_sessions_folder_is_used():
    conf = SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "hdfs://shared/x"}.get(key, default))
    assert common.shared_dir(SimpleNamespace(conf=conf)) == "hdfs://shared/x"


def test_no_local_folder_on_a_cluster():
    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=context))


def test_fresh_names():
    assert common.fresh(["a", "_KEY", "_key_"], "_key") == "_key__" and common.fresh(["a"], "_key") == "_key"
