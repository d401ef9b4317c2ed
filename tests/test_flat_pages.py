"""Flat rows of pages against the nested pages, positions in groups of any size, and that work is dealt into more parts as tables grow."""

import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from test_graph import g  # noqa: F401

import __spark_entry__ as entry
from graphspun.operators import nested as N
from graphspun.operators.ordering import numbered_within
from graphspun.plans import documents as D

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
needs = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def plan(spark, name, d=DATA):
    return entry.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Settings for one test."""
    before = {}

    def put(key, value):
        before[key] = spark.conf.get(key)
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture
def doubled(g):  # noqa: F811
    """Every edge twice: it counts once."""
    return g | {k: g[k].union(g[k]) for k in ("event_participant", "event_place", "event_in_group", "event_verse", "event_year", "mentions_place", "has_been_here", "writes", "group_year")}


def test_period_rows_are_the_nested_pages(g, doubled):  # noqa: F811
    years = D.period_pages(g).select("slug", F.explode_outer("years").alias("y")).select("slug", F.col("y.formatted_year").alias("formatted_year"), F.posexplode_outer("y.events").alias("at", "e"))
    nested = years.select("slug", "formatted_year", F.col("at") + 1, *[F.col(f"e.{c}") for c in ("event_id", "sequence", "passage", "people_names", "place_names")])
    assert listed(D.period_rows(g)) == listed(nested) and listed(D.period_rows(doubled)) == listed(nested)


def test_person_timeline_rows_are_the_nested_pages(g, doubled):  # noqa: F811
    rows = D.person_timeline_rows(g)
    nested = D.person_pages(g).select("slug", F.posexplode("timeline").alias("at", "e")).select("slug", F.col("at") + 1, *[F.col(f"e.{c}") for c in rows.columns[2:]])
    assert listed(rows) == listed(nested) and listed(D.person_timeline_rows(doubled)) == listed(nested)


@pytest.mark.parametrize("slug", [None, "adam"])
def test_profiles_are_the_nested_pages(g, doubled, slug):  # noqa: F811
    books = F.transform("books", lambda b: F.concat(b["title"], F.lit(" ("), F.array_join(F.transform(b["writers"], lambda w: w["name"]), ", "), F.lit(")")))
    nested = D.person_pages(g, slug).select("slug", "parents", "children", "partners", "groups", "birth", "death", books, F.size("timeline"))
    for x in (g, doubled):
        pages = D.person_profiles(x, slug)
        assert listed(pages.select("slug", "parents", "children", "partners", "groups", "birth", "death", "books", "n_events")) == listed(nested)
    assert {r.slug: len(r.books) for r in D.person_profiles(g, slug, writers=False).collect()} == {r.slug: len(r.books) for r in D.person_pages(g, slug).collect()}


def test_place_rows_are_the_nested_pages(g, doubled):  # noqa: F811
    rows = D.place_timeline_rows(g)
    nested = D.place_pages(g).select("slug", F.posexplode("timeline").alias("at", "e")).select("slug", F.col("at") + 1, *[F.col(f"e.{c}") for c in rows.columns[2:]])
    assert listed(rows) == listed(nested) and listed(D.place_timeline_rows(doubled)) == listed(nested)
    ends = [f(F.col(x))[y] for x, y in (("visitors", "other"), ("verses", "osis_ref"), ("timeline", "event_id")) for f in (lambda c: F.get(c, F.lit(0)), lambda c: F.try_element_at(c, F.lit(-1)))]
    nested = D.place_pages(g).select("slug", "zoom", *ends, *[F.size(x) for x in ("visitors", "verses", "timeline")])
    flat = ["slug", "zoom", *[f"{e}_{x}.{y}" for x, y in (("visitors", "other"), ("verses", "osis_ref"), ("timeline", "event_id")) for e in ("first", "last")], *[f"n_{x}" for x in ("visitors", "verses", "timeline")]]
    assert listed(D.place_summaries(g).select(*flat)) == listed(nested) and listed(D.place_summaries(doubled).select(*flat)) == listed(nested)


def test_positions_in_groups_by_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 7 % 3).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("b"), "id")
    pos = F.row_number().over(Window.partitionBy("a").orderBy(F.col("b").asc_nulls_last(), "id"))
    for small in (0, 1 << 40):
        assert listed(numbered_within(rows, ["a"], ["b", "id"], small=small, parts=9)) == listed(rows.withColumn("pos", pos))


def test_shared_is_the_count_of_others(spark):
    edge = spark.sql("SELECT id % 13 * (id % 3) AS who, CAST(id / 5 AS INT) AS what FROM range(900) UNION ALL SELECT CAST(NULL AS BIGINT), 3 UNION ALL SELECT 1, NULL UNION ALL SELECT 2, NULL")
    edge = edge.union(edge)
    assert listed(N.shared(edge, "who", "what", 3)) == listed(N.others(edge, "who", "what").groupBy("who", "other").count())


@pytest.mark.parametrize("name", ["period_page", "person_page", "person_sections", "person_page_timeline", "place_page", "place_page_timeline"])
def test_no_list_of_events_is_collected(spark, name):
    """Of an entity of any size: its events, visitors or verses are rows or counts; a book's writers do not move with its readers."""
    text = plan(spark, name)
    nested = r"\((?:[^()\n]|\((?:[^()\n]|\((?:[^()\n]|\([^()\n]*\))*\))*\))*\)"  # up to four deep
    lists = re.findall(r"collect_(?:set|list)" + nested, text)
    assert not [x for x in lists if re.search(r"\b(event_id|verse_id|id|person_name|writers|passage|sort_key)#", x)]


@needs
@pytest.mark.parametrize("name", ["exclude_self", "self_edge"])
def test_pairs_are_dealt_into_more_parts_as_the_lines_grow(spark, conf, name):
    conf("spark.sql.shuffle.partitions", "1")
    counts = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan(spark, name, LARGER))]
    assert counts and max(counts) > 1


def test_a_timeline_meets_its_keys_before_all_else(spark, conf, monkeypatch):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr("graphspun.plans.queries.numbered", lambda df, *a: df.withColumn("pos", F.lit(1)))  # which may write the rows
    text = plan(spark, "person_timeline")
    assert len(re.findall(r"BroadcastHashJoin [^\n]*LeftSemi", text)) >= 2 and not re.search(r"SortMergeJoin [^\n]*LeftSemi", text)
