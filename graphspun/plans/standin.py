"""A graph made of the driver's tables, so that the page documents run over whole tables.

Nations are books (regions their testaments) and places, customers chapters, orders verses and events, suppliers people,
priorities periods. All statements are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspun.sources.schemas import GRAPH
from graphspun.sources.tables import parts, read

_REF = "'The Book of ' || chr(65 + n_nationkey) || ' ' || CAST(c_custkey AS STRING)"
_YEAR = "CAST(year(o_orderdate) AS INT)"
_GROUPED = "SELECT o_orderkey AS event_id, lower(o_orderpriority) AS event_group, {year} AS year FROM {{orders}} UNION ALL SELECT o_orderkey, 'in-progress', {year} FROM {{orders}} WHERE o_orderstatus = 'P'".format(year=_YEAR)
_CHAPTERS = "{customer} c JOIN {nation} n ON c_nationkey = n_nationkey"
_VERSES = "{orders} o JOIN {customer} c ON o_custkey = c_custkey JOIN {nation} n ON c_nationkey = n_nationkey"
_K = "CAST(s_suppkey AS STRING)"

TABLES = {
    "testament": "SELECT r_name AS title FROM {region}",
    "book": "SELECT lower(chr(65 + n_nationkey)) || '-book' AS slug, 'The Book of ' || chr(65 + n_nationkey) AS title, n_nationkey AS book_order, r_name AS testament FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "chapter": f"SELECT chr(65 + n_nationkey) || '.' || CAST(c_custkey AS STRING) AS osis_ref, {_REF} AS title, CAST(c_custkey AS INT) AS chapter_num, lower(chr(65 + n_nationkey)) || '-book' AS book_slug FROM {_CHAPTERS}",
    "verse": f"SELECT o_orderkey AS verse_id, chr(65 + n_nationkey) || '.' || CAST(c_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING) AS osis_ref, {_REF} || ':' || CAST(o_orderkey AS STRING) AS full_ref, {_REF} || ':' || CAST(o_orderkey AS STRING) AS title,"
    f" CAST(o_orderkey AS INT) AS verse_num, lower(o_orderpriority) || ' of state ' || o_orderstatus AS verse_text, '**' || o_orderpriority || '**' AS md_text, chr(65 + n_nationkey) || '.' || CAST(c_custkey AS STRING) AS chapter_ref FROM {_VERSES}",
    "person": f"SELECT 'supplier-' || {_K} AS slug, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN split('Alias ' || {_K} || ',Dealer of ' || CAST(s_nationkey AS STRING), ',') END AS also_called, CAST(NULL AS STRING) AS description,"
    " CASE s_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS gender, CASE WHEN s_suppkey % 10 = 0 THEN 'wip' END AS status FROM {supplier}",
    "place": "SELECT 'place-' || CAST(n_nationkey AS STRING) AS slug, n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'wip' END AS status, CAST(NULL AS STRING) AS description, CAST(n_nationkey AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,"
    " CASE n_nationkey % 5 WHEN 0 THEN 'Region' WHEN 1 THEN 'Water' WHEN 2 THEN 'Island' WHEN 3 THEN 'City' END AS feature_type FROM {nation}",
    "event": "SELECT o_orderkey AS event_id, 'Event ' || CAST(o_orderkey AS STRING) AS title, CAST(o_orderkey % 97 AS INT) AS sequence, CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS DOUBLE) AS sort_key FROM {orders}",
    "event_group": "SELECT DISTINCT lower(o_orderpriority) AS slug, o_orderpriority AS title, CAST(length(o_orderpriority) AS DOUBLE) AS sort_key FROM {orders} UNION ALL SELECT 'in-progress', 'In progress', CAST(NULL AS DOUBLE)",
    "year": f"SELECT DISTINCT {_YEAR} AS year, CAST({_YEAR} AS STRING) || ' AD' AS formatted_year FROM {{orders}} UNION ALL SELECT 1900, '1900 AD'",
    "people_group": "SELECT n_name AS name FROM {nation}",
    "event_participant": "SELECT DISTINCT l_orderkey AS event_id, 'supplier-' || CAST(l_suppkey AS STRING) AS person FROM {lineitem}",
    "event_place": "SELECT o_orderkey AS event_id, 'place-' || CAST(c_nationkey AS STRING) AS place FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "event_verse": "SELECT DISTINCT l_orderkey AS event_id, l_orderkey + l_linenumber - 1 AS verse_id FROM {lineitem}",
    "event_year": f"SELECT o_orderkey AS event_id, {_YEAR} AS year FROM {{orders}}",
    "event_in_group": f"SELECT event_id, event_group FROM ({_GROUPED})",
    "group_year": f"SELECT DISTINCT event_group, year FROM ({_GROUPED}) UNION ALL SELECT 'in-progress', 1900",
    "mentions_person": "SELECT DISTINCT 'supplier-' || CAST(l_suppkey AS STRING) AS person, l_orderkey AS verse_id FROM {lineitem}",
    "mentions_place": "SELECT 'place-' || CAST(c_nationkey AS STRING) AS place, o_orderkey AS verse_id FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "parent_of": f"SELECT 'supplier-' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS STRING) AS parent, 'supplier-' || {_K} AS child FROM {{supplier}} WHERE s_suppkey > 1 UNION ALL SELECT 'supplier-' || CAST(s_suppkey - 1 AS STRING), 'supplier-' || {_K} FROM {{supplier}} WHERE s_suppkey % 3 = 0 AND s_suppkey > 2",
    "partner_of": f"SELECT 'supplier-' || {_K} AS a, 'supplier-' || CAST(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey + 1 ELSE s_suppkey - 1 END AS STRING) AS b FROM {{supplier}}",
    "member_of": f"SELECT 'supplier-' || {_K} AS person, n_name AS people_group FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey",
    "writes": f"SELECT 'supplier-' || {_K} AS person, lower(chr(65 + s_nationkey)) || '-book' AS book FROM {{supplier}} UNION ALL SELECT 'supplier-' || {_K}, lower(chr(65 + (s_nationkey + 1) % 25)) || '-book' FROM {{supplier}} WHERE s_suppkey % 5 = 0",
    "born_in_year": f"SELECT 'supplier-' || {_K} AS person, CAST(1994 + s_suppkey % 7 AS INT) AS year FROM {{supplier}} WHERE s_suppkey % 4 <> 0",
    "died_in_year": f"SELECT 'supplier-' || {_K} AS person, CAST(1996 + s_suppkey % 6 AS INT) AS year FROM {{supplier}} WHERE s_suppkey % 4 <> 1",
    "born_at": f"SELECT 'supplier-' || {_K} AS person, 'place-' || CAST(s_nationkey AS STRING) AS place FROM {{supplier}} WHERE s_suppkey % 3 <> 0",
    "died_at": f"SELECT 'supplier-' || {_K} AS person, 'place-' || CAST((s_nationkey + 1) % 25 AS STRING) AS place FROM {{supplier}} WHERE s_suppkey % 3 <> 1",
    "has_been_here": "SELECT DISTINCT 'place-' || CAST(c_nationkey AS STRING) AS place, 'supplier-' || CAST(l_suppkey AS STRING) AS person FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
}

#: Tables whose rows are dealt by their join's key into partitions that grow in number with the lines, before they are made distinct or joined;
#: the verses of events by verse, which is what they meet first.
_DEALT = ("verse", "event_participant", "event_place", "event_verse", "mentions_person", "mentions_place", "has_been_here")
_SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


def graph(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The graph's tables, with the types of its schema, read lazily."""
    sources = {t: read(spark, d, t) for t in _SOURCES}
    n = parts(sources["lineitem"].select("l_orderkey", "l_suppkey"))
    dealt = {t: sources[t].repartition(n, key) for t, key in (("lineitem", "l_orderkey"), ("customer", "c_custkey"))}
    dealt_for = {"event_verse": {"lineitem": sources["lineitem"].repartition(n, F.expr("l_orderkey + l_linenumber - 1"))}}
    of = lambda name: sources | (dealt if name in _DEALT else {}) | dealt_for.get(name, {})
    return {name: spark.sql(TABLES[name], **{t: df for t, df in of(name).items() if f"{{{t}}}" in TABLES[name]}).to(spark.createDataFrame([], schema).schema) for name, schema in GRAPH.items()}


def with_graph(*names: str) -> str:
    """The same tables as common table expressions of DuckDB: WITH g_person AS (...), ..."""
    sources = {t: t for t in _SOURCES}
    return "WITH " + ", ".join(f"g_{n} AS ({TABLES[n].format(**sources)})" for n in names)
