"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

#: Node and edge tables of the graph.
GRAPH = {
    "testament": "title STRING",
    "book": "slug STRING, title STRING, book_order INT, testament STRING",
    "chapter": "osis_ref STRING, title STRING, chapter_num INT, book_slug STRING",
    "verse": "verse_id BIGINT, osis_ref STRING, full_ref STRING, title STRING, verse_num INT, verse_text STRING, md_text STRING, chapter_ref STRING",
    "person": "slug STRING, name STRING, also_called ARRAY<STRING>, description STRING, gender STRING, status STRING",
    "place": "slug STRING, name STRING, status STRING, description STRING, latitude DOUBLE, longitude DOUBLE, feature_type STRING",
    "event": "event_id BIGINT, title STRING, sequence INT, sort_key DOUBLE",
    "event_group": "slug STRING, title STRING, sort_key DOUBLE",
    "year": "year INT, formatted_year STRING",
    "people_group": "name STRING",
    "event_participant": "event_id BIGINT, person STRING",
    "event_place": "event_id BIGINT, place STRING",
    "event_verse": "event_id BIGINT, verse_id BIGINT",
    "event_year": "event_id BIGINT, year INT",
    "event_in_group": "event_id BIGINT, event_group STRING",
    "group_year": "event_group STRING, year INT",
    "mentions_person": "person STRING, verse_id BIGINT",
    "mentions_place": "place STRING, verse_id BIGINT",
    "parent_of": "parent STRING, child STRING",
    "partner_of": "a STRING, b STRING",
    "member_of": "person STRING, people_group STRING",
    "writes": "person STRING, book STRING",
    "born_in_year": "person STRING, year INT",
    "died_in_year": "person STRING, year INT",
    "born_at": "person STRING, place STRING",
    "died_at": "person STRING, place STRING",
    "has_been_here": "place STRING, person STRING",
}

#: The node tables that have pages, with the key that must be unique.
KEYS = {"book": "slug", "person": "slug", "place": "slug", "event_group": "slug"}

#: The driver's tables.
DRIVER = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}
