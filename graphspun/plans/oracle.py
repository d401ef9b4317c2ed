"""SQL for DuckDB that gives the rows of the registered queries, over the same tables."""

from __future__ import annotations

from graphspun.plans.pages_sql import SQL as PAGES

_EDGES = "edges AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)"
_EVENTS = "events AS (SELECT o_orderkey AS event, o_custkey AS cust, o_orderpriority AS period, o_orderdate AS sort_key, year(o_orderdate) AS year FROM orders)"
_VERSES = """verses AS (
    SELECT DISTINCT l_orderkey, l_linenumber AS verse_id,
           'Ord' || (l_orderkey % 7) || '.' || (l_linenumber // 3 + 1) || '.' || l_linenumber AS osis_ref,
           'Ord ' || (l_linenumber // 3 + 1) || ':' || l_linenumber AS title
    FROM lineitem)"""
_ENDS = """ends AS (
    SELECT l_orderkey, arg_min(osis_ref, verse_id) AS f, arg_max(osis_ref, verse_id) AS l, arg_min(title, verse_id) AS ft, arg_max(title, verse_id) AS lt, max(verse_id) AS lv
    FROM verses GROUP BY l_orderkey)"""
_RANGE = "ft || '-' || CASE WHEN split_part(f, '.', 2) <> split_part(l, '.', 2) THEN split_part(l, '.', 2) || ':' ELSE '' END || split_part(l, '.', 3)"
_PEOPLE = "people AS (SELECT l_orderkey, l_suppkey, s_name AS name FROM edges JOIN supplier ON s_suppkey = l_suppkey)"


def _page(offset: int) -> str:
    return f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE contains(lower(text), 'the and') ORDER BY doc_id LIMIT 10 OFFSET {offset}"


def _runs(source: str, group: str, order: str) -> str:
    """Runs of (group, chapter, number) in `order`."""
    return f"""
        marked AS (SELECT *, CASE WHEN chapter = lag(chapter) OVER w AND number = lag(number) OVER w + 1 THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY {order})),
        numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM marked),
        runs AS (SELECT {group}, CAST(run AS BIGINT) AS run, min(chapter) AS chapter, min(number) AS first, max(number) AS last, count(*) AS n,
                        min(chapter) || ':' || min(number) || CASE WHEN count(*) > 1 THEN '-' || max(number) ELSE '' END AS label
                 FROM numbered GROUP BY {group}, run)"""


_MANIFEST = """
    SELECT kind, lookup_name, CASE kind WHEN 'book' THEN '' ELSE kind || '/' END || lookup_name AS path FROM (
        SELECT 'book' AS kind, lower(n_name) || '-' || n_nationkey AS lookup_name FROM nation
        UNION ALL SELECT 'place', lower(r_name) || '-' || r_regionkey FROM region
        UNION ALL SELECT 'person', 'supplier-' || s_suppkey FROM supplier
        UNION ALL SELECT DISTINCT 'period', lower(o_orderpriority) FROM orders)"""

SQL = {
    "site_title": "SELECT 'Graph pages' AS title",
    "slug_scan": "SELECT 'supplier-' || s_suppkey AS slug FROM supplier",
    "page_manifest": _MANIFEST,
    "sitemap": f"SELECT 'https://site.example/' || path AS loc FROM ({_MANIFEST})",
    "markdown_text": r"""
        WITH t AS (SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'Lives in **' || c_mktsegment || '**, see [page ' || c_custkey || '](/person/' || c_custkey || ').' || chr(10) || '- *one*' || chr(10) || '- `two`' AS x FROM customer),
             a AS (SELECT c_custkey, regexp_replace(x, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS x FROM t),
             b AS (SELECT c_custkey, regexp_replace(x, '(?m)^[ ]{0,3}(#{1,6}|>|[-*+]|[0-9]+\.)[ ]+', '', 'g') AS x FROM a),
             c AS (SELECT c_custkey, regexp_replace(x, '(\*\*|__|\*|`)([^*`\n]+?)(\*\*|__|\*|`)', '\2', 'g') AS x FROM b)
        SELECT c_custkey, regexp_replace(x, '\n{2,}', chr(10), 'g') AS plain FROM c""",
    "index_sorted": "SELECT c_name AS name, c_custkey AS key, c_mktsegment AS status, row_number() OVER (ORDER BY c_name NULLS LAST, c_custkey) AS pos FROM customer",
    "index_desc": "SELECT r_name AS title, r_regionkey AS key, row_number() OVER (ORDER BY r_name DESC NULLS LAST, r_regionkey) AS pos FROM region",
    "books_by_testament": "SELECT r_name, CASE WHEN n_nationkey IS NOT NULL THEN row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) END AS pos, n_nationkey, n_name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey",
    "book_text_nested": """
        WITH v AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey || o_orderstatus, ' ' ORDER BY o_orderkey) AS verses FROM orders GROUP BY o_custkey)
        SELECT n_name, row_number() OVER (ORDER BY c_custkey) AS pos, c_name AS chapter, coalesce(n, 0) AS n_verses, coalesce(verses, '') AS verses
        FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN v ON o_custkey = c_custkey WHERE n_nationkey = 3""",
    "period_overview": f"""
        WITH {_EVENTS} SELECT period, arg_min(event, (sort_key, event)) AS first_event, arg_min(year, (sort_key, event)) AS first_year, count(*) AS n_events,
               string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM events GROUP BY period""",
    "lookup_by_key": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 42",
    "exclude_self": f"WITH {_EDGES} SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS shared_events FROM edges a JOIN edges b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL",
    "exists_related": "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)",
    "single_related": """
        SELECT o_orderkey, o_orderpriority FROM orders WHERE
            (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 5 AND l_orderkey = o_orderkey) = 1""",
    "period_detail": f"""
        WITH {_EVENTS}, {_EDGES}, {_PEOPLE},
             p AS (SELECT l_orderkey, count(*) AS n, min(name) AS first FROM people GROUP BY l_orderkey),
             cells AS (SELECT DISTINCT period, year FROM events),
             open AS (SELECT * FROM events WHERE event IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
             f AS (SELECT period, year, count(*) AS n_events, sum(n) AS n_people, min(event) AS first_event, min(first) AS first_person FROM open LEFT JOIN p ON l_orderkey = event GROUP BY period, year)
        SELECT period, year, coalesce(n_events, 0) AS n_events, CAST(coalesce(n_people, 0) AS BIGINT) AS n_people, first_event, first_person FROM cells LEFT JOIN f USING (period, year)""",
    "person_timeline": f"""
        WITH {_EVENTS}, {_EDGES}, {_PEOPLE}, {_VERSES}, {_ENDS},
             p AS (SELECT l_orderkey, string_agg(name, ', ' ORDER BY name, l_suppkey) AS people, count(*) AS n FROM people WHERE l_suppkey <> 7 GROUP BY l_orderkey)
        SELECT event, year, {_RANGE} AS passage, coalesce(people, '') AS people, coalesce(n, 0) AS n_people, row_number() OVER (ORDER BY sort_key NULLS LAST, event) AS pos
        FROM events LEFT JOIN ends e ON e.l_orderkey = event LEFT JOIN p ON p.l_orderkey = event
        WHERE event IN (SELECT l_orderkey FROM edges WHERE l_suppkey = 7)""",
    "place_timeline": f"""
        WITH {_EVENTS}, {_EDGES}, {_PEOPLE}, p AS (SELECT l_orderkey, string_agg(name, ', ' ORDER BY name, l_suppkey) AS people FROM people GROUP BY l_orderkey)
        SELECT event, year, coalesce(people, '') AS people, row_number() OVER (ORDER BY sort_key NULLS LAST, event) AS pos
        FROM events LEFT JOIN p ON l_orderkey = event WHERE cust IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""",
    "person_pages": f"""
        WITH {_EVENTS}, {_EDGES},
             e AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT year) AS y, arg_min(event, (sort_key, event)) AS f, arg_max(event, (sort_key, event)) AS l FROM edges JOIN events ON event = l_orderkey GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, coalesce(n, 0) AS n_events, coalesce(y, 0) AS n_years, f AS first_event, l AS last_event FROM supplier LEFT JOIN e ON l_suppkey = s_suppkey""",
    "self_edge": f"""
        WITH {_EDGES}, pairs AS (SELECT DISTINCT a.l_suppkey AS x, b.l_suppkey AS y FROM edges a JOIN edges b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey),
             m AS (SELECT x, string_agg(q.s_name, ', ' ORDER BY y) AS partners, count(*) AS n FROM pairs JOIN supplier p ON p.s_suppkey = x JOIN supplier q ON q.s_suppkey = y AND q.s_nationkey = p.s_nationkey GROUP BY x)
        SELECT s_suppkey, s_name, coalesce(partners, '') AS partners, coalesce(n, 0) AS n_partners FROM supplier LEFT JOIN m ON x = s_suppkey""",
    "cyclic_hop": """
        WITH w AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
        SELECT p_partkey, p_name, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS writers, count(*) AS n_writers
        FROM w JOIN part ON p_partkey = l_partkey WHERE l_partkey IN (SELECT l_partkey FROM w WHERE l_suppkey = 7) GROUP BY p_partkey, p_name""",
    "first_related": f"""
        WITH {_EVENTS}, f AS (SELECT cust, count(*) AS n, arg_min(event, (sort_key, event)) AS e, arg_min(year, (sort_key, event)) AS y FROM events GROUP BY cust)
        SELECT c_custkey, c_name, coalesce(n, 0) AS verse_count, e AS first_event, y AS first_year FROM customer LEFT JOIN f ON cust = c_custkey""",
    "first_two": f"""
        WITH {_EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS k FROM edges),
             p AS (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ', ' ORDER BY l_suppkey) AS parents FROM r WHERE k <= 2 GROUP BY l_orderkey)
        SELECT o_orderkey, coalesce(parents, '') AS parents FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
    "alpha_index": """
        WITH g AS (SELECT upper(substr(p_name, 1, 1)) AS letter, count(*) AS n, arg_min(p_partkey, (p_name, p_partkey)) AS first_key, arg_max(p_partkey, (p_name, p_partkey)) AS last_key, min((p_name, p_partkey)) AS f FROM part GROUP BY 1)
        SELECT letter, row_number() OVER (ORDER BY f) AS pos, n, first_key, last_key FROM g""",
    "year_timeline": f"""
        WITH {_EVENTS}, g AS (SELECT year, row_number() OVER (ORDER BY min((sort_key, event))) AS year_pos FROM events GROUP BY year)
        SELECT year, year_pos, event, row_number() OVER (ORDER BY sort_key NULLS LAST, event) AS pos FROM events JOIN g USING (year)""",
    "first_last": f"WITH {_VERSES}, {_ENDS} SELECT l_orderkey, ft AS first_title, lt AS last_title, lv AS last_verse FROM ends",
    "name_list": f"""
        WITH {_EDGES}, {_PEOPLE}, p AS (SELECT l_orderkey, string_agg(name, ', ' ORDER BY name, l_suppkey) AS names, count(*) AS n FROM people GROUP BY l_orderkey)
        SELECT o_orderkey, coalesce(names, '') AS names, coalesce(n, 0) AS n FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""",
    "verse_islands": f"""
        WITH rows_ AS (SELECT DISTINCT l_orderkey, l_linenumber AS number, CAST(l_linenumber // 4 AS INTEGER) AS chapter FROM lineitem), {_runs("rows_", "l_orderkey", "number")}
        SELECT l_orderkey, run, chapter, first, last, n, label FROM runs""",
    "range_label": f"WITH {_VERSES}, {_ENDS} SELECT l_orderkey, {_RANGE} AS label, lower(split_part(f, '.', 1)) || '#' || f AS link FROM ends",
    "ref_parse_link": """
        WITH r AS (SELECT doc_id, concat_ws('.', lang, source, CAST(n_chars AS VARCHAR)) AS ref FROM documents)
        SELECT doc_id, split_part(ref, '.', 1) AS book, split_part(ref, '.', 2) AS chapter, split_part(ref, '.', 3) AS verse,
               lower(split_part(ref, '.', 1)) || '#' || ref AS link, '/' || lower(split_part(ref, '.', 1)) || '/#' || ref AS absolute_link FROM r""",
    "leading_int": r"""
        WITH t AS (SELECT page_id, url, regexp_extract(url, '([0-9]+[^0-9]*)$', 1) AS tail FROM pages)
        SELECT page_id, tail, TRY_CAST(regexp_extract(tail, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS number, TRY_CAST(regexp_extract(url, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS none FROM t""",
    "case_level": """
        WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Region' WHEN 1 THEN 'Water' WHEN 2 THEN 'Island' WHEN 3 THEN 'City' END AS feature_type FROM part)
        SELECT p_partkey, feature_type, CAST(CASE WHEN feature_type IN ('Region', 'Water') THEN 4 WHEN feature_type = 'Island' THEN 5 ELSE 7.5 END AS DOUBLE) AS zoom FROM t""",
    "status_link": "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '/person/' || o_orderkey END AS link FROM orders",
    "optional_concat": """
        WITH t AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS place, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) END AS year FROM customer)
        SELECT c_custkey, CASE WHEN coalesce(place, year) IS NOT NULL THEN concat_ws(' ', place, year) END AS born FROM t""",
    "search_text_page1": _page(0),
    "search_text_page2": _page(10),
    "search_names": f"""
        WITH {_EVENTS}, f AS (SELECT cust, count(*) AS n, arg_min(event, (sort_key, event)) AS e FROM events GROUP BY cust),
             h AS (SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'mer#00000000') ORDER BY c_name, c_custkey LIMIT 3)
        SELECT c_custkey, c_name, coalesce(n, 0) || ' verses.' || coalesce(' First mentioned in ' || e, '') AS card FROM h LEFT JOIN f ON cust = c_custkey""",
    "search_rest": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') ORDER BY p_name, p_partkey OFFSET 3",
    "search_appended": f"SELECT *, 1 AS page FROM ({_page(0)}) UNION ALL SELECT *, 2 FROM ({_page(10)}) UNION ALL SELECT *, 3 FROM ({_page(15)})",
    "search_flags": """
        WITH p AS (SELECT count(*) AS n FROM (SELECT 1 FROM customer WHERE contains(lower(c_name), 'customer#00000000') LIMIT 3)),
             l AS (SELECT count(*) AS n FROM (SELECT 1 FROM nation WHERE contains(lower(n_name), 'customer#00000000') LIMIT 3)),
             v AS (SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE contains(lower(text), 'customer#00000000') LIMIT 11)),
             t AS (SELECT least(p.n, 2) AS people, least(l.n, 2) AS places, least(v.n, 10) AS verses, p.n > 2 AS more_people FROM p, l, v)
        SELECT people, places, verses, more_people, verses > 0 AS show_verses, people > 0 AS show_people, places > 0 AS show_places, verses > 0 OR people > 0 OR places > 0 AS show_all,
               (verses > 0)::INT + (people > 0)::INT + (places > 0)::INT = 1 AS show_one, NOT (verses > 0 OR people > 0 OR places > 0) AS show_none FROM t""",
    "input_kind": r"""
        WITH t AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' ' || p_size || ':' || p_size WHEN 1 THEN '  2 ' || p_name || ' ' || p_size || ':1-' || p_size || ' ' WHEN 2 THEN p_name || ' ' || p_size WHEN 3 THEN p_name
                          WHEN 4 THEN substr(p_name, 1, 2) WHEN 5 THEN p_size || ':' || p_size WHEN 6 THEN p_name || ' ' || p_size || ' more' ELSE '2 ' || p_name || ' ' || p_size END AS input FROM part)
        SELECT p_partkey, input, CASE p_partkey % 8 WHEN 0 THEN 'reference' WHEN 1 THEN 'reference' WHEN 2 THEN 'chapter' WHEN 7 THEN 'chapter' ELSE CASE WHEN length(input) < 3 THEN 'short' ELSE 'phrase' END END AS kind FROM t""",
    "url_query": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' no' || c_custkey ELSE '' END AS q FROM customer",
    "verses_by_book": f"""
        WITH rows_ AS (SELECT DISTINCT CAST(l_orderkey % 5 AS INTEGER) AS book, CAST(l_orderkey // 5 AS INTEGER) AS chapter, l_linenumber AS number FROM lineitem), {_runs("rows_", "book", "chapter, number")}
        SELECT book, dense_rank() OVER (ORDER BY book) AS pos, chapter, first, last, n, label FROM runs""",
} | PAGES
