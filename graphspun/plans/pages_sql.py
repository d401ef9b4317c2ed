"""SQL for DuckDB that gives the rows of the page queries, over the same stand-in graph."""

from __future__ import annotations

from graphspun.plans.standin import with_graph

_CHAPTER = "CASE WHEN split_part(f, '.', 2) <> split_part(l, '.', 2) THEN split_part(l, '.', 2) || ':' ELSE '' END"
_ENDS = "ends AS (SELECT event_id, arg_min(title, verse_id) AS ft, arg_min(osis_ref, verse_id) AS f, arg_max(osis_ref, verse_id) AS l FROM g_event_verse JOIN g_verse USING (verse_id) GROUP BY event_id)"
_PLACES = "places AS (SELECT event_id, string_agg(name, ', ' ORDER BY name, slug) AS place_names FROM g_event_place JOIN g_place ON slug = place GROUP BY event_id)"
_GROUPS = "groups_ AS (SELECT event_id, min(title) AS group_title FROM g_event_in_group JOIN g_event_group ON slug = event_group GROUP BY event_id)"
_WHO = "who AS (SELECT event_id, person, name FROM g_event_participant JOIN g_person ON slug = person)"
_ALL_WHO = "all_who AS (SELECT event_id, string_agg(name, ', ' ORDER BY name, person) AS people_names FROM who GROUP BY event_id)"
_FIRST_YEAR = "first_year AS (SELECT event_id, arg_min(formatted_year, year) AS year_group FROM g_event_year JOIN g_year USING (year) GROUP BY event_id)"


def _relation(name: str, edge: str, of: str, to: str, most: str = "") -> str:
    rows = f"SELECT DISTINCT {of} AS x, {to} AS y, name FROM {edge} JOIN g_person ON slug = {to}"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY x ORDER BY name, y) AS k FROM ({rows})"
    return f"{name} AS (SELECT x, string_agg(name, ', ' ORDER BY k) AS {name} FROM ({ranked}) {most} GROUP BY x)"


_PERSON = ", ".join(
    [
        with_graph("person", "place", "year", "book", "writes", "parent_of", "partner_of", "member_of", "born_in_year", "died_in_year", "born_at", "died_at", "event_participant"),
        _relation("parents", "g_parent_of", "child", "parent"),
        _relation("first_parents", "g_parent_of", "child", "parent", "WHERE k <= 2"),
        _relation("children", "g_parent_of", "parent", "child"),
        _relation("partners", "g_partner_of", "a", "b"),
        "groups_ AS (SELECT person, string_agg(people_group, ', ' ORDER BY people_group) AS groups_list FROM g_member_of GROUP BY person)",
        "writers AS (SELECT book, string_agg(name, ', ' ORDER BY name, slug) AS names FROM g_writes JOIN g_person ON slug = person GROUP BY book)",
        "books AS (SELECT person, string_agg(title || ' (' || names || ')', '; ' ORDER BY book_order, slug) AS books FROM g_writes w JOIN g_book b ON b.slug = w.book JOIN writers USING (book) GROUP BY person)",
        *[f"{w} AS (SELECT slug, (SELECT formatted_year FROM g_{e}_in_year e JOIN g_year USING (year) WHERE e.person = slug) AS y, (SELECT name FROM g_{e}_at e JOIN g_place p ON p.slug = place WHERE e.person = g_person.slug) AS p FROM g_person)" for w, e in (("birth", "born"), ("death", "died"))],
        "n AS (SELECT person, count(*) AS n FROM g_event_participant GROUP BY person)",
    ]
)
_PERSON_FROM = """FROM g_person LEFT JOIN parents ON parents.x = g_person.slug LEFT JOIN first_parents ON first_parents.x = g_person.slug LEFT JOIN children ON children.x = g_person.slug LEFT JOIN partners ON partners.x = g_person.slug
    LEFT JOIN groups_ ON groups_.person = g_person.slug LEFT JOIN books ON books.person = g_person.slug LEFT JOIN birth ON birth.slug = g_person.slug LEFT JOIN death ON death.slug = g_person.slug LEFT JOIN n ON n.person = g_person.slug"""
_WHEN = "CASE WHEN coalesce({w}.p, {w}.y) IS NOT NULL THEN concat_ws(' ', {w}.p, {w}.y) END"

SQL = {
    "person_page": f"""{_PERSON}
        SELECT g_person.slug, name, coalesce(array_to_string(also_called, ', '), '') AS aliases, gender, coalesce(parents, '') AS parents, coalesce(first_parents, '') AS first_parents, coalesce(children, '') AS children, coalesce(partners, '') AS partners,
               coalesce(groups_list, '') AS groups, coalesce(books, '') AS books, {_WHEN.format(w="birth")} AS birth, {_WHEN.format(w="death")} AS death, coalesce(n, 0) AS n_events {_PERSON_FROM}""",
    "person_sections": f"""{_PERSON}
        SELECT g_person.slug, concat_ws(',', CASE WHEN parents <> '' THEN 'parents' END, CASE WHEN children <> '' THEN 'children' END, CASE WHEN partners <> '' THEN 'partners' END, CASE WHEN groups_list <> '' THEN 'groups' END, CASE WHEN books <> '' THEN 'books' END,
               CASE WHEN n > 0 THEN 'timeline' END, CASE WHEN coalesce(birth.p, birth.y) IS NOT NULL THEN 'birth' END, CASE WHEN coalesce(death.p, death.y) IS NOT NULL THEN 'death' END) AS sections {_PERSON_FROM}""",
    "person_page_timeline": f"""{with_graph("person", "place", "year", "verse", "event", "event_group", "event_participant", "event_place", "event_verse", "event_year", "event_in_group")}, {_ENDS}, {_PLACES}, {_GROUPS}, {_WHO}, {_FIRST_YEAR},
        others AS (SELECT a.event_id, a.person, string_agg(b.name, ', ' ORDER BY b.name, b.person) AS people_names FROM who a JOIN who b ON a.event_id = b.event_id AND a.person <> b.person GROUP BY a.event_id, a.person)
        SELECT w.person AS slug, row_number() OVER (PARTITION BY w.person ORDER BY sort_key, event_id) AS pos, event_id, title, year_group, ft || '-' || {_CHAPTER} || split_part(l, '.', 3) AS passage, lower(split_part(f, '.', 1)) || '#' || f AS passage_link,
               coalesce(place_names, '') AS place_names, coalesce(people_names, '') AS people_names, group_title
        FROM who w JOIN g_event USING (event_id) LEFT JOIN ends USING (event_id) LEFT JOIN places USING (event_id) LEFT JOIN groups_ USING (event_id) LEFT JOIN first_year USING (event_id) LEFT JOIN others o USING (event_id, person)""",
    "place_page": f"""{with_graph("place", "person", "verse", "event", "mentions_place", "has_been_here", "event_place")},
        v AS (SELECT place, count(*) AS n, min(name) AS first FROM g_has_been_here JOIN g_person ON slug = person GROUP BY place),
        m AS (SELECT place, count(*) AS n, arg_max(osis_ref, verse_id) AS last FROM g_mentions_place JOIN g_verse USING (verse_id) GROUP BY place),
        e AS (SELECT place, count(*) AS n, arg_max(event_id, (sort_key, event_id)) AS last FROM g_event_place JOIN g_event USING (event_id) GROUP BY place)
        SELECT slug, name, CAST(CASE WHEN feature_type IN ('Region', 'Water') THEN 4 WHEN feature_type = 'Island' THEN 5 ELSE 7.5 END AS DOUBLE) AS zoom, coalesce(v.n, 0) AS n_visitors, v.first AS first_visitor, coalesce(m.n, 0) AS n_verses, m.last AS last_verse, coalesce(e.n, 0) AS n_events, e.last AS last_event
        FROM g_place LEFT JOIN v ON v.place = slug LEFT JOIN m ON m.place = slug LEFT JOIN e ON e.place = slug""",
    "place_page_timeline": f"""{with_graph("person", "place", "year", "verse", "event", "event_group", "event_participant", "event_place", "event_verse", "event_year", "event_in_group")}, {_ENDS}, {_GROUPS}, {_WHO}, {_ALL_WHO}, {_FIRST_YEAR}
        SELECT place AS slug, row_number() OVER (PARTITION BY place ORDER BY sort_key, event_id) AS pos, event_id, year_group, ft || '-' || {_CHAPTER} || split_part(l, '.', 3) AS passage, coalesce(people_names, '') AS people_names, group_title
        FROM g_event_place JOIN g_event USING (event_id) LEFT JOIN ends USING (event_id) LEFT JOIN groups_ USING (event_id) LEFT JOIN all_who USING (event_id) LEFT JOIN first_year USING (event_id)""",
    "period_page": f"""{with_graph("person", "place", "year", "verse", "event", "event_group", "event_participant", "event_place", "event_verse", "event_year", "event_in_group", "group_year")}, {_ENDS}, {_PLACES}, {_WHO}, {_ALL_WHO},
        rows_ AS (SELECT m.event_group, y.year, event_id, sequence, row_number() OVER (PARTITION BY m.event_group, y.year ORDER BY sequence, event_id) AS pos FROM g_event_in_group m JOIN g_event USING (event_id) JOIN g_event_year y USING (event_id))
        SELECT slug, formatted_year, r.pos, r.event_id, r.sequence, CASE WHEN r.event_id IS NOT NULL THEN ft || '-' || split_part(l, '.', 3) END AS passage, CASE WHEN r.event_id IS NOT NULL THEN coalesce(people_names, '') END AS people_names, CASE WHEN r.event_id IS NOT NULL THEN coalesce(place_names, '') END AS place_names
        FROM g_event_group LEFT JOIN (SELECT * FROM g_group_year JOIN g_year USING (year)) gy ON gy.event_group = slug LEFT JOIN rows_ r ON r.event_group = gy.event_group AND r.year = gy.year LEFT JOIN ends ON ends.event_id = r.event_id LEFT JOIN places ON places.event_id = r.event_id LEFT JOIN all_who ON all_who.event_id = r.event_id""",
    "periods_nested": f"""{with_graph("event", "event_group", "event_in_group", "event_year", "year")},
        y AS (SELECT event_id, string_agg(formatted_year, ', ' ORDER BY year) AS years FROM g_event_year JOIN g_year USING (year) GROUP BY event_id),
        r AS (SELECT event_group AS slug, row_number() OVER (PARTITION BY event_group ORDER BY sequence, event_id) AS pos, event_id, coalesce(years, '') AS years FROM g_event_in_group JOIN g_event USING (event_id) LEFT JOIN y USING (event_id))
        SELECT slug, first_value(split_part(years, ', ', 1)) OVER (PARTITION BY slug ORDER BY pos) AS first_year, pos, event_id, years FROM g_event_group LEFT JOIN r USING (slug)""",
    "book_page": f"""{with_graph("book", "chapter", "verse")}
        SELECT slug, c.title AS chapter, CASE WHEN v.verse_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.osis_ref ORDER BY v.verse_id) END AS pos, v.osis_ref AS verse_ref, replace(v.md_text, '**', '') AS text
        FROM g_book LEFT JOIN g_chapter c ON book_slug = slug LEFT JOIN g_verse v ON chapter_ref = c.osis_ref""",
    "browse": f"""{with_graph("book", "person", "place")}, r AS (SELECT 'book' AS kind, title AS name, slug FROM g_book UNION ALL SELECT 'person', name, slug FROM g_person UNION ALL SELECT 'place', name, slug FROM g_place)
        SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, slug) AS pos FROM r""",
    "search_chapter": f"{with_graph('verse')} SELECT verse_id, full_ref, '/t/#' || osis_ref AS link FROM g_verse WHERE full_ref LIKE 'The Book of T 1:%'",
    "search_range": f"{with_graph('verse')} SELECT verse_id, full_ref, '/t/#' || osis_ref AS link FROM g_verse WHERE full_ref LIKE 'The Book of T 1:%' AND verse_num BETWEEN 1 AND 9000",
    "search_aliases": f"""{with_graph("person", "verse", "mentions_person")}, m AS (SELECT person, count(*) AS n, arg_min(full_ref, verse_id) AS r FROM g_mentions_person JOIN g_verse USING (verse_id) GROUP BY person)
        SELECT slug, name, coalesce(n, 0) AS verse_count, coalesce(n, 0) || ' verses.' || coalesce(' First mentioned in ' || r, '') AS card FROM g_person LEFT JOIN m ON person = slug
        WHERE contains(lower(name), 'dealer of 1') OR len(list_filter(also_called, lambda a: contains(lower(a), 'dealer of 1'))) > 0""",
    "search_gate": "SELECT 'er#' AS input, count(*) AS n FROM customer WHERE contains(lower(c_name), 'er#') UNION ALL SELECT 'er', 0",
    "search_address": "SELECT c_custkey, '/?q=' || replace(c_name, '#', '%23') || '+' || c_mktsegment AS address FROM customer",
    "record_merge": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(c_custkey % 7 AS INT) AS page, true AS seen FROM customer",
    "plain_range_label": f"{with_graph('verse', 'event_verse')}, {_ENDS} SELECT event_id, ft || '-' || split_part(l, '.', 3) AS label FROM ends",
    "group_title": f"{with_graph('event', 'event_group', 'event_in_group')}, {_GROUPS} SELECT event_id, title, group_title FROM g_event LEFT JOIN groups_ USING (event_id)",
    "sql_views": f"{with_graph('book', 'writes')} SELECT testament, count(*) AS n_books, count(DISTINCT person) AS n_writers FROM g_book LEFT JOIN g_writes ON book = slug GROUP BY testament",
}
