"""Page documents, search and operators on hand-made graph rows."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphspun.functions import columns as C
from graphspun.operators import nested, ordering, runs
from graphspun.operators import search as S
from graphspun.plans import documents as D
from graphspun.sources import tables
from graphspun.sources.schemas import GRAPH

ROWS = {
    "testament": [("Old",), ("New",), ("Empty",)],
    "book": [("gen", "Genesis", 1, "Old"), ("exod", "Exodus", 2, "Old"), ("matt", "Matthew", 40, "New"), ("none", "No order", None, "New")],
    "chapter": [("Gen.1", "Genesis 1", 1, "gen"), ("Gen.2", "Genesis 2", 2, "gen"), ("Matt.1", "Matthew 1", 1, "matt")],
    "verse": [(1, "Gen.1.1", "Genesis 1:1", "Gen 1:1", 1, "In the beginning", "*In*", "Gen.1"), (2, "Gen.1.2", "Genesis 1:2", "Gen 1:2", 2, "And the earth", "And", "Gen.1"), (3, "Gen.2.1", "Genesis 2:1", "Gen 2:1", 1, "Thus THE heavens", "Thus", "Gen.2"), (4, "Matt.1.5", "Matthew 1:5", "Matt 1:5", 5, None, None, "Matt.1")],
    "person": [("adam", "Adam", ["First", "Ädam"], "d", "Male", None), ("eve", "Eve", None, None, "Female", "wip"), ("cain", "Cain", [], None, "Male", "done"), ("abel", "abel", None, None, "Male", None), ("adam2", "Adam", None, None, "Male", None), ("oe", "ägid", None, None, None, None), ("x1", "7th", None, None, None, None)],
    "place": [("eden", "Eden", None, None, 1.0, 2.0, "Region"), ("sea", "Sea", "wip", None, None, None, "Water"), ("isle", "Isle", None, None, None, None, "Island"), ("town", "Town", None, None, None, None, None), ("city", "City", None, None, None, None, "City")],
    "event": [(10, "Created", 1, 1.0), (11, "Fall", 2, 2.0), (12, "Murder", 3, 2.0), (13, "Nothing", None, None), (14, "Twice", 4, 4.0)],
    "event_group": [("begin", "Beginning", 1.0), ("later", "Later", 2.0), ("void", "Void", None)],
    "year": [(-4004, "4004 BC"), (-3900, "3900 BC"), (30, "30 AD")],
    "people_group": [("Firsts",), ("Brothers",)],
    "event_participant": [(10, "adam"), (11, "adam"), (11, "eve"), (11, "eve"), (12, "cain"), (12, "abel"), (14, "adam"), (14, "ghost")],
    "event_place": [(10, "eden"), (11, "eden"), (12, "town"), (12, "city")],
    "event_verse": [(10, 1), (10, 2), (11, 2), (11, 3), (12, 1), (12, 4)],
    "event_year": [(10, -4004), (11, -4004), (11, -3900), (12, -3900), (14, -4004)],
    "event_in_group": [(10, "begin"), (11, "begin"), (12, "later"), (14, "begin"), (14, "later")],
    "group_year": [("begin", -4004), ("begin", 30), ("later", -3900)],
    "mentions_person": [("adam", 2), ("adam", 1), ("adam", 1), ("eve", 3)],
    "mentions_place": [("eden", 3), ("eden", 1)],
    "parent_of": [("adam", "cain"), ("eve", "cain"), ("ghost", "cain"), ("adam2", "cain"), ("adam", "abel"), ("eve", "abel"), ("adam", "eve")],
    "partner_of": [("adam", "eve"), ("eve", "adam")],
    "member_of": [("cain", "Brothers"), ("cain", "Firsts")],
    "writes": [("adam", "gen"), ("eve", "gen"), ("adam", "exod")],
    "born_in_year": [("cain", -3900)],
    "died_in_year": [("abel", -3900)],
    "born_at": [("cain", "eden"), ("eve", "eden")],
    "died_at": [("abel", "town")],
    "has_been_here": [("eden", "adam"), ("eden", "eve")],
}


@pytest.fixture(scope="module")
def g(spark):
    return {name: spark.createDataFrame(ROWS[name], schema).cache() for name, schema in GRAPH.items()}


def by(df, key="slug"):
    return {r[key]: r for r in df.collect()}


def test_manifest(g):
    rows = {(r.kind, r.path) for r in D.manifest(g).collect()}
    assert len(rows) == 4 + 5 + 7 + 3
    assert {("book", "gen"), ("place", "place/sea"), ("person", "person/eve"), ("period", "period/void")} <= rows


def test_books(g):
    found = [(r.title, [b.slug for b in r.books]) for r in D.books_index(g).collect()]
    assert found == [("Old", ["gen", "exod"]), ("New", ["matt", "none"]), ("Empty", [])]
    page = D.book_pages(g, "gen").first()
    assert [(c.chapter_title, [v.verse_ref for v in c.verses]) for c in page.chapters] == [("Genesis 1", ["Gen.1.1", "Gen.1.2"]), ("Genesis 2", ["Gen.2.1"])]
    assert D.book_pages(g, "exod").first().chapters == [] and D.book_pages(g).count() == 4
    assert set(D.browse(g)) == {"testaments", "person", "place"}


def test_name_index(g):
    found = [(r.letter, [x.slug for x in r.rows]) for r in D.name_index(g, "person").orderBy("pos").collect()]
    assert found == [("7", ["x1"]), ("A", ["adam", "adam2", "abel"]), ("C", ["cain"]), ("E", ["eve"]), ("Ä", ["oe"])]
    links = {x.slug: x.link for r in D.name_index(g, "person").collect() for x in r.rows}
    assert links["eve"] is None and links["adam"] == "/person/adam" and links["cain"] == "/person/cain"


def test_periods(g):
    found = [(r.slug, r.first_year, [e.id for e in r.events]) for r in D.periods_index(g).collect()]
    assert found == [("begin", "4004 BC", [10, 11, 14]), ("later", "3900 BC", [12, 14]), ("void", None, [])]
    page = D.period_pages(g, "begin").first()
    # 14 is in two groups and shown in both; year 30 has no event and stays; events stand in sequence
    assert [(y.formatted_year, [e.event_id for e in y.events]) for y in page.years] == [("4004 BC", [10, 11, 14]), ("30 AD", [])]
    assert page.years[0].events[1].people_names == "Adam, Eve" and page.years[0].events[0].place_names == "Eden"
    pages = by(D.period_pages(g))
    assert pages["void"].years == [] and [[e.event_id for e in y.events] for y in pages["later"].years] == [[12]] and pages["begin"].years == page.years
    again = D.period_pages(g | {"event_in_group": g["event_in_group"].union(g["event_in_group"])}, "begin").first()
    assert again.years == page.years  # an edge that is there twice counts once
    reverse = g["event"].withColumn("sequence", -F.col("sequence"))
    assert [e.event_id for e in D.period_pages(g | {"event": reverse}, "begin").first().years[0].events] == [14, 11, 10]


def test_person_page_and_timeline(g):
    adam = D.person_pages(g, "adam").first()
    assert adam.aliases == "First, Ädam" and [c.slug for c in adam.children] == ["cain", "eve", "abel"]
    assert [(b.title, [w.name for w in b.writers]) for b in adam.books] == [("Genesis", ["Adam", "Eve"]), ("Exodus", ["Adam"])]
    assert [(e.event_id, e.year_group, e.people_names, e.passage) for e in adam.timeline] == [(10, "4004 BC", "", "Gen 1:1-2"), (11, "4004 BC", "Eve", "Gen 1:2-2:1"), (14, "4004 BC", "", None)]
    assert adam.timeline[0].passage_link == "gen#Gen.1.1" and adam.timeline[2].group_title == "Beginning"
    pages = by(D.person_pages(g))
    cain = pages["cain"]
    assert [p.slug for p in cain.parents] == ["adam", "adam2", "eve"] and [p.slug for p in cain.first_parents] == ["adam", "adam2"]
    assert [x.people_group for x in cain.groups] == ["Brothers", "Firsts"] and cain.birth == "Eden 3900 BC" and cain.death is None
    assert pages["abel"].death == "Town 3900 BC" and pages["eve"].birth == "Eden"
    assert cain.timeline[0].passage == "Gen 1:1-5"  # two books, one chapter number: the label drops the second book
    assert pages["x1"].timeline == [] and pages["x1"].children == [] and pages["x1"].aliases == "" and len(pages) == 7


def test_place_page(g):
    pages = by(D.place_pages(g))
    assert {k: p.zoom for k, p in pages.items()} == {"eden": 4.0, "sea": 4.0, "isle": 5.0, "town": 7.5, "city": 7.5}
    assert [v.id for v in pages["eden"].verses] == [1, 3] and [v.other for v in pages["eden"].visitors] == ["adam", "eve"]
    assert [(e.event_id, e.people_names) for e in pages["eden"].timeline] == [(10, "Adam"), (11, "Adam, Eve")]
    assert D.place_pages(g, "sea").first().timeline == []


def test_search(g):
    found = D.search(g, "adam")
    assert [(r.slug, r.card) for r in found["people"].collect()] == [("adam", "2 verses. First mentioned in Genesis 1:1"), ("adam2", "0 verses.")]
    assert [r.slug for r in D.search(g, "ädam")["people"].collect()] == ["adam"]  # by an alias
    assert [r.verse_id for r in D.search(g, "the ")["verses"].collect()] == [1, 2, 3]
    assert [r.verse_id for r in D.search(g, "the ", verses=1, offset=1)["verses"].collect()] == [2]
    assert [r.verse_id for r in D.search(g, "genesis  1")["verses"].collect()] == [1, 2]
    assert [(r.verse_id, r.link) for r in D.search(g, "Genesis 2:1")["verses"].collect()] == [(3, "/gen/#Gen.2.1")]
    assert [r.verse_id for r in D.search(g, "Genesis 1:2-9")["verses"].collect()] == [2]
    assert [r.verse_id for r in D.search(g, " genesis 1 : 1 – 2 ")["verses"].collect()] == [1, 2]
    assert D.search(g, "Genesis 7:1")["verses"].count() == 0
    dated = g | {"verse": g["verse"].withColumn("verse_text", F.concat_ws(" ", "verse_text", F.lit("in year 7")))}
    assert D.search(dated, "in year 7")["verses"].count() == 4  # looks like a chapter, but no book is called so: a phrase
    assert all(df.count() == 0 for df in D.search(g, "ad").values())
    assert D.search(g, "a%_", people=-1)["people"].count() == 0  # literal, no wildcard
    assert [r.slug for r in S.search_names(g["person"], "ada", "name", "slug", -1, 1).collect()] == ["adam2"]


def test_appended_pages_keep_doubles(g):
    order = [F.col("verse_id").asc()]
    found = S.appended([ordering.page(g["verse"], order, 2), ordering.page(g["verse"], order, 2, 1), ordering.page(g["verse"], order, -1, 3)])
    assert [(r.page, r.verse_id) for r in found.orderBy("page", "verse_id").collect()] == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 4)]


def test_predicates(g):
    assert [r.slug for r in nested.some(g["place"], "slug", g["event_place"], "place").orderBy("slug").collect()] == ["city", "eden", "town"]
    assert [r.event_id for r in nested.single(g["event"], "event_id", g["event_participant"], "event_id", "person").collect()] == [10]
    assert {(r.event_id, r.person, r.other) for r in nested.others(g["event_participant"], "person", "event_id").collect()} == {(11, "adam", "eve"), (11, "eve", "adam"), (12, "cain", "abel"), (12, "abel", "cain"), (14, "adam", "ghost"), (14, "ghost", "adam")}
    assert nested.others(g["event_participant"], "person", "event_id").columns == ["person", "event_id", "other"]


def test_others_by_two_columns_and_narrow_lists(g, spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "x"), (2, "b", None)], "e int, p string, n string")
    assert {(r.e, r.p, r.other) for r in nested.others(df, "p", "e", "n").collect()} == {(1, "a", "b"), (1, "b", "a")}
    few = g["event"].where("event_id in (10, 13)")
    lists = [nested.expand(few, "event_id", g["event_verse"], "event_id", ["verse_id"], ["verse_id"], "v", narrow=n).orderBy("event_id").collect() for n in (False, True)]
    assert lists[0] == lists[1] and [len(r.v) for r in lists[1]] == [2, 0]


def test_input_kinds(spark):
    kinds = {"Ruth 2:4": "reference", "3 John 1:2": "reference", "Song of Songs 2:1-3": "reference", "Ps. 23:1 – 4": "reference", "Acts of the Few 13": "chapter", "2 Sam 1": "chapter", "Nineveh": "phrase", "the end": "phrase", "7:7": "phrase", "7 7": "phrase", "go": "short", "": "short", "Ruth 2:": "phrase", "Ruth 2:4-": "phrase"}
    found = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", C.input_kind(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in found} == kinds


def test_shown_and_merged(spark):
    df = spark.createDataFrame([(1, [2], ("a", 1)), (2, [], ("b", 1)), (3, None, None)], "i int, l array<int>, r struct<x: string, y: int>")
    found = df.select("i", C.shown_if(F.col("l"), F.lit("list")).alias("s"), C.merged(F.col("r"), y=F.lit(5), z=F.col("i")).alias("m")).orderBy("i").collect()
    assert [r.s for r in found] == ["list", None, None] and [tuple(r.m) if r.m else None for r in found] == [("a", 5, 1), ("b", 5, 2), None]


def test_load_check(spark, tmp_path):
    for name, schema in GRAPH.items():
        spark.createDataFrame(ROWS[name] + ([("gen", "Again", 9, "Old")] if name == "book" else []), schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    with pytest.raises(ValueError, match="gen"):
        tables.read_graph(spark, str(tmp_path))
    graph = tables.read_graph(spark, str(tmp_path), check=False)
    tables.register(graph)
    assert spark.sql("SELECT count(*) FROM verse").first()[0] == 4
    assert sum("title STRING" in s for s in GRAPH.values()) > 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 6)), max_size=20))
def test_islands_expand_to_the_input(spark, verses):
    rows = [(1, i, c, v) for i, (c, v) in enumerate(verses)]
    df = spark.createDataFrame(rows, "book int, pos int, chapter int, number int")
    found = runs.islands(df, ["book"], "chapter", "number", "pos").orderBy("run").collect()
    back = [(r.chapter, v) for r in found for v in range(r.first, r.last + 1)]
    assert back == list(verses) and all(r.n == r.last - r.first + 1 for r in found)
    for a, b in zip(found, found[1:]):
        assert not (a.chapter == b.chapter and b.first == a.last + 1)  # no run could be longer


def test_chapter_islands_are_those_of_whole_groups(spark):
    rows = sorted({(i * i % 3, i * 7 % 11, i * i % 13) for i in range(200)} | {(0, None, 4), (0, None, 5), (2, 1, None)}, key=str)
    df = spark.createDataFrame(rows, "book int, chapter int, number int")
    whole = runs.islands(df.withColumn("pos", F.struct("chapter", "number")), ["book"], "chapter", "number", "pos")
    columns = ["book", "chapter", "first", "last", "n"]
    found = runs.chapter_islands(df, ["book"], "chapter", "number")
    assert sorted(found.select(columns).collect(), key=str) == sorted(whole.select(columns).collect(), key=str)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 60)), max_size=60), st.booleans())
def test_positions(spark, values, descending):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that few rows lie in several ranges, too
    found = ordering.numbered(df, "v", ["i"], descending, small=0).orderBy("pos").collect()
    assert ordering.numbered(df, "v", ["i"], descending, small=1 << 40).orderBy("pos").collect() == found
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.pos for r in found] == list(range(1, len(values) + 1))
    assert [(r.v, r.i) for r in found] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is None, (-x[0] if descending else x[0]) if x[0] is not None else 0, x[1]))


def test_grouped_keeps_the_null_group_last(spark):
    df = spark.createDataFrame([(3, "b"), (1, None), (2, "a"), (4, "b")], "k int, g string")
    assert [(r.g, r.pos, [x.k for x in r.rows]) for r in ordering.grouped(df, "g", ["k"], ["k"]).orderBy("pos").collect()] == [("a", 1, [2]), ("b", 2, [3, 4]), (None, 3, [1])]


def test_group_ends_are_those_of_the_groups(spark):
    df = spark.createDataFrame([(3, "b"), (1, None), (2, "a"), (4, "b"), (None, "b"), (0, "c")], "k int, g string")
    whole = {r.g: (r.pos, len(r.rows), r.rows[0].k, r.rows[-1].k) for r in ordering.grouped(df, "g", ["k"], ["k"]).collect()}
    assert {r.g: (r.pos, r.n, r.first.k, r.last.k) for r in ordering.group_ends(df, "g", ["k"], ["k"]).collect()} == whole


def test_has_more(spark):
    order = [F.col("id").asc()]
    assert [tuple(ordering.has_more(spark.range(n), order, 3).first()) for n in (0, 3, 4)] == [(0, False), (3, False), (3, True)]


def column(spark, expr, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr.alias("x")).first().x


def test_columns(spark):
    c = F.col
    for text, want in {"12ab": 12, " -7": -7, "x1": None, "": None, "99999999999999999999": None, "+3": 3}.items():
        assert column(spark, C.leading_int(c("t")), t=text) == want
    assert [column(spark, C.ref_part(c("r"), i), r="Gen.1") for i in (1, 2, 3)] == ["Gen", "1", ""]
    assert column(spark, C.ref_link(c("r")), r="Gen.1.2") == "gen#Gen.1.2" and column(spark, C.ref_link(c("r"), True), r="Gen.1.2") == "/gen/#Gen.1.2"
    assert column(spark, C.range_label(c("t"), c("a"), c("b")), t="Gen 1:1", a="Gen.1.1", b="Gen.2.3") == "Gen 1:1-2:3"
    assert column(spark, C.optional_join(c("a"), c("b")), a=None, b="y") == "y" and column(spark, C.optional_join(c("a"), c("b")), a=None, b=None) is None
    assert column(spark, C.initial(c("a")), a="äb") == "Ä" and column(spark, C.initial(c("a")), a="") == ""
    kinds = {"Prov 25:2": "reference", "1 John 3": "chapter", "ab": "short", "in the": "phrase", "Abraham": "phrase", "Äb 1:2": "reference"}
    assert {t: column(spark, C.input_kind(c("t")), t=t) for t in kinds} == kinds
    flags = {n: column(spark, f, v=0, p=2, l=0, t="abc") for n, f in C.flags(c("v"), c("p"), c("l"), c("t")).items()}
    assert flags == {"show_verses": False, "show_people": True, "show_places": False, "show_all": True, "show_one": True, "show_none": False}


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aä &=?%+#/", max_size=12))
def test_search_address_comes_back(spark, text):
    url = F.concat(F.lit("http://x.example"), tables.search_url(F.col("t")))
    assert column(spark, tables.url_parameter(url), t=text) == text


def test_session_settings(spark):
    from graphspun.session import SETTINGS, session

    same = session()
    assert same.conf.get("spark.sql.session.timeZone") == "UTC"
    assert same.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == SETTINGS["spark.sql.execution.arrow.maxBytesPerBatch"]


def test_sources(spark, tmp_path):
    assert tables.constant(spark, title="T").collect()[0].asDict() == {"title": "T"}
    (tmp_path / "a.png").write_bytes(b"x")
    assert tables.files(spark, str(tmp_path), "*.png").first().length == 1
    rows = spark.createDataFrame([("book", "gen", "gen"), ("person", "adam", "person/adam")], "kind string, lookup_name string, path string")
    for _ in range(2):
        tables.write_manifest(rows, str(tmp_path / "m"))
    tables.write_manifest(rows.where("kind = 'book'"), str(tmp_path / "m"))
    assert Counter(r.kind for r in spark.read.parquet(str(tmp_path / "m")).collect()) == {"book": 1, "person": 1}
