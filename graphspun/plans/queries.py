"""The registered queries: each operator on the driver's tables, which stand in for the graph's.

region, nation, customer, orders are testament, book, chapter, verse; supplier is person, nation is place,
orders is event, its priority the period, its lines the people and verses of the event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphspun.functions import columns as C
from graphspun.operators import nested as N
from graphspun.operators import search as S
from graphspun.operators.ordering import group_ends, has_more, numbered
from graphspun.operators.runs import chapter_islands, island_label, islands
from graphspun.plans.pages import QUERIES as PAGES
from graphspun.sources.tables import constant, parts, read, url_parameter


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _slug(name: str, key: str) -> F.Column:
    return _text(F.lower(F.col(name)), "-", F.col(key))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """event_participant: the different suppliers of each order, dealt by order; partitions grow in number with the lines, not in size."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return lines.repartition(parts(lines), "l_orderkey").distinct()


def site_title(spark: SparkSession, d: str) -> DataFrame:
    return constant(spark, title="Graph pages")


def slug_scan(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(_text("supplier-", F.col("s_suppkey")).alias("slug"))


def page_manifest(spark: SparkSession, d: str) -> DataFrame:
    slugs = {
        "book": read(spark, d, "nation").select(_slug("n_name", "n_nationkey").alias("lookup_name")),
        "place": read(spark, d, "region").select(_slug("r_name", "r_regionkey").alias("lookup_name")),
        "person": slug_scan(spark, d).withColumnRenamed("slug", "lookup_name"),
        "period": read(spark, d, "orders").select(F.lower("o_orderpriority").alias("lookup_name")).distinct(),
    }
    out = None
    for kind, rows in slugs.items():
        rows = rows.select(F.lit(kind).alias("kind"), "lookup_name", C.page_path(kind, F.col("lookup_name")).alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def sitemap(spark: SparkSession, d: str) -> DataFrame:
    return page_manifest(spark, d).select(F.concat(F.lit("https://site.example/"), "path").alias("loc"))


def markdown_text(spark: SparkSession, d: str) -> DataFrame:
    text = _text("# ", F.col("c_name"), "\n\nLives in **", F.col("c_mktsegment"), "**, see [page ", F.col("c_custkey"), "](/person/", F.col("c_custkey"), ").\n- *one*\n- `two`")
    return read(spark, d, "customer").select("c_custkey", C.markdown_text(text).alias("plain"))


def index_sorted(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("status"))
    return numbered(rows, "name", ["key"])


def index_desc(spark: SparkSession, d: str) -> DataFrame:
    return numbered(read(spark, d, "region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("key")), "title", ["key"], descending=True)


def books_by_testament(spark: SparkSession, d: str) -> DataFrame:
    out = N.expand(read(spark, d, "region"), "r_regionkey", read(spark, d, "nation"), "n_regionkey", ["n_nationkey"], ["n_nationkey", "n_name"], "books")
    return out.select("r_name", F.posexplode_outer("books").alias("at", "book")).select("r_name", (F.col("at") + 1).cast("long").alias("pos"), F.col("book.n_nationkey").alias("n_nationkey"), F.col("book.n_name").alias("n_name"))


def book_text_nested(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").where(F.col("n_nationkey") == 3)
    chapters = N.some(read(spark, d, "customer"), "c_nationkey", nation, "n_nationkey")
    chapters = N.expand(chapters, "c_custkey", read(spark, d, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"], "verses", narrow=True)
    out = N.expand(nation, "n_nationkey", chapters, "c_nationkey", ["c_custkey"], ["c_custkey", "c_name", "verses"], "chapters")
    out = out.select("n_name", F.posexplode_outer("chapters").alias("at", "c"))
    return out.select("n_name", (F.col("at") + 1).cast("long").alias("pos"), F.col("c.c_name").alias("chapter"), F.size("c.verses").cast("long").alias("n_verses"), F.array_join(F.transform("c.verses", lambda v: F.concat(v["o_orderkey"].cast("string"), v["o_orderstatus"])), " ").alias("verses"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("period"), F.col("o_orderdate").alias("sort_key"), F.year("o_orderdate").cast("long").alias("year"))


def period_overview(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    first = N.first_related(events, "period", ["sort_key", "event"], ["event", "year"], "n_events").withColumnRenamed("year", "first_year").withColumnRenamed("event", "first_event")
    years = events.groupBy("period").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))
    return first.join(years, "period").select("period", "first_event", "first_year", "n_events", "years")


def lookup_by_key(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, c_name, c_mktsegment FROM {customer} WHERE c_custkey = :key", args={"key": 42}, customer=read(spark, d, "customer"))


def exclude_self(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return N.shared(lines, "l_suppkey", "l_orderkey", parts(lines)).withColumnRenamed("n", "shared_events")


def exists_related(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").where(F.col("l_suppkey") == 7)
    return N.some(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", lines, "l_orderkey")


def single_related(spark: SparkSession, d: str) -> DataFrame:
    people = read(spark, d, "supplier").where(F.col("s_nationkey") == 5).select("s_suppkey")
    edge = N.some(read(spark, d, "lineitem"), "l_suppkey", people, "s_suppkey")
    return N.single(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", edge, "l_orderkey", "l_suppkey")


def period_detail(spark: SparkSession, d: str) -> DataFrame:
    """Years of each period, and in each the open events, with their people; years without one stay."""
    cells = _events(spark, d).select("period", "year").distinct()
    events = N.some(_events(spark, d), "event", read(spark, d, "orders").where("o_orderstatus = 'P'"), "o_orderkey")
    people = N.along(N.some(_edges(spark, d), "l_orderkey", events, "event"), "l_suppkey", read(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    of_event = events.join(people.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_people"), F.min("s_name").alias("first_person")), F.col("event") == F.col("l_orderkey"), "left")
    filled = of_event.groupBy("period", "year").agg(F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("n_people"), F.lit(0)).alias("n_people"), F.min("event").alias("first_event"), F.min("first_person").alias("first_person"))
    return cells.join(filled, ["period", "year"], "left").select("period", "year", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_people", F.lit(0)).cast("long").alias("n_people"), "first_event", "first_person")


def _verses(spark: SparkSession, d: str) -> DataFrame:
    """event_verse: the lines of an order as references Book.Chapter.Verse, dealt by order."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return _references(lines.repartition(parts(lines), "l_orderkey"))


def _references(lines: DataFrame) -> DataFrame:
    chapter = (F.col("l_linenumber") / 3).cast("int") + 1
    ref = _text("Ord", F.col("l_orderkey") % 7, ".", chapter, ".", F.col("l_linenumber"))
    return lines.distinct().select("l_orderkey", F.col("l_linenumber").alias("verse_id"), ref.alias("osis_ref"), _text("Ord ", chapter, ":", F.col("l_linenumber")).alias("title"))


def person_timeline(spark: SparkSession, d: str) -> DataFrame:
    """The timeline of one person: events in order, with year, passage, and the other people's names."""
    me = 7
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    n = parts(lines)
    keys = lines.where(F.col("l_suppkey") == me).select("l_orderkey").distinct()
    mine = N.some_few(_events(spark, d), "event", keys, "l_orderkey", n)
    lines = N.some_few(lines, "l_orderkey", keys.withColumnRenamed("l_orderkey", "key"), "key", n)  # before all else, so that what follows is as large as the timeline
    people = N.along_few(lines.where(F.col("l_suppkey") != me).select("l_orderkey", "l_suppkey"), "l_suppkey", read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")
    out = N.expand(mine, "event", people.repartition(n, "l_orderkey"), "l_orderkey", ["name", "s_suppkey"], ["name", "s_suppkey"], "people")
    out = N.expand(out, "event", _references(lines.select("l_orderkey", "l_linenumber").repartition(n, "l_orderkey")), "l_orderkey", ["verse_id"], ["verse_id", "osis_ref", "title"], "verses")
    first, last = F.get("verses", F.lit(0)), F.try_element_at("verses", F.lit(-1))
    out = out.select("event", "sort_key", "year", C.range_label(first["title"], first["osis_ref"], last["osis_ref"]).alias("passage"), C.names(F.col("people")).alias("people"), F.size("people").cast("long").alias("n_people"))
    return numbered(out, "sort_key", ["event"]).drop("sort_key")


def place_timeline(spark: SparkSession, d: str) -> DataFrame:
    here = read(spark, d, "customer").where(F.col("c_nationkey") == 3)
    events = N.some(_events(spark, d), "cust", here, "c_custkey")
    people = N.along(_edges(spark, d), "l_suppkey", read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")
    out = N.expand(events, "event", people, "l_orderkey", ["name", "s_suppkey"], ["name", "s_suppkey"], "people", narrow=True)
    return numbered(out.select("event", "sort_key", "year", C.names(F.col("people")).alias("people")), "sort_key", ["event"]).drop("sort_key")


def person_pages(spark: SparkSession, d: str) -> DataFrame:
    """All people at once: number of events, first and last year, and the years' events in order."""
    events = N.along(_edges(spark, d), "l_orderkey", _events(spark, d), "event")
    first = N.ends(events, "l_suppkey", ["sort_key", "event"], ["event", "year"])
    counts = events.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("year").alias("n_years"))
    out = read(spark, d, "supplier").select("s_suppkey", "s_name").join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").drop("l_suppkey").join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_years", F.lit(0)).alias("n_years"), F.col("first.event").alias("first_event"), F.col("last.event").alias("last_event"))


def self_edge(spark: SparkSession, d: str) -> DataFrame:
    """Partners: people of the same nation who share an event."""
    people = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = people.select(F.col("s_suppkey").alias("_of"), "s_nationkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_suppkey").alias("person"))
    n = parts(lines)
    members = N.along_few(lines, "person", nations, "_of").where("s_nationkey is not null").drop("_of").repartition(n, "l_orderkey", "s_nationkey")  # by all that pairs share, or the join would deal again
    pairs = N.others(members, "l_suppkey", "l_orderkey", "s_nationkey").select("l_suppkey", "other").repartition(n, "l_suppkey").distinct()
    rows = N.along_few(pairs, "other", people.select(F.col("s_suppkey").alias("mate"), F.col("s_name").alias("name")), "mate").withColumnRenamed("l_suppkey", "of")
    out = N.expand(people.select("s_suppkey", "s_name"), "s_suppkey", rows, "of", ["mate"], ["mate", "name"], "partners")
    return out.select("s_suppkey", "s_name", C.names(F.col("partners")).alias("partners"), F.size("partners").cast("long").alias("n_partners"))


def cyclic_hop(spark: SparkSession, d: str) -> DataFrame:
    """A person's parts, and who else supplies them: from the person along the edge and back."""
    writes = read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    mine = writes.where(F.col("l_suppkey") == 7).select("l_partkey")
    writers = N.some(writes, "l_partkey", mine, "l_partkey").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_list("l_suppkey")), ",").alias("writers"), F.count(F.lit(1)).alias("n_writers"))
    return N.along(writers, "l_partkey", read(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", "writers", "n_writers")


def first_related(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    first = N.first_related(events, "cust", ["sort_key", "event"], ["event", "year"], "n")
    out = read(spark, d, "customer").select("c_custkey", "c_name").join(first, F.col("c_custkey") == F.col("cust"), "left")
    return out.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("verse_count"), F.col("event").alias("first_event"), F.col("year").alias("first_year"))


def first_two(spark: SparkSession, d: str) -> DataFrame:
    out = N.expand(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", _edges(spark, d), "l_orderkey", ["l_suppkey"], ["l_suppkey"], "parents")
    return out.select("o_orderkey", F.array_join(F.transform(F.slice("parents", 1, 2), lambda x: x["l_suppkey"].cast("string")), ", ").alias("parents"))


def alpha_index(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select(C.initial(F.col("p_name")).alias("letter"), F.col("p_name").alias("name"), F.col("p_partkey").alias("key"))
    out = group_ends(rows, "letter", ["name", "key"], ["key"])
    return out.select("letter", "pos", "n", F.col("first.key").alias("first_key"), F.col("last.key").alias("last_key"))


def year_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All events in order with their years, the years in the order in which events meet them. A row for each event: no year is gathered in one."""
    events = numbered(_events(spark, d).select("year", "sort_key", "event"), "sort_key", ["event"])
    years = group_ends(events, "year", ["pos"], ["event"], out="year_pos").select(F.col("year").alias("_year"), "year_pos")
    return events.join(F.broadcast(years), F.col("year").eqNullSafe(F.col("_year"))).select("year", "year_pos", "event", "pos")  # a row per year


def first_last(spark: SparkSession, d: str) -> DataFrame:
    out = N.ends(_verses(spark, d), "l_orderkey", ["verse_id"], ["verse_id", "title"])
    return out.select("l_orderkey", F.col("first.title").alias("first_title"), F.col("last.title").alias("last_title"), F.col("last.verse_id").alias("last_verse"))


def name_list(spark: SparkSession, d: str) -> DataFrame:
    people = N.along(_edges(spark, d), "l_suppkey", read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name")), "s_suppkey")
    out = N.expand(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", people, "l_orderkey", ["name", "s_suppkey"], ["name", "s_suppkey"], "people")
    return out.select("o_orderkey", C.names(F.col("people")).alias("names"), F.size("people").cast("long").alias("n"))


def verse_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), (F.col("l_linenumber") / 4).cast("int").alias("chapter")).distinct()
    found = islands(rows, ["l_orderkey"], "chapter", "number", "number")
    return found.select("l_orderkey", F.col("run").cast("long").alias("run"), "chapter", "first", "last", F.col("n").cast("long").alias("n"), island_label().alias("label"))


def range_label(spark: SparkSession, d: str) -> DataFrame:
    out = N.ends(_verses(spark, d), "l_orderkey", ["verse_id"], ["osis_ref", "title"])
    return out.select("l_orderkey", C.range_label(F.col("first.title"), F.col("first.osis_ref"), F.col("last.osis_ref")).alias("label"), C.ref_link(F.col("first.osis_ref")).alias("link"))


def ref_parse_link(spark: SparkSession, d: str) -> DataFrame:
    ref = F.concat_ws(".", "lang", "source", F.col("n_chars").cast("string"))
    rows = read(spark, d, "documents").select("doc_id", ref.alias("ref"))
    return rows.select("doc_id", C.ref_part(F.col("ref"), 1).alias("book"), C.ref_part(F.col("ref"), 2).alias("chapter"), C.ref_part(F.col("ref"), 3).alias("verse"), C.ref_link(F.col("ref")).alias("link"), C.ref_link(F.col("ref"), absolute=True).alias("absolute_link"))


def leading_int(spark: SparkSession, d: str) -> DataFrame:
    tail = F.regexp_extract("url", r"([0-9]+[^0-9]*)$", 1)
    return read(spark, d, "pages").select("page_id", tail.alias("tail"), C.leading_int(tail).alias("number"), C.leading_int(F.col("url")).alias("none"))


def case_level(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("Region"), F.lit("Water"), F.lit("Island"), F.lit("City"), F.lit(None).cast("string")), F.col("p_size") % 5 + 1)
    return read(spark, d, "part").select("p_partkey", kind.alias("feature_type")).withColumn("zoom", C.zoom(F.col("feature_type")))


def status_link(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus", C.link_unless(F.col("o_orderstatus"), _text("/person/", F.col("o_orderkey")), hidden="P").alias("link"))


def optional_concat(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    year = F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string"))
    return read(spark, d, "customer").select("c_custkey", C.optional_join(place, year).alias("born"))


def _text_page(spark: SparkSession, d: str, offset: int) -> DataFrame:
    rows = S.search_texts(read(spark, d, "documents").select("doc_id", "text"), "THE and", "text", "doc_id", 10, offset)
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"))


def search_text_page1(spark: SparkSession, d: str) -> DataFrame:
    return _text_page(spark, d, 0)


def search_text_page2(spark: SparkSession, d: str) -> DataFrame:
    return _text_page(spark, d, 10)


def search_names(spark: SparkSession, d: str) -> DataFrame:
    hits = S.search_names(read(spark, d, "customer").select("c_custkey", "c_name"), "mer#00000000", "c_name", "c_custkey", 3)
    first = N.first_related(_events(spark, d), "cust", ["sort_key", "event"], ["event"], "n")
    out = hits.join(first, F.col("c_custkey") == F.col("cust"), "left")
    return out.select("c_custkey", "c_name", C.mention_card(F.coalesce("n", F.lit(0)), F.col("event").cast("string")).alias("card"))


def search_rest(spark: SparkSession, d: str) -> DataFrame:
    return S.search_names(read(spark, d, "part").select("p_partkey", "p_name"), "ring", "p_name", "p_partkey", -1, 3)


def search_appended(spark: SparkSession, d: str) -> DataFrame:
    return S.appended([_text_page(spark, d, 0), _text_page(spark, d, 10), _text_page(spark, d, 15)])


def search_flags(spark: SparkSession, d: str) -> DataFrame:
    q = "customer#00000000"
    order = [F.col("c_name").asc(), F.col("c_custkey").asc()]
    people = has_more(S.found(read(spark, d, "customer"), q, ["c_name"]), order, 2)
    places = has_more(S.found(read(spark, d, "nation").select(F.col("n_name").alias("c_name"), F.col("n_nationkey").alias("c_custkey")), q, ["c_name"]), order, 2)
    verses = has_more(S.found(read(spark, d, "documents").select(F.col("text").alias("c_name"), F.col("doc_id").alias("c_custkey")), q, ["c_name"]), order[1:], 10)
    hits = None
    for kind, found in (("people", people), ("places", places), ("verses", verses)):
        row = found.select(F.lit(kind).alias("kind"), "shown", "more")
        hits = row if hits is None else hits.unionByName(row)
    of = lambda kind, what: F.max(F.when(F.col("kind") == kind, F.col(what)))
    rows = hits.agg(*[of(k, "shown").alias(k) for k in ("people", "places", "verses")], of("people", "more").alias("more_people"))
    return rows.select("people", "places", "verses", "more_people", *[c.alias(n) for n, c in C.flags(F.col("verses"), F.col("people"), F.col("places"), F.lit(q)).items()])


def input_kind(spark: SparkSession, d: str) -> DataFrame:
    """Search texts of every kind, made of each part's name and size: references, ranges, chapters, names, short ones and other phrases."""
    name, n = F.col("p_name"), F.col("p_size").cast("string")
    forms = [_text(name, " ", n, ":", n), _text("  2 ", name, " ", n, ":1-", n, " "), _text(name, " ", n), name, F.substring(name, 1, 2), _text(n, ":", n), _text(name, " ", n, " more"), _text("2 ", name, " ", n)]
    return read(spark, d, "part").select("p_partkey", F.element_at(F.array(*forms), (F.col("p_partkey") % len(forms) + 1).cast("int")).alias("input")).withColumn("kind", C.input_kind(F.col("input")))


def url_query(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("http://x.example/?a=1&q="), F.col("c_mktsegment"), F.lit("+no"), F.col("c_custkey").cast("string"))
    return read(spark, d, "customer").select("c_custkey", url_parameter(F.when(F.col("c_custkey") % 2 == 0, url).otherwise(F.lit("http://x.example/"))).alias("q"))


def verses_by_book(spark: SparkSession, d: str) -> DataFrame:
    """References by book in the books' own order, each run of verses a row; in a book they are ordered by chapter and first verse."""
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).cast("int").alias("book"), (F.col("l_orderkey") / 5).cast("int").alias("chapter"), F.col("l_linenumber").alias("number")).distinct()
    runs = chapter_islands(rows, ["book"], "chapter", "number").withColumn("label", island_label())
    books = runs.select("book").distinct()
    places = books.select(F.col("book").alias("_book"), F.row_number().over(Window.orderBy("book")).cast("long").alias("pos"))  # a row per book
    return runs.join(F.broadcast(places), F.col("book") == F.col("_book")).select("book", "pos", "chapter", "first", "last", "n", "label")


_ALL = (site_title, slug_scan, page_manifest, sitemap, markdown_text, index_sorted, index_desc, books_by_testament, book_text_nested, period_overview, lookup_by_key, exclude_self, exists_related, single_related, period_detail, person_timeline, place_timeline, person_pages, self_edge, cyclic_hop, first_related, first_two, alpha_index, year_timeline, first_last, name_list, verse_islands, range_label, ref_parse_link, leading_int, case_level, status_link, optional_concat, search_text_page1, search_text_page2, search_names, search_rest, search_appended, search_flags, input_kind, url_query, verses_by_book)

QUERIES = {f.__name__: f for f in _ALL} | PAGES
