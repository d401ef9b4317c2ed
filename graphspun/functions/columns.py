"""Column functions for names, references and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of place and the zoom level of their map; any other place has the last one.
ZOOM = {"Region": 4.0, "Water": 4.0, "Island": 5.0}
ZOOM_ELSE = 7.5


def initial(name: Column) -> Column:
    """The first character in upper case."""
    return F.upper(F.substring(name, 1, 1))


def leading_int(text: Column) -> Column:
    """The integer that a text begins with, after white space; null if it begins with none or the integer is too large."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def ref_part(ref: Column, part: int) -> Column:
    """Part 1, 2 or 3 (book, chapter, verse) of a reference; empty if the reference is shorter."""
    return F.split_part(ref, F.lit("."), F.lit(part))


def ref_link(ref: Column, absolute: bool = False) -> Column:
    """Where a reference is found: book#ref, or /book/#ref."""
    book = F.lower(ref_part(ref, 1))
    return F.concat(F.lit("/"), book, F.lit("/#"), ref) if absolute else F.concat(book, F.lit("#"), ref)


def range_label(first_title: Column, first_ref: Column, last_ref: Column) -> Column:
    """First title, a hyphen, the last chapter and a colon if the chapters differ, and the last verse."""
    chapter = F.when(ref_part(first_ref, 2) != ref_part(last_ref, 2), F.concat(ref_part(last_ref, 2), F.lit(":"))).otherwise(F.lit(""))
    return F.concat(first_title, F.lit("-"), chapter, ref_part(last_ref, 3))


def plain_range_label(first_title: Column, last_ref: Column) -> Column:
    """range_label() without a look at the chapters: first title, a hyphen and the last verse."""
    return F.concat(first_title, F.lit("-"), ref_part(last_ref, 3))


def shown_if(rows: Column, content: Column) -> Column:
    """A part of a page that is there only if its list holds anything; null if not."""
    return F.when(F.size(rows) > 0, content)


def merged(record: Column, **values: Column) -> Column:
    """A record with some of its fields replaced, and new ones added."""
    for name, value in values.items():
        record = record.withField(name, value)
    return record


def optional_join(*parts: Column) -> Column:
    """The parts that are there, with a space between; null if none is."""
    there = F.concat_ws(" ", *parts)
    return F.when(F.coalesce(*parts).isNotNull(), there)


def names(rows: Column, field: str = "name") -> Column:
    """A list's names with commas; empty for an empty list."""
    return F.array_join(F.transform(rows, lambda x: x[field]), ", ")


def page_path(kind: str, slug: Column) -> Column:
    """The path of an entity's page; books stand at the top."""
    return slug if kind == "book" else F.concat(F.lit(f"{kind}/"), slug)


def link_unless(status: Column, path: Column, hidden: str = "wip") -> Column:
    """A link, or null for rows of the hidden status; a row without a status has its link."""
    return F.when(status == hidden, F.lit(None)).otherwise(path)


def zoom(feature_type: Column) -> Column:
    out = F.lit(ZOOM_ELSE)
    for level in sorted(set(ZOOM.values())):
        out = F.when(feature_type.isin([k for k, v in ZOOM.items() if v == level]), F.lit(level)).otherwise(out)
    return out


def markdown_text(text: Column) -> Column:
    """What a reader sees of Markdown: links and images by their text, no signs of emphasis, code, headings, quotes and lists."""
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^[ ]{0,3}(#{1,6}|>|[-*+]|[0-9]+\.)[ ]+", "")
    out = F.regexp_replace(out, r"(\*\*|__|\*|`)([^*`\n]+?)(\*\*|__|\*|`)", "$2")
    return F.regexp_replace(out, r"\n{2,}", "\n")


def mention_card(count: Column, first_ref: Column) -> Column:
    """"N verses. First mentioned in R"; without a mention, the count alone."""
    return F.concat(count.cast("string"), F.lit(" verses."), F.coalesce(F.concat(F.lit(" First mentioned in "), first_ref), F.lit("")))


#: A book's name of one or more words, perhaps with a number before it.
_BOOK = r"^\s*([0-9]\s*)?\p{L}+\.?(\s+\p{L}+\.?)*\s+[0-9]+"


def input_kind(text: Column) -> Column:
    """What a search text looks like: short, reference (a verse or a range of verses), chapter or phrase."""
    return (
        F.when(F.length(text) < 3, "short")
        .when(text.rlike(_BOOK + r"\s*:\s*[0-9]+(\s*[-–]\s*[0-9]+)?\s*$"), "reference")
        .when(text.rlike(_BOOK + r"\s*$"), "chapter")
        .otherwise("phrase")
    )


def flags(verses: Column, people: Column, places: Column, text: Column) -> dict[str, Column]:
    """Which parts of a result page are shown, from the numbers of hits."""
    shown = [verses > 0, people > 0, places > 0]
    some = shown[0] | shown[1] | shown[2]
    return {
        "show_verses": shown[0],
        "show_people": shown[1],
        "show_places": shown[2],
        "show_all": some,
        "show_one": F.size(F.filter(F.array(*shown), lambda x: x)) == 1,
        "show_none": (F.length(text) > 2) & ~some,
    }
