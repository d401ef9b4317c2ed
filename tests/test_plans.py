"""What the plans of the registered queries must show: filters and columns at the scan, semi joins, no cross joins."""

import os
import re

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return entry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", text)


def test_lookup_reaches_the_scan(spark):
    text = plan(spark, "lookup_by_key")
    assert "EqualTo(c_custkey,42)" in text and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in text and "Exchange" not in text


def test_exists_is_a_semi_join_with_its_key_at_both_scans(spark):
    text = plan(spark, "exists_related")
    assert "LeftSemi" in text and "EqualTo(l_suppkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_only_two_columns_of_the_lines_are_read(spark):
    for name in ("name_list", "exclude_self", "first_two"):
        assert set(re.findall(r"ReadSchema: struct<(l_[^>]*)>", plan(spark, name))) == {"l_orderkey:bigint,l_suppkey:bigint"}


def test_pages_are_top_k(spark):
    for name in ("search_text_page2", "search_names"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_runs_of_verses_are_dealt_by_chapter(spark):
    """No window over a whole book, of which there are five."""
    text = plan(spark, "verses_by_book")
    assert re.search(r"hashpartitioning\(book#\d+, chapter#\d+", text) and not re.search(r"Window .*\], \[book#\d+\], \[", text)
