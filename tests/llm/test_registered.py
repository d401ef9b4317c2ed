"""The registered queries of this subpackage: their names, and those with SQL against it."""

import os

import pytest

from graphspun.llm.queries import QUERIES, SQL

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op4_packing", "op5_mixing", "op6_token_counts", "op10_wavelet_shards"])
def test_every_document_is_there(spark, name):
    found = {r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()}
    assert found == {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
