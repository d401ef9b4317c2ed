import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphspun.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _h string, group_size int"
ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (7, None), (8, ""), (2, " a b"), (11, "x" * 200_000), (10, "x" * 200_000), (4, "A b"), (None, "q"), (None, "a b"), (6, "é b"), (12, "a\x0b\x0c\r\nb")]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [i for i in groups[n] if i is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", "h", 1) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("digest", [exact_dedup.md5_128, lambda c: F.substring(c, 1, 1), lambda c: F.lit("same")])
@pytest.mark.parametrize("most", [1 << 18, 0])
def test_groups_whatever_the_hash(spark, digest, most):
    found = exact_dedup.exact_groups(frame(spark, ROWS), digest=digest, broadcast_hashes=most)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(ROWS)


def test_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.survivors(frame(spark, [])).count() == 0


def test_survivors_keep_columns_and_one_of_repeated_rows(spark):
    found = exact_dedup.survivors(frame(spark, ROWS + [(3, "a\tb"), (3, "a\tb")]))
    assert found.columns == ["doc_id", "text", "keep_id", "_h", "group_size"]
    assert sorted((r.doc_id for r in found.collect()), key=str) == sorted([3, 7, 2, 10, 4, None, 6], key=str)
