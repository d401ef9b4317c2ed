import math

import numpy as np
import pytest

from graphspun.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, point string, bucket int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "p", 1, 2) for i, v, l in rows], SCHEMA)


def clusters(seed=1, n=400):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, 16))
    rows = [(i, (centres[i % 25] + rng.standard_normal(16) * rng.choice([0.02, 0.25, 1.0])).astype(np.float32) * rng.choice([1, 40]), int(i % 3)) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)]
    return rows


def brute(rows, cosine=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    n = len(rows)
    near = np.zeros((n, n), bool)
    unit = [np.array(v, np.float32).astype(float) / np.abs(np.array(v, np.float32).astype(float)).max() if ok(v) and l is not None else None for _, v, l in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                near[i, j] = near[j, i] = unit[i] @ unit[j] >= cosine
    label = np.array([r[0] for r in rows], float)
    while True:
        new = np.minimum(label, np.where(near, label[None], np.inf).min(1))
        if (new == label).all():
            break
        label = new
    return {r[0]: (int(near[i].sum()), int(label[i])) for i, r in enumerate(rows)}


@pytest.mark.parametrize("block", [1024, 8])
def test_all_links_of_clusters(spark, block):
    rows = clusters()
    found = embeddings.near_vectors(frame(spark, rows), miss=1e-4, block=block)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    found = found.collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found) and len(found) == len(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, [2.0, 4.0, 6.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("nan"), 3.0], 1), (9, [1.0, float("inf"), 3.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (12, v, 1), (13, [3.4e38, 3.4e38, 3.4e38], 7), (14, [1e-38, 1e-38, 1e-38], 7)]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(frame(spark, rows)).collect()}
    assert found == brute(rows)
    assert found[1] == (2, 1) and found[14] == (1, 13)


def test_null_ids_repeated_rows_and_empty(spark):
    found = embeddings.near_vectors(frame(spark, [(None, [1.0], 1), (4, [1.0], 1), (4, [1.0], 1), (None, [1.0], 2)])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in found) == [("4", 2, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 2, "4")]
    assert embeddings.near_vectors(frame(spark, [])).count() == 0


def test_parameters_follow_the_number_of_points():
    k, tables = zip(*(embeddings.parameters(n, 0.93, 3.0, 0.01, 512) for n in (100, 10_000, 10_000_000)))
    assert k[0] == 1 and list(k) == sorted(k) and list(tables) == sorted(tables) and tables[-1] < 200
    near = embeddings.collision(math.sqrt(0.14), 3.0) ** k[2]
    assert (1 - near) ** tables[2] <= 0.01


def test_recall_at_production_parameters(spark):
    rows = clusters(seed=5, n=800)
    expected, found = brute(rows), {r.vec_id: r.n_links for r in embeddings.near_vectors(frame(spark, rows)).collect()}
    assert sum(found.values()) >= 0.97 * sum(n for n, _ in expected.values())
    assert all(found[i] <= n for i, (n, _) in expected.items())
