import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspun.llm import simhash

SCHEMA = "doc_id long, text string, fp int, component_id string, top int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "c", 2) for d, t in rows], SCHEMA)


def brute_fingerprint(text, k=3):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points, linked):
    """points: {name: value}; least name reachable."""
    names = sorted(points)
    top = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for a in names:
            for b in names:
                if top[a] != top[b] and linked(points[a], points[b]):
                    top[a] = top[b] = min(top[a], top[b])
                    changed = True
    return top


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAzZ \t\n\x0b é.", max_size=60))
def test_fingerprint(text):
    assert int(simhash.fingerprint(text)[0][0]) == brute_fingerprint(text)


def test_fingerprint_of_a_very_long_text():
    text = " ".join(str(i * i % 977) for i in range(40_000))
    assert int(simhash.fingerprint(text)[0][0]) == brute_fingerprint(text)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 64), st.integers(0, 6))
def test_tree_and_leaves_find_the_groups_of_all_pairs(seed, n, leaves, within):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 1 << 63, max(1, n // 3), dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    points = np.unique(np.concatenate((points, points[rng.integers(0, len(points), n)] ^ np.bitwise_xor.reduce(flips[:, : rng.integers(0, 4)], axis=1))))
    tree = simhash.VantageTree(points[::2] if len(points) > 1 else points, leaves)
    which, leaf, home, before = tree.visit(points, within)
    assert sorted(which[home]) == list(range(len(points)))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= within
    label = np.arange(len(points))
    for at in np.unique(leaf):
        own = np.flatnonzero((leaf == at) & (home | before))
        if len(own) and home[own].any():
            x, y = simhash.leaf_links(points[which[own], None], home[own], within, within)
            for a, b in zip(which[own][x], which[own][y]):
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    expected = np.arange(len(points))
    while True:
        new = np.where(near, expected[None], len(points)).min(1)
        if (new == expected).all():
            break
        expected = new
    assert (label == expected).all()


def corpus():
    words = [f"w{i * i % 911}" for i in range(3000)]
    rows = [(i, " ".join(words[i * 7 : i * 7 + 150])) for i in range(0, 300, 3)]
    rows += [(1000 + i, rows[i][1].replace("w1 ", "W1\t")) for i in range(40)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(40)]
    return rows + [(5000, None), (4999, ""), (5001, " \n"), (5002, "one"), (5003, "one two"), (None, "one"), (5004, "x" * 300_000)]


def test_near_groups_against_all_pairs(spark):
    rows = corpus()
    prints = {d: brute_fingerprint(t) for d, t in rows if d is not None}
    top = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    found = simhash.near_groups(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", top[r.doc_id])
    assert {r.component_id for r in found if r.doc_id is None} == {5002}


def test_crowded_leaves_are_cut(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 6, dtype=np.int64)
    fps = sorted({int(base[i % 6] ^ (1 << int(a)) ^ (1 << int(b))) for i, (a, b) in enumerate(rng.integers(0, 60, (300, 2)))})
    points = spark.createDataFrame([(i, [fp], 1) for i, fp in enumerate(fps)], "point long, fp array<long>, shingles long")
    whole, cut = (simhash.components(simhash.fingerprint_links(points, 2, 2, block=b), "x", "y").collect() for b in (1 << 16, 20))
    assert sorted(whole) == sorted(cut) and len(whole) > 200
    top = brute_components(dict(enumerate(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    assert {r.vertex: r.component for r in cut} == {k: v for k, v in top.items() if k in {r.vertex for r in cut}}


def edited(rng, n=60):
    rows = []
    for g in range(n):
        words = [f"v{x}" for x in rng.integers(0, 3000, int(rng.choice([3, 8, 30, 200, 500])))]
        rows.append(words)
        for _ in range(int(rng.integers(0, 5))):
            copy = list(rows[int(rng.integers(len(rows) - 1, len(rows)))])
            for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.choice([0.004, 0.02, 0.05])))):
                copy[int(at)] = f"e{rng.integers(0, 9999)}"
            rows.append(copy[: len(copy) - int(rng.integers(0, 3))] or copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def shingles_of(text, k=5):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def alike(a, b):
    return (not a and not b) or len(a & b) >= 0.8 * len(a | b)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32))
def test_checked_links_are_those_of_all_pairs(seed):
    rows = edited(np.random.default_rng(seed), 12)
    fp = np.stack([simhash.fingerprint(t, 5, 42, 4)[0] for _, t in rows])
    x, y = simhash.checked_links(fp, [simhash.shingle_set(t, 5) for _, t in rows], 256, 0.8)
    top = brute_components({i: shingles_of(t) for i, t in rows}, alike)
    label = {i: i for i, _ in rows} | dict(zip(x.tolist(), y.tolist()))
    assert label == top


def test_near_texts_against_all_pairs(spark, monkeypatch):
    rows = edited(np.random.default_rng(8)) + [(9001, None), (9000, ""), (9002, "A b"), (9003, "a  B")]
    top = brute_components({i: shingles_of(t or "") for i, t in rows}, alike)
    for small in (None, (3, 1 << 22, 0), (1 << 12, 40, 0)):
        if small:  # groups in blocks by their number or by their shingles, keys by a shuffle
            monkeypatch.setattr(simhash.verified_links, "__defaults__", small)
        found = simhash.near_texts(frame(spark, rows)).collect()
        assert {r.doc_id: r.component_id for r in found} == top
        assert {r.doc_id for r in found if r.kept} == set(top.values())


def test_near_texts_whose_passages_repeat_differently(spark):
    rng, rows = np.random.default_rng(4), []
    for g in range(40):
        words, line = ([f"r{x}" for x in rng.integers(0, 10**6, n)] for n in ((200, 10), (200, 20))[g % 2])
        rows += [(2 * g, " ".join(words + line)), (2 * g + 1, " ".join(words + line * (6, 4)[g % 2]))]
    assert all(alike(shingles_of(a), shingles_of(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    found = simhash.near_texts(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: d // 2 * 2 for d, _ in rows}


def test_texts_that_one_repeated_line_rules_are_not_merged(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"line{i}" for i in range(11)) + " "
    rows = [(i, line * 40 + " ".join(f"r{x}" for x in rng.integers(0, 10**6, 30))) for i in range(30)]
    assert not alike(shingles_of(rows[0][1]), shingles_of(rows[1][1]))
    assert {r.doc_id: r.component_id for r in simhash.near_texts(frame(spark, rows)).collect()} == {i: i for i, _ in rows}


def test_different_sets_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "h  i j k l m N")]
    real = simhash.set_fingerprints
    monkeypatch.setattr(simhash, "set_fingerprints", lambda *a: real(*a).withColumn("fp", simhash.F.expr("array(0L, 0L, 0L, 0L)")))
    assert {r.doc_id: r.component_id for r in simhash.near_texts(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 2}


def test_no_short_near_text_is_missed(spark):
    rng, rows = np.random.default_rng(6), []
    for g in range(1500):
        words = [f"s{x}" for x in rng.integers(0, 10**6, 9 + g % 4)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:-1]))]
    found = simhash.near_texts(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: d // 2 * 2 for d, _ in rows}


def test_set_fingerprint():
    hashes = simhash.shingle_set(" ".join(str(i * i % 977) for i in range(40_000)), 5)
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for part in (hashes[:0], hashes[:5], hashes):
        for k, word in enumerate(simhash.set_fingerprint(part, 4).tolist()):
            drawn = [mixed(h + (k + 1) * 0x9E3779B97F4A7C15 & mask) for h in part.tolist()]
            assert word == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in drawn) > len(drawn))


def test_empty(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    assert simhash.survivors(frame(spark, [])).count() == 0


def test_survivors_of_near_texts(spark):
    rng = np.random.default_rng(3)
    rows, expected = [], set()
    for g in range(30):
        words = [f"v{x}" for x in rng.integers(0, 5000, int(rng.integers(150, 600)))]
        expected.add(10 * g)
        for c in range(4):
            copy = list(words)
            if c:
                copy[int(rng.integers(len(copy)))] = "changed"
            rows.append((10 * g + c, " ".join(copy)))
    rows += [(7, rows[7][1])] * 2 + [(9000, "alone"), (9000, "alone")]
    found = simhash.survivors(frame(spark, rows))
    assert found.columns == ["doc_id", "text", "fp", "component_id", "top"]
    assert sorted(r.doc_id for r in found.collect()) == sorted(expected - {10} | {7, 9000})
