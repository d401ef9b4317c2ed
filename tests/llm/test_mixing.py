from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from graphspun.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target int, epochs double"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 1, 0.0) for d, t, s in rows], SCHEMA)


def brute_targets(sizes, weights, most):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def corpus():
    rows = []
    for i in range(900):
        source = ["src0", "src1", "src2", "b", None, "big"][min(5, i * i % 7)]
        rows.append((i, "w " * (i * 37 % 90), source))
    return rows + [(2000, None, "src0"), (2001, "", "void"), (2002, " \t\x0b", "void"), (2003, "é x y\nz", "src1"), (None, "a b c", "src1"), (3000, "x " * 30_000, "long")]


def test_targets_and_taken(spark):
    rows = corpus()
    sizes, docs = Counter(), {}
    for d, t, s in rows:
        n = len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
        sizes[s] += n
        docs[d] = n, s
    found = mixing.mix(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    target, taken, largest = brute_targets(sizes, (1, 2, 3), 3.0), defaultdict(int), defaultdict(int)
    for r in found:
        n, s = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s])
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * n and r.taken == n * r.epochs
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1


def test_same_result_again_and_weights_of_documents(spark):
    rows = [(i, "w " * 10, "a" if i % 2 else "b") for i in range(600)]
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows)).collect()) for _ in range(2))
    assert a == b
    df = frame(spark, rows).selectExpr("*", "CASE WHEN doc_id < 300 THEN 8.0 ELSE 1.0 END AS q")
    taken = {r.doc_id: r.epochs for r in mixing.mix(df, quality=df["q"]).collect()}
    short = [i for i in taken if not i % 2 == 0]
    first = [i for i in short if i < 300]
    assert sum(taken[i] for i in first) > 1.4 * sum(taken[i] for i in short if i >= 300)


def brute_taken(rows, target, sizes, key):
    """The rule of selection: whole epochs, then in the order of the keys while the middle of the document lies before the rest of the budget."""
    taken = {}
    for s, t in target.items():
        whole = int(t / sizes[s] + 1e-12) if sizes[s] else 0
        rest, before = t - whole * sizes[s], 0
        for d, n in sorted(((d, n) for d, n, x in rows if x == s), key=lambda r: key[r[0]]):
            taken[d] = n * (whole + (n > 0 and before + n / 2 < rest))
            before += n
    return taken


def test_selection_against_brute_force(spark):
    """The keys themselves are recomputed from the hash that the operator states; which documents are then taken is held against a plain loop."""
    import math

    from pyspark.sql import functions as F

    rows = [(i, "w " * (i * 37 % 90), ["a", "b", "c", None, "big"][min(4, i * i % 7)]) for i in range(700)]
    df = frame(spark, rows).withColumn("q", F.lit(0.2) + (F.col("doc_id") % 5))
    hashes = df.select("doc_id", "q", F.xxhash64(F.lit(17), F.col("doc_id"), F.xxhash64(F.lit(17), F.col("text"))).alias("h")).collect()
    key = {r.doc_id: -math.log((((r.h & (1 << 64) - 1) >> 12) + 0.5) / (1 << 52)) / r.q for r in hashes}
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    expected = brute_taken([(i, len(t.split()), s) for i, t, s in rows], brute_targets(sizes, (1, 2, 3), 3.0), sizes, key)
    assert {r.doc_id: r.taken for r in mixing.mix(df, quality=df["q"]).collect()} == expected


def test_odd_weights(spark):
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -3.0, 1e300, 1e-300]
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 200 else "b", odd[i % len(odd)]) for i in range(240)], "doc_id long, text string, source string, q double")
    found = mixing.mix(df, quality=df["q"]).collect()
    assert len(found) == 240 and all(0 <= r.taken <= 30 for r in found)
    partly = {r.doc_id: r.epochs for r in found if r.doc_id < 200}
    assert min(partly[i] for i in partly if i % 8 in (2, 6)) >= max(partly[i] for i in partly if i % 8 in (3, 4, 5, 7))


def test_slices_are_even_whatever_the_weights(spark):
    from pyspark.sql import functions as F

    cuts, n = 100, 100_000
    for weight in (F.lit(1.0), F.lit(1e-6), F.lit(1e4), F.when(F.col("id") % 3 == 0, F.lit(0.01)).otherwise(F.lit(1.0))):
        draw = (F.shiftrightunsigned(F.xxhash64("id"), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        part = F.floor(F.log(-F.log(draw) / weight) * F.lit(float(cuts)))
        assert spark.range(n).groupBy(part.alias("s")).count().agg(F.max("count")).first()[0] < 0.6 * n / cuts


def test_empty_and_all_empty_texts(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    found = mixing.mix(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert all((r.target, r.taken) == (0.0, 0) for r in found) and len(found) == 2


def test_mixed_repeats_rows(spark):
    rows = corpus() + [(5, "w " * 95, "src1"), (5, "w " * 95, "src1")]
    times = Counter()
    for r in mixing.mix(frame(spark, rows)).collect():
        times[r.doc_id] += r.epochs
    found = mixing.mixed(frame(spark, rows))
    assert found.columns == ["doc_id", "text", "source", "size", "target", "epochs"]
    assert Counter(r.doc_id for r in found.collect()) == Counter({k: v for k, v in times.items() if v})


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_brute_targets_sum(sizes):
    """The rule that the other test holds the operator against: shares add up to the whole."""
    sizes = dict(enumerate(sizes))
    sizes = {str(k): v for k, v in sizes.items()}
    assert abs(sum(brute_targets(sizes, (1, 2, 3), 3.0).values()) - sum(sizes.values())) < 1e-6
