"""The stages of the pipeline on a small corpus, each held against what brute force says of its own input."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from graphspun.llm import mixing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, _key string, threshold string"
SYLLABLES = "the and ing her tion wh sh ble or ed".split()


def words(rnd, n):
    return ["".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n)]


def corpus():
    rnd = random.Random(11)
    rows = []
    for i in range(500):
        rows.append((i, " ".join(words(rnd, rnd.choice([40, 150, 400]))) + ".", "en", f"src{i % 4}"))
    for i in range(40):
        rows.append((1000 + i, rows[i][1].replace(" ", rnd.choice(["  ", "\t", "\n"]), 3), "en", "src0"))  # exact copies
    for i in range(40, 80):
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((1000 + i, " ".join(w), "en", "src1"))  # near copies
    for i in range(50):
        rows.append((2000 + i, " ".join(w + "&&&" for w in words(rnd, 80)), "en", "src2"))  # junk
    rows += [(3000, None, None, None), (3001, "", "xx", None), (3002, "short text", "en", "src9"), (7, rows[7][1], "en", "src3")]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(d, t, l, s, len(t or ""), 1, "k", "t") for d, t, l, s in corpus()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(500)] + [(2000 + i, 0, 0) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results[name] = before, docs.collect()
        if name != "packing":
            assert docs.columns == columns

    before, after = results["quality"]
    kept = Counter(r.doc_id for r in after)
    assert not [i for i in range(2000, 2050) if kept[i]]
    assert sum(kept[i] > 0 for i in range(500)) >= 485 and kept[3000] == kept[3001] == 1
    assert all(r in before for r in after)

    before, after = results["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())

    before, after = results["near_dedup"]
    shingles = {r.doc_id: frozenset(zip(*[(r.text or "").lower().split()[i:] for i in range(5)])) for r in before}
    kept = {r.doc_id for r in after}
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])  # noqa: E731  also true of two empty ones
    long = [d for d in shingles if len(shingles[d]) > 4]
    for a in long:
        near = [b for b in long if a != b and alike(a, b)]
        assert a in kept if not near else (a in kept) == all(a < b for b in near)

    before, after = results["mixing"]
    times = Counter(r.doc_id for r in after)
    expected = Counter()
    for r in mixing.mix(spark.createDataFrame(before, SCHEMA)).collect():
        expected[r.doc_id] += r.epochs
    assert times == Counter({k: v for k, v in expected.items() if v}) and max(times.values()) <= 3

    before, after = results["packing"]
    library = tokens.open_file(public_tokenizers.path("byte_bpe_50k.json")).library
    n = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(r.length for r in after) == n and len({r.sequence_id for r in after}) <= 1.2 * n / 1024


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns[0] == "doc_id" and found.count() > 300


def test_empty_tables(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_decides_by_the_threshold(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for r in quality.judge(docs, labels).where("threshold is not null and perplexity is not null").collect():
        assert r.kept == (r.perplexity <= r.threshold * (1 + 1e-12))
