import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspun.llm import kn_shards, kneser_ney, language, quality
from graphspun.llm.ngram_counts import gram_lots, ngram_counts

SYLLABLES = {"en": "the and ing her tion wh sh ble or ed".split(), "de": "der ung sch keit lich ein ver ü ß tz".split(), "es": "que ado ción la el ñ mente osa í rr".split()}
SCHEMA = "doc_id long, text string, lang string, score int, total int, key int"


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n)).capitalize() + "."


def frame(spark, rows):
    return spark.createDataFrame([(d, t, l, 1, 2, 3) for d, t, l in rows], SCHEMA)


class Plain:
    """Interpolated modified Kneser-Ney as in the textbooks, with dictionaries."""

    def __init__(self, texts, order, table):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for t in texts:
            seq = (0,) * (order - 1) + tuple(codes(t, table))
            self.counts[-1].update(seq[i : i + order] for i in range(len(seq) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n - 1] = Counter(g[1:] for g in self.counts[n])
        self.d, self.by_context = [], []
        for c in self.counts:
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            self.d.append((0, *kneser_ney.discounts(n1, n2, n3, n4)))
            ctx = defaultdict(list)
            for g, v in c.items():
                ctx[g[:-1]].append(v)
            self.by_context.append(ctx)

    def p(self, gram):
        if not gram:
            return 1 / kneser_ney.CODES
        n = len(gram) - 1
        found = self.by_context[n].get(gram[:-1])
        if not found:
            return self.p(gram[1:])
        total, c = sum(found), self.counts[n].get(gram, 0)
        left = sum(self.d[n][min(v, 3)] for v in found) / total
        return max(c - self.d[n][min(c, 3)], 0) / total + left * self.p(gram[1:])


def codes(text, table):
    out = []
    for x in table[[ord(c) for c in text]] if text else []:
        if not (x == kneser_ney.SPACE and out and out[-1] == kneser_ney.SPACE):
            out.append(int(x))
    return out


@pytest.mark.parametrize("order", [2, 4, 5])
def test_model_against_the_plain_one(order):
    rnd, table = random.Random(2), kneser_ney.raw_table()
    texts = [prose(rnd, "en", 40) for _ in range(12)] + ["", "日本 \n\n x", "9 8"]
    plain = Plain(texts, order, table)
    levels = kneser_ney.train(*kneser_ney.counted(kneser_ney.grams(texts, order, table)[0]), order)
    new = [prose(rnd, "en", 10), prose(rnd, "de", 10), "ZZ 日本", ""]
    keys, size = kneser_ney.grams(new, order, table)
    found = np.split(kneser_ney.logp(levels, keys), np.cumsum(size)[:-1])
    for t, p in zip(new, found):
        seq = (0,) * (order - 1) + tuple(codes(t, table))
        expected = [np.log(plain.p(seq[i : i + order])) for i in range(len(seq) - order + 1)]
        assert np.allclose(p, expected, atol=2e-4)
    context = levels[-1].contexts[3]
    assert abs(np.exp(kneser_ney.logp(levels, (context << kneser_ney.BITS) | np.arange(kneser_ney.CODES)).astype(float)).sum() - 1) < 1e-3


def mean_log(plain, text, table):
    seq = (0,) * (plain.order - 1) + tuple(codes(text, table))
    return np.mean([np.log(plain.p(seq[i : i + plain.order])) for i in range(len(seq) - plain.order + 1)])


@pytest.mark.parametrize("segment", [3, 7, 50])
def test_long_texts_have_the_same_grams_in_pieces(segment):
    rnd, table = random.Random(4), kneser_ney.letter_table()
    texts = [prose(rnd, "de", 30), "a" + " " * 300 + "b" + "1 2" * 40, "", "   ", "x"]
    keys, size = kneser_ney.grams(texts, 4, table)
    whole = np.split(keys, np.cumsum(size)[:-1])
    found = [[] for _ in texts]
    for k, n, owner in gram_lots(texts, 4, table, segment):
        for i, part in zip(owner.tolist(), np.split(k, np.cumsum(n)[:-1])):
            found[i] += part.tolist()
    assert found == [x.tolist() for x in whole]


def test_shards_are_dealt_alike_by_spark_and_numpy(spark):
    keys = kneser_ney.grams([prose(random.Random(5), "es", 300) + " 日本 ñ"], 5, kneser_ney.raw_table())[0]
    rows = spark.createDataFrame([(int(k),) for k in np.unique(keys)], "key long")
    shard = kn_shards._part(F.col("key"), 1, kn_shards.LAST) * kn_shards.BEFORE + kn_shards._part(F.col("key"), 2, kn_shards.BEFORE)
    assert all(r.s == kn_shards.shard_of(np.array([r.key]))[0] for r in rows.select("key", shard.alias("s")).collect())


@pytest.mark.parametrize("lot_chars, units", [(8_000_000, 128), (200, 2)])
def test_scores_against_the_plain_model(spark, lot_chars, units):
    rnd, table = random.Random(9), kneser_ney.letter_table()
    train = [(prose(rnd, lang, 25), lang) for lang in SYLLABLES for _ in range(10)]
    model = kn_shards.train_shards(spark.createDataFrame(train, "text string, lang string"), 4, letters=True)
    texts = [prose(rnd, "en", 12), prose(rnd, "de", 3), "ΑΒΓ 日本", "", "123", prose(rnd, "es", 6)] * 3
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(3, "en", "")] * 5, "i int, own string, text string")
    plain = {lang: Plain([t for t, x in train if x == lang], 4, table) for lang in SYLLABLES}
    for by in (None, "own"):
        found = kn_shards.score(rows, model, by, lot_chars, units).collect()
        assert Counter(r.i for r in found) == Counter([*range(len(texts)), 3, 3, 3, 3, 3])
        for r in found:
            n = len(codes(texts[r.i], table))
            assert r.n_chars == n and r.letters == any(c.isalpha() for c in texts[r.i])
            if n:
                expected = [mean_log(plain[x], texts[r.i], table) * n for x in (model.langs if by is None else ["en"])]
                assert np.allclose(r.totals, expected, atol=1e-3 * n)


def test_counts(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, "en", 30), "en") for i in range(40)] + [(99, None, "en"), (98, "x", None)]
    found = {(r.lang, r.key): r.n for r in ngram_counts(frame(spark, rows), 3, letters=True, keep=200).collect()}
    keys, n = kneser_ney.counted(kneser_ney.grams([t for _, t, l in rows if t and l], 3, kneser_ney.letter_table())[0])
    assert found == {("en", int(k)): int(c) for k, c in zip(keys, n)}


def language_rows(n=600):
    rnd = random.Random(6)
    return [(i, prose(rnd, lang := list(SYLLABLES)[i % 3], rnd.choice([2, 8, 60])), lang) for i in range(n)]


def test_language_held_out_accuracy_and_odd_rows(spark):
    rows = language_rows()
    odd = [(7001, None, "en"), (7002, "", "de"), (7003, "123 !!! 45", "en"), (7004, prose(random.Random(1), "de", 30), None), (None, prose(random.Random(2), "es", 30), "es"), (7005, prose(random.Random(3), "en", 40_000), None), (7005, "the and", "und")]
    found = language.identify(frame(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    true = {d: l for d, _, l in rows}
    held = [r for r in found if r.doc_id in true and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out for r in held) and sum(r.held_out for r in found if r.doc_id in true) == len(held)
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    for i in (7001, 7002, 7003):
        assert (by_id[i][0].lang_pred, by_id[i][0].score) == ("und", 0.0)
    assert by_id[7004][0].lang_pred == "de" and by_id[None][0].lang_pred == "es" and by_id[7005][0].lang_pred == "en"
    assert all(0 <= r.score <= 1 and r.lang_pred in (*SYLLABLES, "und") for r in found)


def test_language_against_the_plain_models(spark):
    """All n-grams of all documents that are neither held out nor for calibration, and the lowest cross-entropy wins."""
    rows, table = language_rows(240), kneser_ney.letter_table()
    df = frame(spark, rows)
    known = df.where(~language.held_out()).select("doc_id", "lang", "text")
    learned = known.where(~language.set_aside(known, 4096)).collect()
    plain = {lang: Plain([r.text for r in learned if r.lang == lang], language.ORDER, table) for lang in sorted(SYLLABLES)}
    for r in language.identify(df).where("doc_id % 6 < 2").collect():
        text = rows[r.doc_id][1]
        cross = {lang: -mean_log(p, text, table) for lang, p in plain.items()}
        assert r.lang_pred == min(cross, key=cross.get) and abs(r.cross_entropy - cross[r.lang_pred]) < 1e-3


def test_a_language_with_few_rows_is_learned(spark):
    rnd = random.Random(12)
    rows = [(i, prose(rnd, ["en", "de"][i % 2], 20), ["en", "de"][i % 2]) for i in range(200)]
    pool = [prose(rnd, "es", 20) for _ in range(900)]
    hashed = frame(spark, [(i, t, "es") for i, t in enumerate(pool)]).select("text", F.pmod(F.xxhash64("text"), F.lit(64)).alias("h")).collect()
    aside = [r.text for r in hashed if r.h == 0][:6]  # all of this language would be for calibration only
    assert len(aside) == 6
    few = [(i, t, "es") for i, t in zip((i for i in range(5000, 5100) if zlib.crc32(str(i).encode()) % 4 != 2), aside)]
    found = language.identify(frame(spark, rows + few + [(9000, prose(rnd, "es", 30), None)])).where("doc_id >= 5000").collect()
    assert {r.lang_pred for r in found} == {"es"}


def test_calibration_is_bounded_and_the_same_again(spark):
    rows = frame(spark, [(i, f"text number {i}", "en") for i in range(20_000)] + [(1, "text number 1", "en")] * 50)
    kept = [rows.where(language.set_aside(rows.repartition(n), 100)).select("text").distinct() for n in (2, 7)]
    assert kept[0].count() == 100 and sorted(kept[0].collect()) == sorted(kept[1].collect())


def test_language_looks_at_nothing_but_the_text(spark):
    rows = language_rows(300)
    changed = [(d, t, l if zlib.crc32(str(d).encode()) % 4 != 2 else "xx") for d, t, l in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, x)).collect()} for x in (rows, changed))
    assert a == b


def test_language_without_anything_to_learn(spark):
    assert language.identify(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in language.identify(frame(spark, [(1, "some text", None)])).collect()] == ["und"]


def quality_rows():
    rnd = random.Random(8)
    good = [(i, prose(rnd, ["en", "de"][i % 2], rnd.choice([20, 80, 300])), ["en", "de"][i % 2]) for i in range(700)]
    bad = [(5000 + i, " ".join(w + rnd.choice(["###", "%%%", "&&&"]) for w in prose(rnd, "en", 60).split()), "en") for i in range(60)]
    return good, bad


@pytest.mark.parametrize("settings", [{}, {"lot_chars": 3000}, {"broadcast_ids": 0}])
def test_quality(spark, settings):
    good, bad = quality_rows()
    odd = [(8001, None, "en"), (8002, "", "de"), (8003, "### %%% &&&", "xx"), (8004, "some text", None), (None, good[0][1], "en"), (good[4][0], good[4][1], "en")]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in good] + [(d, 0, 0) for d, _, _ in bad] + [(None, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    df = frame(spark, good + bad + odd)
    found = quality.judge(df, labels, **settings)
    rows = found.collect()
    assert len(rows) == len(good + bad + odd)
    kept = defaultdict(list)
    for r in rows:
        kept[r.doc_id].append(r.kept)
    assert sum(kept[d][0] for d, _, _ in good) >= 0.97 * len(good)
    assert sum(kept[d][0] for d, _, _ in bad) <= 0.03 * len(bad)
    assert all(kept[i] == [True] for i in (8001, 8002, 8003, 8004)) and len(kept[good[4][0]]) == 2
    if not settings:
        table = kneser_ney.raw_table()
        trained = [t for (d, t, l) in good if l == "en" and d in {r.doc_id for r in spark.createDataFrame([(d,) for d, _, _ in good], "doc_id long").where(~quality._held_out()).collect()}]
        trained += [good[4][1]] if any(t == good[4][1] for t in trained) else []
        plain = Plain(trained, quality.ORDER, table)
        for r in [x for x in rows if x.doc_id in (0, 2, 5000, 5001)]:
            text = {d: t for d, t, _ in good + bad}[r.doc_id]
            seq = (0,) * 4 + tuple(codes(text, table))
            mean = -np.mean([np.log(plain.p(seq[i : i + 5])) for i in range(len(seq) - 4)])
            assert abs(np.log(r.perplexity) - mean) < 1e-3


def test_trusted_ids(spark):
    labels = [(1, 1, 0), (2, 1, None), (3, 1, 0), (3, 0, 0), (4, 1, 0), (4, 1, 1), (5, None, 0), (6, 0, 1), (None, 1, 0), (7, 1, 0), (7, 1, 0), (8, 1, 0), (8, None, None), (9, None, 1), (9, 1, 0)]
    found = quality.trusted_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(r.doc_id for r in found.collect()) == [1, 2, 7, 8]


def test_quality_thresholds_against_brute_force(spark):
    good, bad = quality_rows()
    rnd = random.Random(21)
    rare = [(9000 + i, prose(rnd, "es", 30), "es") for i in range(60)]
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in good + rare], "doc_id long, quality int, toxic int")
    found = quality.judge(frame(spark, good + bad + rare), labels).collect()
    held = {r.doc_id for r in spark.createDataFrame([(d,) for d, _, _ in good + rare], "doc_id long").where(quality._held_out()).collect()}
    size = lambda n: sum(n >= c for c in quality.CLASSES)
    cross, langs = defaultdict(list), defaultdict(list)
    for r in found:
        if r.doc_id in held:
            cross[r.lang, size(r.n_chars)].append(np.log(r.perplexity))
            langs[r.lang].append(np.log(r.perplexity))
    high = lambda x: sorted(x)[max(0, int(np.ceil(0.995 * len(x))) - 1)]
    apart = high([x - np.mean(langs[k]) for k in langs for x in langs[k]])
    assert 0 < len(langs["es"]) < 40 <= len(langs["en"])
    for r in found:
        own = cross[r.lang, size(r.n_chars)]
        expected = high(own) if len(own) >= 40 else high(langs[r.lang]) if len(langs[r.lang]) >= 40 else np.mean(langs[r.lang]) + apart
        assert abs(np.log(r.threshold) - expected) < 1e-6 and r.kept == (r.perplexity <= r.threshold * (1 + 1e-12))


def test_quality_survivors_and_missing_labels(spark):
    good, bad = quality_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark, good[:20] + bad[:5])
    assert sorted(quality.survivors(df, none).collect()) == sorted(df.collect())
    assert quality.judge(frame(spark, []), none).count() == 0
    labels = spark.createDataFrame([(d, 1, 0) for d, _, _ in good], "doc_id long, quality int, toxic int")
    assert quality.survivors(frame(spark, []), labels).count() == 0
    found = quality.survivors(frame(spark, good + bad), labels)
    assert found.columns == frame(spark, []).columns
    assert found.where(F.col("doc_id") < 5000).count() >= 0.97 * len(good) and found.where(F.col("doc_id") >= 5000).count() <= 2
