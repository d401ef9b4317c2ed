import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphspun.llm import packing, token_counts, tokens, wavelet

BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ALPHABET = " \n\t\r  aAbBzZ09.,!?'sStreveml<|>_-éÉßñÑüÜçİıſΣσςʼnǰ½²³ªº¼€  　日本語あ한글😀́▁­¢±×÷µ"
SPECIAL = ["", " ", "  a  b ", "don't I'll we've HE'S", "<|endoftext|>a <|startoftext|>", "</s> <s>", "a" * 5000, " " * 5000, "\n" * 3000 + "x", "é" * 4000, "▁a ▁"]
SCHEMA = "doc_id long, text string, crc int, start string, seq int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "s", 2) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.sampled_from(SPECIAL), st.text(alphabet=ALPHABET, max_size=60), st.text(max_size=30)))
def test_ids_are_the_librarys(path, text):
    found = tokens.open_file(path)
    assert found.fast is not None
    assert np.frombuffer(found.ids(text), "<u4").tolist() == found.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.sampled_from(SPECIAL), st.text(alphabet=ALPHABET, max_size=60), st.text(max_size=30)))
def test_counts_are_the_librarys(text):
    assert tokens.count_tokens(PIECES, text) == len(tokens.open_file(PIECES).library.encode(text, num_threads=1))


def corpus():
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["alpha", "Beta,", "x1", "don't", "ñandú", "\n"]) for _ in range(rnd.choice([3, 40, 700, 3000])))) for i in range(120)]
    return rows + [(900, None), (901, ""), (902, "z" * 100_000), (None, "no id"), (5, rows[5][1]), (5, "other text"), (903, "a " * 1023)]


def library_ids(path, text, end=None):
    return tokens.open_file(path).library.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    found, offsets = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    room, used = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(50)
        assert (found[i], offsets[i]) == (b, 50 - room[b])
        room[b] -= lengths[i]


@pytest.mark.parametrize("group", [2048, 20])
def test_packing(spark, group):
    rows = corpus()
    found = packing.pack(frame(spark, rows), BYTES, group=group)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    found = found.collect()
    expected, sequences = [], defaultdict(list)
    for d, t in rows:
        ids = library_ids(BYTES, t, 0)
        expected += [(d, s, len(ids[s : s + 1024]), crc(ids[s : s + 1024]), len(ids)) for s in range(0, len(ids), 1024)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(n for p in sequences.values() for _, n in p)
    assert len(sequences) <= -(-total // 1024) + (2 if group == 2048 else 12)


def test_rows_that_are_alike_are_dealt_over_all_groups(spark):
    rows = [(None, "the same few words")] * 3000 + [(7, "the same id too")] * 3000
    found = packing.pack(frame(spark, rows).repartition(3), BYTES, group=60).collect()
    assert len(found) == 6000
    for doc_id in (None, 7):
        groups = Counter(r.sequence_id >> 32 for r in found if r.doc_id == doc_id)
        assert len(groups) == 100 and max(groups.values()) < 100


def test_empty_tables(spark, tmp_path):
    assert packing.pack(frame(spark, []), BYTES).count() == 0
    assert token_counts.token_counts(frame(spark, []), PIECES, str(tmp_path / "c")).count() == 0
    wavelet.write_shards(frame(spark, []), str(tmp_path / "w"), WORDS)
    assert wavelet.read_shards(spark, str(tmp_path / "w")).count() == 0


@pytest.mark.parametrize("broadcast_digests", [1 << 18, 0])
def test_token_counts_and_their_cache(spark, tmp_path, broadcast_digests):
    rows, path = corpus(), str(tmp_path / "cache")
    library = tokens.open_file(PIECES).library
    expected = sorted(((d, len((t or "").encode()), n := len(library.encode(t or "", num_threads=1)), n > 4096) for d, t in rows), key=str)
    for part in (rows[:50], rows, rows):
        found = token_counts.token_counts(frame(spark, part), PIECES, path, broadcast_digests=broadcast_digests)
        if len(part) == len(rows):
            assert sorted(map(tuple, found.collect()), key=str) == expected
    stored = spark.read.parquet(f"{path}/{tokens.version(PIECES)}")
    assert stored.count() == len({t or "" for _, t in rows})  # later calls have encoded only what was new
    spark.createDataFrame(stored.limit(3).collect(), stored.schema).write.mode("append").parquet(f"{path}/{tokens.version(PIECES)}")
    assert token_counts.token_counts(frame(spark, rows), PIECES, path).count() == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 65535)), max_size=300))
def test_wavelet_matrix(ids):
    array = np.array(ids, np.uint16)
    docs, counts, m, end = wavelet.open_shard(wavelet.pack_shard(pa.array([3, None]), [len(ids), 0], array, 2))
    assert docs.to_pylist() == [3, None] and counts.tolist() == [len(ids), 0] and end == 2
    assert m.ids().tolist() == ids
    assert [m.access(i) for i in range(len(ids))] == ids
    for token in set(ids[:20]) | {0, 7, 70_000}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert m.rank(token) == len(places)
        assert m.rank(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in places)
        assert [m.select(token, k) for k in range(len(places))] == places
    with pytest.raises(IndexError):
        m.access(len(ids))
    with pytest.raises(IndexError):
        m.select(ids[0] if ids else 1, len(ids))


@pytest.mark.parametrize("shard_tokens", [1 << 20, 500])
def test_shards_hold_all_ids_in_order(spark, tmp_path, shard_tokens):
    rows, path = corpus(), str(tmp_path / "shards")
    wavelet.write_shards(frame(spark, rows).repartition(5), path, WORDS, shard_tokens=shard_tokens)
    found = wavelet.read_shards(spark, path)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ends"]
    encoded = [(d, library_ids(WORDS, t, 2)) for d, t in rows]
    encoded.sort(key=lambda x: (x[0] is None, x[0] or 0, crc(x[1])))
    expected, at = [], 0
    for d, ids in encoded:
        expected.append((d, at, len(ids), crc(ids), ids.count(2)))
        at += len(ids)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[1]) == expected
    shards = sorted(spark.read.parquet(path).collect(), key=lambda r: (r.part, r.seq))
    assert sum(wavelet.open_shard(s.shard)[2].rank(2) for s in shards) == sum(ids.count(2) for _, ids in encoded)
    token = Counter(x for _, ids in encoded for x in ids).most_common(3)[-1][0]
    places = [(d, [i for i, x in enumerate(ids) if x == token]) for d, ids in encoded if token in ids]
    assert sorted(((r.doc_id, r.places) for r in wavelet.occurrences(spark, path, token).collect()), key=str) == sorted(places, key=str)
    assert wavelet.occurrences(spark, path, 49_000).count() == sum(49_000 in ids for _, ids in encoded)


def test_frames_are_unpacked_when_they_are_read():
    ids = np.random.default_rng(3).integers(0, 40_000, 1_200_000).astype(np.uint16)
    _, _, m, _ = wavelet.open_shard(wavelet.pack_shard(pa.array(["a"]), [len(ids)], ids, 2))
    assert all(p.missing.all() and len(p.frames) == 5 for p in m.planes)
    at = np.array([0, 77, 100_000])
    assert m.accesses(at).tolist() == ids[at].tolist() and m.planes[0].missing.sum() == 4
    token = int(ids[500_000])
    places = np.flatnonzero(ids == token)
    assert m.selects(token, np.arange(len(places))).tolist() == places.tolist()
    ends = np.arange(0, len(ids) + 1, 99_991)
    assert m.ranks(token, ends).tolist() == [int((places < e).sum()) for e in ends]
    assert (m.ids() == ids).all()


def test_shards_keep_the_type_of_the_id(spark, tmp_path):
    rows = [("b", "two words"), (None, "x"), ("a", None)]
    wavelet.write_shards(spark.createDataFrame(rows, "doc_id string, text string"), str(tmp_path / "s"), WORDS)
    found = wavelet.read_shards(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [(r.doc_id, r.ids_crc32) for r in found] == [(d, crc(library_ids(WORDS, t, 2))) for d, t in [("a", None), ("b", "two words"), (None, "x")]]
