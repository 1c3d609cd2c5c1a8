"""Cached tokenization, packing and bit-packed files, against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glimmer.llm import packing, token_output, vocabulary
from glimmer.llm.vocabulary import Encoder

ROWS = [(3, "The cat. It's 12!\nOn"), (1, None), (2, ""), (9, "  two  spaces\n\nand\ttabs "), (5, "word " * 9000), (4, "<|endoftext|> ünïcode 日本  x"), (5, "same id"), (None, "no id")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "shard", 0) for i, t in rows], "doc_id long, text string, shard string, ids int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name):
    path = public_tokenizers.path(name)
    plain, cached = Tokenizer.from_file(path), Encoder(path)
    rng = np.random.default_rng(4)
    long = "wordsofmorethansixteenletters"
    parts = ["a", long, long.upper(), "Σ", "αΣ", "“", "(", "_", " ab", " cd,", "Don't", "'s", " ", "  ", "\n", "\t", ".", " foo", "é", "́", " ", "<|endoftext|>", "12", "x.y", "...", "　", "\r\n", "Ünï.", "\x1c", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 9))) for _ in range(6000)]
    for end in (None, 2, 70_000):
        ids, offsets = cached.encode_batch(pa.array([*texts, None]), end)
        assert len(ids) == offsets[-1] and offsets[-1] - offsets[-2] == (end is not None)
        for k, text in enumerate(texts):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids + [end] * (end is not None), text
    found, _ = cached.encode_batch(pa.array(texts[:50]).slice(7, 9))
    assert found.tobytes() == b"".join(cached.encode(t) for t in texts[7:16])


def test_a_hash_that_coincides_changes_no_ids(monkeypatch):
    monkeypatch.setattr(vocabulary, "mix", lambda h: h * np.uint64(0) + np.uint64(7))
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, cached = Tokenizer.from_file(path), Encoder(path)
    texts = ["one two", "three", "one more, and more"]
    ids, offsets = cached.encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [plain.encode(t).ids for t in texts]


def test_the_table_starts_anew(monkeypatch):
    monkeypatch.setattr(vocabulary, "CACHE_PIECES", 20)
    monkeypatch.setattr(vocabulary, "PORTION", 64)
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, cached = Tokenizer.from_file(path), Encoder(path)
    texts = [f"piece{k} of number {k}" for k in range(60)]
    ids, offsets = cached.encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [plain.encode(t).ids for t in texts]


@pytest.mark.parametrize("image_ids", [token_output.IMAGE, 40])
def test_files_round_trip(spark, tmp_path, image_ids):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_output.write_tokens(frame(spark), str(tmp_path / "t"), path, end_id=0, image_ids=image_ids)
    found = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    plain, at, wanted = Tokenizer.from_file(path), 0, []
    for i, t in [(r["doc_id"], r["text"]) for r in frame(spark).selectExpr("*", "xxhash64(text) as h").orderBy(F.col("doc_id").asc_nulls_last(), "h").collect()]:
        raw = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        wanted.append((i, at, len(raw) // 4, raw))
        at += len(raw) // 4
    assert sorted((r["start"], r["id"], r["n_tokens"], bytes(r["ids"])) for r in found) == [(a, i, n, raw) for i, a, n, raw in wanted]


def test_all_ids_null_or_one_id(spark, tmp_path):
    rows = [(None, f"text {k % 40}") for k in range(120)] + [(8, f"other {k}") for k in range(80)]
    token_output.write_tokens(frame(spark, rows), str(tmp_path / "n"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, parts=4)
    found = sorted((r["start"], str(r["id"]), r["n_tokens"]) for r in token_output.read_tokens(spark, str(tmp_path / "n")).collect())
    assert [i for _, i, _ in found] == ["8"] * 80 + ["None"] * 120
    assert [a for a, _, _ in found] == [0, *np.cumsum([n for _, _, n in found])[:-1].tolist()]
    parts = spark.read.parquet(str(tmp_path / "n")).groupBy("part").sum("n_docs").toDF("part", "n").collect()
    assert len(parts) == 4 and max(r["n"] for r in parts) < 120


def test_empty_table(spark, tmp_path):
    token_output.write_tokens(frame(spark, []), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    assert token_output.read_tokens(spark, str(tmp_path / "e")).count() == 0
    assert packing.pack(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"), end_id=2).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 11, 16, 17])
def test_random_access(bits):
    rng = np.random.default_rng(bits)
    ids, counts = rng.integers(0, 1 << bits, 9001), np.array([1, 0, 5000, 4000])
    shard = token_output.ShardReader(token_output.build_shard(np.array([4, 5, 6, 9]), counts, ids, bits))
    assert (shard.read(0, 9001) == ids).all() and (shard.read(4090, 4100) == ids[4090:4100]).all()
    assert (shard.document(2) == ids[1:5001]).all() and len(shard.document(1)) == 0


def test_packing_covers_each_id_once_without_padding(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = packing.pack(frame(spark), path, end_id=2).collect()
    plain = Tokenizer.from_file(path)
    wanted = sorted((i, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in ROWS if i not in (5, None))
    whole = {}
    for r in sorted(found, key=lambda r: r["start"]):
        if r["id"] not in (5, None):
            whole[r["id"]] = whole.get(r["id"], b"") + bytes(r["ids"])
    assert sorted((i, zlib.crc32(b)) for i, b in whole.items()) == wanted
    sequences = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sequences.values())


def test_costs_are_balanced():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 3000, 400).tolist()
    cost = {}
    for _, _, n, q, _ in packing.assign(lengths, 4096, 1.0, 1 / 2048):
        cost[q] = cost.get(q, 0) + n + n * n / 2048
    full = sorted(cost.values())[8:]
    assert max(full) < 1.35 * np.mean(full)


def test_a_document_is_cut_only_where_no_sequence_has_room_for_it():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 90, 60).tolist()
        pieces = packing.assign(lengths, 100, 1.0, 1 / 50).tolist()
        size = {}
        for _, _, n, q, _ in pieces:
            size[q] = size.get(q, 0) + n
        room, cost, wanted = dict(size), dict.fromkeys(size, 0.0), []
        for n, doc in sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
            start = 0
            while n:
                q = min((q for q in room if room[q] >= n), key=lambda q: (cost[q], q), default=None)
                q = min((q for q in room if room[q]), key=lambda q: (cost[q], q)) if q is None else q
                take = min(n, room[q])
                wanted.append([doc, start, take, q, size[q] - room[q]])
                room[q], cost[q], n, start = room[q] - take, cost[q] + take + take * take / 50, n - take, start + take
        assert pieces == wanted and sum(n for _, _, n, _, _ in pieces) == sum(lengths)
