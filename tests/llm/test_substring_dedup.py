"""Word- and byte-level removal of repeats, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from glimmer.llm import exchange, substring_dedup, suffix_dedup


def texts(seed, n=40):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words, 70))
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 120)))) for k in range(n)]
    rows += [(100 + k, t) for k, t in rows[:5]]  # copies
    rows += [(200 + k, f"a{k} b{k}  {passage}\n c{k}") for k in range(6)]  # one passage, other edges
    rows += [(300, None), (301, ""), (302, " \t "), (303, "x " * 400), (304, "é" * 900), (305, passage + " " + passage)]
    return rows


def without_word_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def without_byte_repeats(rows, length):
    raw = {i: (t or "").encode() for i, t in rows}
    times = Counter(b[s : s + length] for b in raw.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if times[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bucket int, id string")


@pytest.mark.parametrize("window", [20, 12])
def test_words(spark, window):
    rows = texts(1)
    found = substring_dedup.remove_repeats(frame(spark, rows), window=window).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in found} == without_word_repeats(rows, window)


@pytest.mark.parametrize(("length", "hot"), [(200, None), (56, None), (56, 2)])
def test_bytes(spark, length, hot):
    rows = texts(2)
    found = suffix_dedup.remove_repeated_bytes(frame(spark, rows), length=length, **({"hot_slices": hot} if hot else {})).collect()
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found}
    assert got == without_byte_repeats(rows, length)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(None, text), (5, text), (5, text), (5, "short")]
    words = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((str(r["id"]), r["n_removed"]) for r in words) == [("5", 0), ("5", 0), ("5", 30), ("None", 30)]
    assert all(r["n_removed"] == (r["n_bytes"] if r["n_bytes"] > 50 else 0) for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows), length=56).collect())
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0
    assert suffix_dedup.remove_repeated_bytes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [16, 20, 24, 56])
def test_merged_transforms_find_all_repeats(length):
    rng = np.random.default_rng(length)
    for turn in range(40):
        pieces = [bytes(rng.integers(97, 97 + 2 + turn % 5, rng.integers(1, 90)).astype(np.uint8)) for _ in range(6)]
        slices = [b"".join(pieces[k] for k in rng.integers(0, 6, rng.integers(1, 4))) for _ in range(rng.integers(1, 12))]
        owner = np.sort(rng.integers(0, 4, len(slices)))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in slices])))
        times = Counter(x[k : k + length] for x in slices for k in range(len(x) - length + 1))
        wanted = [a + k for a, x in zip(bounds.tolist(), slices) for k in range(len(x) - length + 1) if times[x[k : k + length]] > 1]
        found = suffix_dedup.repeated_starts(np.frombuffer(b"".join(slices), np.uint8), bounds, owner, length)
        assert np.flatnonzero(found).tolist() == wanted


def test_a_transform_is_its_shards_suffixes_in_order():
    raw = np.frombuffer(b"abcdefghijklmnopqrstuvwx" + b"Xbcdefghijklmnopqrstuvw" + b"zzzzzzzzzzzzzzzzzzzzz", np.uint8)
    bounds, length = np.array([0, 24, 47, 68]), 20
    for owner in (np.zeros(3, int), np.arange(3)):
        shards = suffix_dedup.Transforms(raw, bounds, owner, length)
        for k in np.unique(owner):
            own = shards.order[shards.shard[shards.order] == k]
            texts = [raw.tobytes()[p : p + min(length, shards.left[p])] for p in own.tolist()]
            full = [t for t in texts if len(t) == length]
            assert full == sorted(full)
        found = suffix_dedup.repeated_starts(raw, bounds, owner, length)
        assert np.flatnonzero(found).tolist() == [1, 2, 3, 25, 26, 27, 47, 48]


def test_all_ids_null_or_one_id(spark):
    rows = [(k, t) for k, t in texts(3) if t]
    for ids in ([None] * len(rows), [7] * len(rows), [None, 7, 8] * len(rows)):
        same = [(i, t) for i, (_, t) in zip(ids, rows)]
        found = suffix_dedup.remove_repeated_bytes(frame(spark, same), length=56).collect()
        wanted = without_byte_repeats(rows, 56)
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in found) == sorted(x[:3] for x in wanted.values())
        words = substring_dedup.remove_repeats(frame(spark, same)).collect()
        assert len(words) == len(rows) and sum(r["n_words"] - r["n_removed"] for r in words) > 0
        spread = frame(spark, same).selectExpr("cast(doc_id as long) as id", "text")
        used = spread.select(exchange.range_bucket(spread, "id", "text", 12).alias("b")).distinct().count()
        assert used >= 6


def test_buckets_follow_bytes(spark):
    rows = frame(spark, [(k, "word " * 200) for k in range(64)])
    assert exchange.bucketed(rows, "doc_id", "text", 2, 4000).select("bucket").distinct().count() >= 12
    assert exchange.bucketed(rows, "doc_id", "text", 2, 1 << 20).select("bucket").distinct().count() == 2


def test_each_alignment_shares_an_anchor():
    for period, cover in substring_dedup.COVERS.items():
        for a in range(period):
            for b in range(period):
                assert any((a + k) % period in cover and (b + k) % period in cover for k in range(period))
