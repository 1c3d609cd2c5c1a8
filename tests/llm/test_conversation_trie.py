"""The prefix trie against one built from rebuilt turns."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.llm import conversation_trie, queries

TURNS = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(str(c) for c in sorted(c for c in who if rebuilt[c] == node))
        out[(min(who), len(node))] = (
            min(members[node[:-1]]) if node else None, len(who), sum(len(m) == len(node) + 1 for m in below), sum(leaf(n) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def run(spark, rows):
    turns = spark.createDataFrame([(*r, 1) for r in rows], TURNS)
    found = conversation_trie.prefix_trie(turns, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, most_head=5).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_is_that_of_rebuilt_turns(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*rng.choice(900, 60, replace=False).tolist(), 100, 200, -5, -120]:
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, "user" if turn % 2 else "system", f"été{rng.integers(3)}"))
    rng.shuffle(rows)
    rows = [(int(c), int(t), r, x) for c, t, r, x in rows]
    assert run(spark, rows) == brute(rows)


def test_pieces_of_one_long_conversation(spark):
    rows = [(7, k, "user", f"t{k % 5}") for k in range(30_000)] + [(8, k, "user", f"t{k % 5}") for k in range(3)]
    scanned = conversation_trie._own_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    got = {(r["conv"], r["k"]): tuple(r[x] for x in conversation_trie._X) for r in scanned.collect()}
    ref = lambda text: np.frombuffer(hashlib.sha256(f"4:user{text}".encode()).digest(), "<u8")
    wanted = [0] * len(conversation_trie.BASES)
    for k in range(30_000):
        wanted = [(w + int(ref(f"t{k % 5}")[j]) * pow(b, k, conversation_trie.PRIME)) % conversation_trie.PRIME for j, (w, b) in enumerate(zip(wanted, conversation_trie.BASES, strict=True))]
        assert got[(7, k + 1)] == tuple(wanted)
        if k < 3:
            assert got[(8, k + 1)] == tuple(wanted)
    assert len(got) == 30_003


def test_batches_go_on(spark):
    rng = np.random.default_rng(1)
    conv = np.sort(rng.integers(0, 4, 50))
    chars, refs = rng.integers(0, 9, 50), rng.integers(0, 2**63, (50, 4)).astype(np.uint64)
    whole = conversation_trie._Run().add(conv, chars, refs)
    run = conversation_trie._Run()
    parts = [run.add(conv[a:b], chars[a:b], refs[a:b]) for a, b in ((0, 7), (7, 8), (8, 33), (33, 50))]
    for k, column in enumerate(whole):
        assert (np.concatenate([p[k] for p in parts]) == column).all()


def test_nulls_ties_repeats_and_empty(spark):
    long = "lang " * 50_000
    rows = [(100, 1, None, None), (100, None, "user", "a"), (100, 1, "user", long), (100, 1, "user", long), (101, 0, "user", "a"), (101, 1, "", ""), (102, 0, "user", "a"), (203, 0, "user", "x")]
    assert run(spark, [*rows, (None, 0, "user", "a")]) == brute(rows)
    assert run(spark, []) == {}


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "same" if t < 2 else f"{c % 3}") for c in range(300) for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_query(spark):
    assert queries.op13_conversation_trie(spark, "/root/testdata/sf0.001").where("depth = 0").count() == 1
