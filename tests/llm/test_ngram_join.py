"""The n-gram similarity join against all pairs."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from glimmer.llm import near_dedup, ngram_join, queries

DOCS = "doc_id long, text string, id string, class int"


def shingles(text, k=4):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def groups(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    found = ngram_join.ngram_groups(docs, **options).collect()
    assert len(found) == len(rows)
    return {r["id"]: (r["n_shingles"], r["component_id"]) for r in found}


def edited(words, rng, share):
    return " ".join(w if rng.random() > share else f"edit{rng.integers(10**9)}" for w in words)


def families(rng, sizes, words=120, pool=500, most=0.08):
    rows = []
    for size in sizes:
        base = [f"w{rng.integers(pool)}" for _ in range(words)]
        rows += [edited(base, rng, share) for share in np.linspace(0, most, size)]
    return list(enumerate(rows))


@pytest.mark.parametrize(("block", "buckets"), [(1024, 1), (16, 7)])
def test_groups_are_those_of_all_pairs(spark, block, buckets):
    rows = families(np.random.default_rng(5), (60, 9, 3))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "a b c"), (1006, "A  B C"), (1007, "long " * 5000), (1008, "a b c d"), (1009, "a b c d e")]
    assert run(spark, rows, block=block, buckets=buckets) == groups(rows)


def test_few_words_make_common_prefixes(spark):
    rng = np.random.default_rng(7)
    rows = [(n, " ".join(rng.choice(["a", "b", "c"], int(rng.integers(4, 60))))) for n in range(150)]
    rows += [(200 + n, "the same line again and again " * 4 + f"end{n // 2} x{n % 2}") for n in range(60)]
    assert run(spark, rows, block=8) == groups(rows)


def test_links_at_the_threshold_and_just_below(spark):
    """17 of 20 shingles in common is a link, 16 of 19 isn't."""
    base = [f"w{k}" for k in range(40)]
    rows = []
    for n in range(21, 34):
        rows += [(10 * n, " ".join(base[:n])), (10 * n + 1, " ".join(base[: n - 3])), (10 * n + 2, " ".join(base[3:n]))]
    assert run(spark, rows) == groups(rows)


@pytest.mark.parametrize("seed", range(4))
def test_filters_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    texts = [t for _, t in families(rng, (12, 12, 6), words=60, pool=40, most=0.15)]
    hashes, bounds = near_dedup.shingle_sets(pa.array(texts), 4)
    block = ngram_join.PrefixBlock(near_dedup.class_of(hashes, bounds), hashes, bounds, 0, 85)
    everyone = np.arange(len(texts))
    for d in range(len(texts)):
        items = set(block.items(d).tolist())
        want = {e for e in range(len(texts)) if 100 * len(items & set(block.items(e).tolist())) >= 85 * len(items | set(block.items(e).tolist()))}
        assert set(block.linked_with(everyone, block, d).tolist()) == want
        assert want <= set(block.holders(block.items(d)).tolist())


def test_prefix_edges_connect_sizes_a_link_allows(spark):
    entries = spark.createDataFrame([(1, c, n) for c, n in ((10, 17), (11, 20), (12, 100), (13, 117), (14, 400))] + [(2, 14, 400), (2, 12, 100)], "gram long, class long, n long")
    edges = {tuple(r) for r in ngram_join.prefix_edges(entries, 85).collect()}
    assert (11, 10) in edges and (13, 12) in edges and not any(14 in e for e in edges)


def test_rarity_never_falls():
    counts = np.unique(np.concatenate((np.arange(1, 3000), 2 ** np.arange(12, 40))))
    codes = ngram_join.rarity(counts)
    assert (np.diff(codes.astype(int)) >= 0).all() and codes[0] == 1 and (codes[counts > 1] > 1).all()


def test_copies_texts_of_one_id_null_ids_and_empty(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    rows = [(7, " ".join(base))] * 30 + [(8, " ".join(base[:k] + ["edit"] + base[k + 1 :])) for k in rng.choice(200, 25, replace=False)] + [(None, " ".join(base))] + [(9, "another text of its own " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_groups(docs).collect()
    assert len(found) == len(rows)
    linked = {r["component_id"] for r in found if r["id"] in (7, 8)}
    assert linked == {7} and [r["component_id"] for r in found if r["id"] in (None, 9)].count(9) == 1
    assert ngram_join.ngram_groups(docs.limit(0)).count() == 0


def test_held_texts_are_as_many_as_classes(spark):
    """Texts of one id, and rows that repeat both, are joined with their own class alone."""
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(1, edited(base, rng, 0.02) + f" end{k}") for k in range(2000)] + [(1, " ".join(base))] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, words=1)
    assert found.count() == len(rows) and {r["component_id"] for r in found.collect()} == {1}


def test_query(spark):
    assert queries.op12_ngram_join(spark, "/root/testdata/sf0.001").where("doc_id <> component_id").count() > 0


def test_an_exchanged_shingle_takes_four_bytes_and_a_prefix_entry_thirty_two(spark):
    """Eight and, in a row of five longs, 52 before; a shingle held by one set alone isn't sent on."""
    rows = families(np.random.default_rng(11), (5,) * 40, words=300, pool=10**6)
    table = pa.table({"id": [i for i, _ in rows], "text": [t for _, t in rows], "mark": [i for i, _ in rows]})
    sets, targets = ngram_join._Sets(table, 4), 5
    blocks = sets.blocks(3, targets)
    n, pairs = len(sets.distinct), int((sets.counts > 1).sum())
    assert sum(len(b) for b in blocks["payload"].to_pylist()) == 4 * n + 8 * pairs + 8 * blocks.num_rows
    answers = ngram_join._answered(blocks)
    codes = np.frombuffer(b"".join(answers["codes"].to_pylist()), np.uint8)
    assert (codes >= ngram_join.rarity(sets.counts)).all() and (codes == ngram_join.rarity(sets.counts)).mean() > 0.999
    packed = sets.prefixes(codes, 85, 3, targets)
    sent = sum(len(p) for k, p in zip(packed["kind"].to_pylist(), packed["payload"].to_pylist(), strict=True) if k != near_dedup.DOCUMENT)
    assert 0 < sent <= 32 * int(ngram_join.needed(sets.sizes, 85).sum())


@pytest.mark.parametrize("targets", [1, 2, 3, 51, 64, 3001])
def test_short_hashes_fit_and_keep_the_order(targets):
    hashes = np.unique(np.concatenate((np.random.default_rng(1).integers(0, 2**64, 4000, np.uint64), np.array([0, 2**64 - 1], np.uint64))))
    edges = near_dedup.target_edges(hashes, targets)
    for t in range(targets):
        part = hashes[edges[t] : edges[t + 1]]
        exact = [(int(h) - (t << 64) // targets) >> (32 - (targets.bit_length() - 1)) for h in part.tolist()]
        assert ngram_join.short_hashes(part, t, targets).tolist() == exact and all(0 <= e < 2**32 for e in exact)


def test_shingles_that_agree_in_their_short_hashes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "short_hashes", lambda h, t, n: (h >> np.uint64(54)).astype("<u4"))
    rows = families(np.random.default_rng(5), (20, 9, 3))
    assert run(spark, rows, buckets=3) == groups(rows)
