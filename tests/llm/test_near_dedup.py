"""Near-duplicate groups against all pairs."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from glimmer.llm import near_dedup
from glimmer.llm.components import components

DOCS = "doc_id long, text string, id string, class int"


def shingles(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w,) for w in words}


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)
    return {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, **options).collect()}


def edited(words, rng, share):
    return " ".join(w if rng.random() > share else f"edit{rng.integers(10**9)}" for w in words)


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_are_those_of_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for size in (60, 9, 3):
        base = [f"w{rng.integers(500)}" for _ in range(120)]
        for share in np.linspace(0, 0.15, size):
            rows.append((n, edited(base, rng, share)))
            n += 1
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "a b"), (1006, "A  B"), (1007, "long " * 5000)]
    assert run(spark, rows, block=block) == groups(rows)


def test_null_ids_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(50))
    out = near_dedup.near_duplicates(spark.createDataFrame([(None, text), (7, text), (7, text), (9, text)], "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), r["component_id"], r["kept"]) for r in out) == [("7", 7, True), ("7", 7, True), ("9", 7, False), ("None", None, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[300:1300])
    registers = near_dedup.sketches(np.concatenate((a, b)), np.array([0, 1000, 2000]), 455)
    found = near_dedup.estimate(registers[:1], np.array([1000]), registers[1], 1000)[0]
    assert abs(found - 700 / 1300) < 0.1


def test_sketch_of_a_union_is_the_larger_register():
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 2**63, 90).astype(np.uint64))
    whole, left, right = (near_dedup.sketches(x, np.array([0, len(x)]), 64)[0] for x in (pool, pool[:50], pool[50:]))
    assert (whole == np.maximum(left, right)).all()


def test_words_are_split_at_ascii_space_only():
    hashes, bounds = near_dedup.shingle_sets(pa.array(["a b c", "A B  c", None]))
    assert bounds.tolist() == [0, 1, 2, 2] and hashes[0] == hashes[1]


def test_edges_and_facts_of_many_tasks_meet_in_no_single_target(spark):
    rng = np.random.default_rng(6)
    base = [f"w{rng.integers(500)}" for _ in range(80)]
    texts = spark.createDataFrame([(n, edited(base, rng, 0.03)) for n in range(320)], "id long, text string").repartition(8).selectExpr("*", "xxhash64(text) as mark")
    sent = near_dedup._sent(texts, 65, 7, 8).selectExpr("dst", "kind", "length(payload) as n")
    for kind in (near_dedup.DOCUMENT, near_dedup.EDGE):
        sizes = [r["n"] for r in sent.where(sent["kind"] == kind).groupBy("dst").sum("n").toDF("dst", "n").collect()]
        assert len(sizes) == 8 and max(sizes) < sum(sizes) / 2


def test_a_second_family_of_a_cluster_gives_a_spanning_set_of_links(spark):
    rng = np.random.default_rng(8)
    bases = [[f"w{rng.integers(10**6)}" for _ in range(80)] for _ in range(40)]
    rows = [(n, edited(bases[0 if n < 60 else 1], rng, 0.01) + f" end{n}") for n in range(100)] + [(100 + k, " ".join(b)) for k, b in enumerate(bases[2:])]
    hashes, bounds = near_dedup.shingle_sets(pa.array([t for _, t in rows]))
    names = near_dedup.class_of(hashes, bounds).tolist()
    texts = spark.createDataFrame(rows, "id long, text string")
    facts = spark.createDataFrame([(n, c, 80) for n, c in enumerate(names)], "id long, class long, n long").select("class", "id", "n")
    clusters = spark.createDataFrame([(c, min(names)) for c in names], "class long, cluster long")
    links = [(r["a"], r["b"]) for r in near_dedup._verified(texts, facts, clusters, 455, 80, 8).collect()]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(rows)
    assert {n: found.get(c, c) for n, c in enumerate(names)} == {n: min(c for k, c in enumerate(names) if want[k][1] == want[n][1]) for n in range(len(names))}
    assert len(links) < 5 * len(rows)


def test_the_pipeline_links_by_five_words(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(200)]
    changed = [f"edit{k}" if k % 25 == 12 else w for k, w in enumerate(words)]  # J is 0.85 on two words, 0.66 on five
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words) + " end")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()) == [1, 2]
    assert sorted(r["id"] for r in near_dedup.near_duplicates(docs).where("kept").collect()) == [1]


def test_all_ids_null_and_texts_of_one_id(spark):
    text = [" ".join(f"{c}{k}" for k in range(50)) for c in "abc"]
    none = spark.createDataFrame([(None, t) for t in text * 20], "doc_id long, text string")
    out = near_dedup.near_duplicates(none).collect()
    assert len(out) == 60 and all(r["id"] is None and r["kept"] and r["component_id"] is None for r in out)
    rows = spark.createDataFrame([(1, text[0]), (2, text[0] + " end"), (2, text[1]), (3, text[1] + " end"), (3, text[2]), (3, text[2] + " end")], "doc_id long, text string")
    found = near_dedup.near_duplicates(rows).join(rows.selectExpr("xxhash64(text) as mark", "text"), "mark").collect()
    kept = sorted((r["id"], r["text"]) for r in found if r["kept"])
    # of the two near texts of id 3 one stays
    assert kept[:2] == [(1, text[0]), (2, text[1])] and len(kept) == 3 and kept[2][1].startswith(text[2])
    assert {(r["id"], r["component_id"]) for r in found} == {(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)}


def test_more_outside_classes_than_a_block_holds(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for family in range(8):  # families of one cluster: half of the words are common to all
        common = [f"w{k}" for k in range(60)]
        own = [f"f{family}x{k}" for k in range(40)]
        for _ in range(9):
            rows.append((n, edited(common + own, rng, 0.02)))
            n += 1
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    found = near_dedup.near_duplicates(docs, block=4, bands=60, rows=2).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == groups(rows)
