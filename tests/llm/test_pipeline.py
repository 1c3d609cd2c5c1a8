"""The five stages on small tables, each against brute force, and with awkward rows."""

import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, mark string, kept int, hit string"
LABELS = "doc_id long, quality int, toxic int, id int, junk int"
BENCH = "item_id long, text string, id int, items string"
STAGES = dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", 1, "m", 0, "h") for i, t, lang, source in rows], DOCS)


def corpus():
    """Clean and junk documents, copies, near copies, benchmark passages and personal data; rows without id or text."""
    rng = np.random.default_rng(11)
    vocabulary = [f"word{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = " ".join(f"item{k}" for k in range(16))
    rows, labels = [], []
    for k in range(240):
        junk = k % 6 == 0
        rows.append((k, "BUY!! NOW!! $$$ " * 12 if junk and k % 12 else text(60).upper() + " !!!" if junk else text(int(rng.integers(20, 120))), "en", f"s{k % 3}"))
        labels.append((k, 0 if junk else 1, 0, 0, 0))
    rows += [(300, rows[7][1], "en", "s1"), (301, rows[7][1] + " end", "en", "s1"), (302, f"{text(30)} {passage} {text(30)}", "en", "s0"), (303, f"write to ab@cd.org and {text(40)}", "en", "s2")]
    rows += [(None, text(50), "en", "s0"), (None, None, None, None), (304, None, "en", "s0"), (305, "", "en", "s0"), (303, rows[-1][1], "en", "s2"), (306, text(9000), "en", "s1")]
    return rows, labels, [(1, passage, 0, "q"), (2, None, 0, "q"), (None, "word1", 0, "q")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels, items = corpus()
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def without_near_copies(rows):
    """Of each group the text with the smallest id; rows without id, and one of rows that repeat, stay."""
    named = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], str(r[1])))
    sets, label = [shingles(t) for _, t in named], list(range(len(named)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(range(len(named)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label[max(root(a), root(b))] = min(root(a), root(b))
    return sorted([r for r in rows if r[0] is None] + [r for k, r in enumerate(named) if root(k) == k], key=str)


def test_quality_keeps_clean_rows_and_rejects_junk(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = STAGES["quality classifier"](spark, docs, tables)
    assert out.columns == docs.columns
    left = rows_of(out)
    rows = [(i, t) for i, t, _, _ in corpus()[0]]
    assert not [r for r in left if r[0] is not None and r[0] < 240 and r[0] % 6 == 0]
    assert left == sorted([r for r in rows if r[0] is None or r[0] >= 240 or r[0] % 6], key=str)


def test_near_dedup_is_that_of_all_pairs(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("coalesce(doc_id, 1) % 6 > 0 or doc_id >= 300")
    assert rows_of(STAGES["near-dedup"](spark, docs, tables)) == without_near_copies(rows_of(docs))


@pytest.mark.parametrize("rows", [[(3, "A"), (7, "A"), (7, "B")], [(3, "A"), (3, "B"), (7, "B"), (7, "B")], [(5, "A"), (5, "A"), (5, "A end"), (None, "A"), (None, "A"), (8, None), (8, None), (9, "")]])
def test_near_dedup_drops_rows_not_ids(spark, rows):
    long = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "AB"}
    full = [(i, t if not t else long[t[0]] + t[1:]) for i, t in rows]
    out = STAGES["near-dedup"](spark, frame(spark, [(i, t, "en", "s") for i, t in full]), "")
    found, wanted = rows_of(out), without_near_copies(full)
    assert len(found) == len(wanted) and [i for i, _ in found] == [i for i, _ in wanted]
    assert [(i, (t or "")[:3]) for i, t in found] == [(i, (t or "")[:3]) for i, t in wanted]


def test_decontamination_drops_passages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = STAGES["decontamination"](spark, docs, tables)
    assert out.columns == docs.columns and rows_of(out) == sorted([(i, t) for i, t, _, _ in corpus()[0] if i != 302], key=str)


def test_pii_replaces_what_it_finds(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = STAGES["pii"](spark, docs, tables)
    assert out.columns == docs.columns and out.where("n_chars <> length(text) or (text is null) <> (n_chars is null)").count() == 0
    assert rows_of(out) == sorted([(i, t and t.replace("ab@cd.org", "[EMAIL]")) for i, t, _, _ in corpus()[0]], key=str)


def test_packing_holds_every_id_once(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    pieces = STAGES["packing"](spark, docs, tables).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, fill = {}, {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        if r["doc_id"] not in (None, 303):
            found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["ids"])
    assert {i: zlib.crc32(b) for i, b in found.items()} == {i: zlib.crc32(np.array([*plain.encode(t or "").ids, 2], "<u4").tobytes()) for i, t, _, _ in corpus()[0] if i not in (None, 303)}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in fill.values())


def test_run_is_the_stages_one_after_another(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    whole = corpus_pipeline.run(spark, tables)
    assert whole.columns == docs.columns
    key = lambda df: sorted(((r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in df.where(F.col("start") == 0).select("doc_id", "start", "doc_tokens", "ids", "length").collect()), key=str)
    ids = lambda df: sorted(((r["doc_id"], r["doc_tokens"]) for r in df.where(F.col("start") == 0).collect()), key=str)
    assert ids(whole) == ids(docs) and len(key(whole)) == len(ids(docs))


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", BENCH)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = frame(spark, [(1, "one text", "en", "s"), (None, None, None, None)])
    rows.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["1", "None"]
