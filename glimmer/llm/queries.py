"""The thin queries of this subpackage: each applies one operator to its whole table and derives its digest."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import ann, conversation_trie, decontaminate, near_dedup, ngram_join, oracles, packing, pii, quality, spelling, substring_dedup, suffix_dedup, token_output, url_filters
from glimmer.llm.exchange import scratch_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", "p_junk", "p_toxic", "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_folder(spark, 'tokens')}/images"
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    out = token_output.read_tokens(spark, path)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pii.KINDS[:4]
    out = pii.find(_table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*base)))
    counts = [F.size(F.array_remove(F.expr("transform(base, s -> if(s.kind = '" + k + "', 1, 0))"), 0)).cast("long").alias(f"n_{k}") for k in base]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeated_bytes(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.word_counts(_table(spark, sf_dir, "documents"), every=31))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_groups(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first turns, crc32(c) % 6 of them, of the first conversation of its hundred."""
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"), lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6, most_head=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_token_output": op4_token_output,
    "op5_url_filters": op5_url_filters,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_pii": op7_pii,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ngram_join": op12_ngram_join,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.OP1,
    "op5_url_filters": oracles.OP5,
    "op6_nearest_neighbours": oracles.OP6,
    "op8_suffix_dedup": oracles.OP8,
    "op9_decontamination": oracles.OP9,
    "op10_near_dedup": oracles.OP10,
    "op11_spelling_variants": oracles.OP11,
    "op12_ngram_join": oracles.OP12,
    "op13_conversation_trie": oracles.OP13,
}
