"""Registered queries of the subpackage: name -> (spark, folder of the tables) -> result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import (
    byte_bpe, decontamination, exact_dedup, language_id, near_dedup, prefix_trie, quality_rules, sharding, substring_dedup,
    token_alignment, token_files, url_filter, warc,
)
from floodspark.llm.common import scratch, staged, text_or_empty

RULES = (
    url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)
TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    s = quality_rules.judge(docs, rules).select("doc_id", "statistics.*")
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), added_tokens=True)
    return token_files.read_tokens(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("repeats"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    both = docs.select("doc_id", byte_bpe.round_trip(F.col("text"), path, pattern).alias("both"))
    return both.select("doc_id", "both.*").select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    model = language_id.fit(docs.where(remainder != 2))
    return docs.select("doc_id", held_out.alias("held_out"), model.predicted(F.col("text")).alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(8), sharding.even_tree(9))
    rows = staged(placed, scratch(spark), "placed")
    return sharding.numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages")))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(turns))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules, "op2_token_files": op2_token_files,
    "op3_suffix_array_dedup": op3_suffix_array_dedup, "op4_byte_bpe": op4_byte_bpe, "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id, "op7_sharding": op7_sharding, "op8_near_dedup": op8_near_dedup,
    "op9_decontamination": op9_decontamination, "op10_warc": op10_warc,
    "op11_token_alignment": op11_token_alignment, "op12_prefix_trie": op12_prefix_trie, "op13_exact_dedup": op13_exact_dedup,
}
