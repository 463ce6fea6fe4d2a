"""A training-data pipeline: quality, near copies, repeated strings, benchmark passages, token ids.

STAGES lists (name, function); every function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and reread as the next one's docs. All but the last return the columns of documents.
Extra columns of documents are handed on.

Edge cases: a NULL text fails the quality stage; a text of which nothing or only parts of characters is left
becomes an empty or shorter one and stays; rows that agree in id and text are one document, of which the
near-copy stage keeps one row; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import byte_bpe, decontamination, near_dedup, quality_rules, substring_dedup
from floodspark.llm.common import row_keys, scratch, staged, text_or_empty


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return quality_rules.judge(packed, rules).where("statistics.kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    k1, k2 = row_keys()
    kept = near_dedup.near_duplicates(docs).where("kept").select("k1", "k2").distinct()
    packed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    return packed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")


def _readable(data: Column) -> Column:
    """Text of UTF-8 bytes; what a cut left of a character goes."""
    @F.arrow_udf("string")
    def decode(cells: pa.Array) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in cells.to_pylist()], pa.string())

    return decode(data)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that stand elsewhere too."""
    found = substring_dedup.deduplicated(docs).select(
        "row", F.when(F.size("spans") == 0, F.col("text")).otherwise(_readable(F.col("kept"))).alias("text")
    )
    own = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")}
    return found.select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = staged(decontamination.contaminated(docs, items).select("k1", "k2"), scratch(spark), "hit")
    k1, k2 = row_keys()
    packed = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct("*").alias("row"))
    return packed.join(hit, ["k1", "k2"], "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact): ids of every text, and whether they decode to it."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    both = texts.withColumn("both", byte_bpe.round_trip(F.col("text"), path, pattern)).select("doc_id", "text", "both.*")
    exact = F.col("data") == F.col("text").cast("binary")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.col("ids").alias("token_ids"), exact.alias("exact"))


STAGES = [
    ("quality_rules", quality), ("near_dedup", near_copies), ("suffix_array_dedup", repeated_strings),
    ("decontamination", benchmark_free), ("byte_bpe", token_ids),
]

#: The learned list and the byte-level encoding have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the table that the one before wrote."""
    folder = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
