"""The pipeline against its stages in plain Python, stage by stage."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def lowered_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Rows before and after every stage."""
    folder, docs = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumns({"row": F.lit(1), "statistics": F.lit(2), "k1": F.lit(3)})
    tables = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        tables.append(docs.collect())
    return tables


def by_id(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns_stay(stages):
    assert all(t[0].asDict().keys() == stages[0][0].asDict().keys() for t in stages[:-1])


def test_quality(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) <= {d for d, t in before.items() if not brute.quality(t)[5]} and len(after) > 0.7 * len(before)


def test_near_copies(stages):
    parts = brute.near_components(list(by_id(stages[1]).items()))
    assert set(by_id(stages[2])) == {d for d, (_, c) in parts.items() if d == c}


def test_repeated_strings(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    for (d, text), (_, removed, _, _) in zip(before.items(), brute.repeated_bytes(list(before.values())), strict=True):
        assert (after[d] == text) if not removed else len(after[d].encode()) <= len(text.encode()) - removed


def test_benchmark_free(spark, sf_dir, stages):
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = lowered_words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}

    def hit(text):
        w = lowered_words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    before = by_id(stages[3])
    assert set(by_id(stages[4])) == {d for d, t in before.items() if not hit(t)}


def test_token_ids(stages):
    encoding, texts = brute.rank_encoding(), by_id(stages[4])
    assert {r.doc_id: list(r.token_ids) for r in stages[5]} == {d: encoding.encode_ordinary(t or "") for d, t in texts.items()}
    assert all(r.exact for r in stages[5])


def test_empty_and_repeated_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    twice = docs.where("doc_id < 5").unionByName(docs.where("doc_id < 5"))
    assert corpus_pipeline.near_copies(spark, twice, sf_dir).count() == corpus_pipeline.near_copies(spark, docs.where("doc_id < 5"), sf_dir).count()
