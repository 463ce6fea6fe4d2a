"""Cross-tokenizer alignment, the prefix trie and exact duplicates against plain Python, and on their edge cases."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from floodspark.llm import exact_dedup, prefix_trie, token_alignment
from floodspark.llm.queries import QUERIES
from tests.llm import brute

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, block int, pairs string, row int, data int, `group` int"
TEXTS = [
    None, "", " ", "  two  blanks ", "plain words, twice: plain words", "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "x▁ y ▁▁",
    "日本語の文 \U0001f600\U0001f9d1‍\U0001f680 İ̇", "tab\tand\r\nmore 　wide\x00 nul \x1c fs", "don't 12345 3.14 __init__", "x" * 5000,
    "".join(chr(97 + i * i % 26) for i in range(4000)), "\n\n\n  \n " * 40, "word " * 3000, "é" * 600, "    ﻿",
]
CONV = "conv_id bigint, turn bigint, role string, text string, name string, depth int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "p", 2, 3, 4) for i, t in rows], SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- alignment ---------------------------------------------------------------------------------------


def alignment_rows(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_alignment_of_the_test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert alignment_rows(QUERIES["op11_token_alignment"](spark, sf_dir)) == brute.alignment(rows)


@pytest.mark.parametrize("block, memory", [(4 << 20, 48 << 20), (64, 0)])
def test_alignment_of_edge_cases(spark, monkeypatch, block, memory):
    """Also with blocks of one document and a table of chunks that is emptied each time; columns with clashing names."""
    monkeypatch.setattr(token_alignment, "BLOCK", block)
    monkeypatch.setattr(token_alignment, "MEMORY", memory)
    rows = list(enumerate([*TEXTS, *TEXTS]))
    found = alignment_rows(token_alignment.alignment(docs_of(spark, rows), *PATHS))
    assert found == brute.alignment(rows)
    assert found[0] == found[1] == found[6] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment(docs_of(spark, []), *PATHS).collect() == []
    assert alignment_rows(token_alignment.alignment(docs_of(spark, [(None, None)]), *PATHS)) == {None: (0, 0, 0, 0, 0, 0, "")}


def test_coalescing_breaks_where_a_start_reaches_the_running_maximum():
    starts, ends = np.array([0, 4, 6, 0, 2, 6]), np.array([4, 6, 9, 2, 6, 9])
    order, group = token_alignment.coalesced(starts, ends)
    assert dict(zip(order.tolist(), group.tolist(), strict=True)) == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


# --- prefix trie -------------------------------------------------------------------------------------


def test_trie_of_the_test_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert as_rows(QUERIES["op12_prefix_trie"](spark, sf_dir)) == brute.trie(brute.rebuilt(rows))


def lists(spark, conversations):
    rows = [(c, i, role, text, "x", 1) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    return prefix_trie.turn_lists(spark.createDataFrame(rows, CONV))


@pytest.mark.parametrize("seed", range(3))
def test_trie_in_many_batches(spark, monkeypatch, seed):
    """Deep chains, branches at every depth, one prefix of most conversations, and many equal conversations."""
    monkeypatch.setattr(prefix_trie, "FIRST_BATCH", 2)
    monkeypatch.setattr(prefix_trie, "GROWTH", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    draw = random.Random(seed)
    chain = [("user", f"t{i}") for i in range(40)]
    conversations = {}
    for c in range(120):
        kind = draw.randrange(4)
        if kind == 0:
            turns = chain[: draw.randrange(1, 41)]
        elif kind == 1:
            turns = chain[: draw.randrange(0, 40)] + [("user", f"own {draw.randrange(3)}")] * draw.randrange(1, 3)
        elif kind == 2:
            turns = [("user", "hello"), ("assistant", "été")]
        else:
            turns = [(draw.choice("ua"), draw.choice("xyz")) for _ in range(draw.randrange(1, 6))]
        conversations[c * 7 % 1001] = turns
    assert as_rows(prefix_trie.trie_nodes(lists(spark, conversations))) == brute.trie(conversations)


def test_trie_edge_cases(spark):
    """NULL turns come first, NULL roles and texts are empty, a conversation without an id is none, one may have no turns."""
    rows = [
        (5, 1, "user", "b"), (5, None, None, "a"), (6, 2, "user", None), (7, 0, "user", "x" * 100_000), (None, 0, "user", "none"),
        (9, 0, "user", "q"), (23, 0, "user", "short"), (8, 3, "user", "b"), (8, 1, None, "a"),
    ]
    source = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV)
    own = brute.rebuilt(rows)
    assert [] in own.values()
    assert as_rows(prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.turn_lists(source)))) == brute.trie(own)
    empty = spark.createDataFrame([], CONV)
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.turn_lists(empty))).collect() == []


def test_repeated_turn_rows_stay(spark):
    source = spark.createDataFrame([(1, 0, "user", "a", "x", 1)] * 2 + [(1, 0, "user", "b", "x", 1)], CONV)
    assert prefix_trie.trie_nodes(prefix_trie.turn_lists(source)).count() == 4


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(70) for b in range(a + 1, 71)]
    found = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f"))
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in found.collect())


# --- exact duplicates --------------------------------------------------------------------------------


def test_copies_of_the_test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_rows(QUERIES["op13_exact_dedup"](spark, sf_dir)) == sorted(brute.copies(rows), key=str)


def test_copies_in_many_rounds(spark, monkeypatch):
    """Texts that end inside, at and after the bytes of a round, equal up to their last byte, or one the start of another."""
    monkeypatch.setattr(exact_dedup, "FIRST_WIDTH", 2)
    monkeypatch.setattr(exact_dedup, "WIDENING", 2)
    draw = random.Random(13)
    texts = ["ab" * n for n in range(1, 20)] * 2 + ["ab" * 60 + x for x in "xyzx"] + ["".join(draw.choices("ab é", k=draw.randrange(9))) for _ in range(120)]
    rows = list(enumerate([*TEXTS, *texts, *TEXTS, " a", "a", "a ", "\ta\n", "a "]))
    assert as_rows(exact_dedup.exact_duplicates(docs_of(spark, rows))) == sorted(brute.copies(rows), key=str)


def test_copies_without_ids_and_repeated_rows(spark):
    found = exact_dedup.exact_duplicates(docs_of(spark, [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (None, "c")]))
    rows = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)
    assert rows == sorted([
        (None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, False), (None, None, 2, True), (None, None, 2, False), (None, None, 1, True),
    ], key=str)
    assert exact_dedup.exact_duplicates(docs_of(spark, [])).collect() == []
