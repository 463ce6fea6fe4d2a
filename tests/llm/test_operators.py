"""Each operator against plain Python on small tables, and on its edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from floodspark.llm import (
    byte_bpe, common, decontamination, language_id, near_dedup, quality_rules, sharding, substring_dedup, token_files, url_filter, warc,
)
from floodspark.llm.common import row_keys
from floodspark.llm.queries import QUERIES, RULES
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, k1 string, statistics int, row int"
PASSAGE = " ".join(f"passage{i}" for i in range(70))
LONG = " ".join(f"w{i * i % 7919}" for i in range(60_000))
CASES = [
    None, "", " ", "\n\n", "one two", "a b c d e f g h i j", PASSAGE, "before " + PASSAGE + " after", PASSAGE, "é" * 500, "é" * 450,
    "\u0130stanbul ÉTÉ I\u0307 <|endoftext|>", LONG, LONG + " end", "x" * 900, "tab\tand\r\nmore \u3000wide", "und " * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in enumerate(CASES)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id at all", "en", "s", 1, "x", 1, 2)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, sf_dir):
    """A folder with 200 documents of the test tables, small enough for plain Python."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    return folder, [(r.doc_id, r.text) for r in rows]


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quality_counts(spark, tables):
    folder, rows = tables
    found = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, folder).collect()}
    for doc_id, text in rows:
        r = found[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert not (r.base_failed and r.kept)


def test_quality_edges(docs, empty):
    s = quality_rules.with_statistics(docs.drop("statistics")).select("text", "statistics.*").collect()
    for r in s:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.quality(r.text)[:5]
    assert quality_rules.judge(docs, quality_rules.DecisionList(), name="verdict").where("verdict.kept").count() > 0
    assert quality_rules.fit(empty, empty.select("doc_id", F.lit(0).alias("quality"))).rules == ()


def test_texts_are_counted_once(spark, docs, capsys):
    """A filter on the counts stays above them; one Python worker a task is enough."""
    quality_rules.with_statistics(docs.select("doc_id", "text"), name="s").where("s.n_words > 3").select("doc_id", "s.n_bars").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_covering_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 2] < 0.4)
    found = quality_rules.learn(x, bad, ["a", "b", "c"])
    covered = np.zeros(len(x), dtype=bool)
    for rule in found.rules:
        covered |= quality_rules._cover(x, ["a", "b", "c"], list(rule))
    assert (covered == bad).mean() > 0.97


@pytest.mark.parametrize("high", [1, 7, 200, 50_257, 2**32 - 1])
def test_token_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for size in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, high + 1, size, dtype=np.uint64).astype(np.uint32)
        ids[: size // 20] = high
        segment = token_files.pack_blocks(ids)
        assert (token_files.read_ids(segment) == ids).all()
        assert (token_files.read_ids(segment, size // 3, size // 2) == ids[size // 3 : size // 2]).all()


def test_token_files(spark, tables, docs, empty, tmp_path):
    folder, rows = tables
    assert as_rows(QUERIES["op2_token_files"](spark, folder)) == brute.token_rows(rows)
    path = public_tokenizers.path("byte_bpe_50k.json")
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    token_files.write_tokens(named, str(tmp_path / "a"), path, segment_ids=1000)
    found = token_files.read_tokens(spark, str(tmp_path / "a")).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert as_rows(found) == brute.token_rows(list(enumerate(CASES)))
    token_files.write_tokens(docs, str(tmp_path / "c"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "c")).count() == docs.count()
    token_files.write_tokens(empty, str(tmp_path / "b"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_token_files_added_tokens(spark, tmp_path):
    """The registered query against an unchanged Tokenizer.encode, on texts that hold an added token."""
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [f"a {end} b", "none", end, end * 2, f"x  {end}\n\n{end}  y z", f"<|endof{end}text|>", f"tab\t{end}'s {end} 12", None, "", f"{LONG}{end} {LONG}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer, want, start = Tokenizer.from_file(path), [], 0
    for doc_id, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert as_rows(QUERIES["op2_token_files"](spark, str(tmp_path))) == want


def test_token_files_library_splits(tmp_path):
    """Added tokens of every kind, and a normaliser."""
    from tokenizers import AddedToken, Tokenizer, normalizers

    texts = ["a <x> b<x><xy> <X>c", "<xy>  <w> <w>x <n>", "A<n>b <x", " <x>  "]
    for k, more in enumerate(([AddedToken("<x>"), AddedToken("<xy>", normalized=False)], [AddedToken("<x>", lstrip=True, rstrip=True), AddedToken("<w>", single_word=True)], [])):
        tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        tokenizer.add_tokens(more)
        if not more:
            tokenizer.normalizer = normalizers.Lowercase()
        tokenizer.save(path := str(tmp_path / f"{k}.json"))
        found = [np.frombuffer(b"".join(x), np.uint32).tolist() for x in token_files._encoder(path, True)(texts)]
        assert found == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files_encode_a_word_once():
    """What stands beside a word makes no new chunk of it, and the cuts change no id of the library."""
    from tokenizers import Tokenizer

    asked: list[str] = []
    known = common.KnownChunks(lambda chunks: asked.extend(chunks) or [[len(x)] for x in chunks], True)
    found = [np.frombuffer(b"".join(x), np.uint32).tolist() for x in known(["", "one one, one. one\none", "one 1one it's", ""])]
    assert found == [[], [3, 4, 1, 4, 1, 4, 4], [3, 2, 3, 3, 2], []]
    assert sorted(asked) == sorted(["one", " one", ",", ".", "\none", " 1", " it", "'s"])

    rng = random.Random(3)
    signs = [*"aZ's td09 .,!?\"-_\n\t\r\x0b\x1c\x1f\x7f\x00\u00a0\u2003\u3000\u0085\u00e9\u0301\u4e2d\u0663", "'ll", "it's", "<|endoftext|>", "  ", "\r\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(3000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = [np.frombuffer(b"".join(x), np.uint32).tolist() for x in token_files._encoder(path, True)(texts)]
    assert found == [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_substring_dedup(spark, tables):
    folder, rows = tables
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op3_suffix_array_dedup"](spark, folder).collect()}
    assert [found[d][:4] for d, _ in rows] == brute.repeated_bytes([t for _, t in rows])
    assert all(repeats == (removed > 0) for _, removed, _, _, repeats in found.values())


@pytest.mark.parametrize("in_one_task", [1000, 1])
def test_substring_dedup_edges(docs, empty, in_one_task, monkeypatch):
    """Both ways for frequent triggers give the brute-force result."""
    monkeypatch.setattr(substring_dedup, "IN_ONE_TASK", in_one_task)
    texts = [r.text for r in docs.select("text").collect()]
    want = {}
    for text, expected in zip(texts, brute.repeated_bytes(texts), strict=True):
        want[text] = expected
    for r in substring_dedup.deduplicated(docs).collect():
        n, removed, spans, sha = want[r.text]
        assert (r.n_bytes, len(r.spans), hashlib.sha256(r.kept).hexdigest()) == (n, spans, sha)
        assert sum(x.stop - x.start for x in r.spans) == removed
    assert substring_dedup.deduplicated(empty).count() == 0


def test_substring_dedup_random(spark):
    """Shared passages with edits, around the block length of 400 bytes."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcde ") for _ in range(3000))
    texts = []
    for _ in range(40):
        a = rng.randrange(2500)
        part = list(base[a : a + rng.choice([398, 399, 400, 401, 450, 900])])
        if rng.random() < 0.5:
            part[rng.randrange(len(part))] = "X"
        texts.append("".join(rng.choice("fghij") for _ in range(rng.randrange(300))) + "".join(part) + str(rng.random()))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.row.doc_id: (r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans)) for r in substring_dedup.deduplicated(df).collect()}
    assert [found[i] for i in range(40)] == [x[:3] for x in brute.repeated_bytes(texts)]


def test_byte_bpe_is_tiktoken(spark, tables):
    folder, rows = tables
    encoding = brute.rank_encoding()
    want = []
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        joined = " ".join(map(str, ids))
        want.append((doc_id, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert as_rows(QUERIES["op4_byte_bpe"](spark, folder)) == sorted(want)


def test_byte_bpe_on_any_text():
    own = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoding, rng = brute.rank_encoding(), random.Random(3)
    for alphabet in ("ab \n\t'sdé\u3000\x85\x1c 12,.!<|endoftext|>\u200b\U0001f600", "abcdefgh", " \n", "thein"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            ids = own.encode(text)
            assert ids == encoding.encode_ordinary(text)
            assert own.decode(ids) == text.encode()


def test_byte_bpe_edges(docs):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = docs.select("text", byte_bpe.encoded(F.col("text"), path, pattern).alias("ids"))
    for r in found.withColumn("back", byte_bpe.decoded(F.col("ids"), path, pattern)).collect():
        assert r.back == (r.text or "").encode()


def test_byte_bpe_encodes_a_text_once(spark, tables, docs, capsys):
    """Ids and the bytes they stand for come from one call, in which no text is encoded again."""
    QUERIES["op4_byte_bpe"](spark, tables[0]).explain()
    calls = [x for x in capsys.readouterr().out.splitlines() if "ArrowEvalPython" in x]
    assert len(calls) == 1 and calls[0].count("text#") == 1, calls
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for text, both in docs.select("text", byte_bpe.round_trip(F.col("text"), path, pattern)).collect():
        assert list(both.ids) == brute.rank_encoding().encode_ordinary(text or "") and bytes(both.data) == (text or "").encode()


def test_url_rules(spark):
    cases = {
        "http://example.com/en/1": ("example.com", "/en/1", "example.com/en/"), "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/"),
        "ftp://x.com": ("x.com", "", None), "x.com/en/": ("", "", None), None: ("", "", None), "": ("", "", None),
        "a://b.net/es/x?y://z": ("b.net", "/es/x", "net/es/"), "http://net/fr/": ("net", "/fr/", "net/fr/"), "http://xcom/": ("xcom", "/", None),
        "http://a.com?/en/#": ("a.com", "", None), "http://É.com/#x": ("É.com", "/", "com/"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    found = url_filter.split_urls(pages, RULES).collect()
    assert {r.url: (r.host, r.path, r.rule) for r in found} == cases
    judged = url_filter.filter_urls(pages, RULES, trees=2)
    assert judged.count() == len(cases) and judged.where("verdict is null or verdict not in ('allow', 'block')").isEmpty()
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


def test_url_trees_learn(spark):
    rows = [(i, f"http://h{i % 50}.{'com' if i % 3 else 'net'}/{'es' if i % 2 else 'en'}/{i}") for i in range(600)]
    features = url_filter.lexical(url_filter.split_urls(spark.createDataFrame(rows, "page_id bigint, url string"), RULES))
    known = features.where("ruled is not null")
    right = url_filter.fit(features, trees=5).judge(known).where("judged = ruled").count()
    assert right / known.count() > 0.95


def test_url_suffix_rates_do_not_repeat_the_rules(spark, sf_dir):
    # Every labelled net page is blocked; pages of net without a rule must still be judged by more than that.
    found = QUERIES["op5_url_filter"](spark, sf_dir).where("rule is null and host like '%.net'")
    blocked = found.where("verdict = 'block'").count()
    assert blocked < found.count()
    rows = [("net", 1.0), ("net", 1.0), ("com", 0.0), ("com", 1.0), ("com", 0.0), ("com", 0.0)]
    rates = url_filter.suffix_rates(spark.createDataFrame(rows, "suffix string, label double"), 0.5, 4.0).collect()
    assert [(r.suffix, r.suffix_rate) for r in rates] == [("com", 0.375)]


def test_url_repeats_and_long_urls(spark):
    long = "http://a.com/" + "x1/" * 40_000
    pages = [(1, long), (2, long), (3, "http://b.net/es/1"), *[(k, "http://c.com/hot") for k in range(4, 300)], (300, "http://d.net/de/")]
    spread = pages + [(1000 + k, f"http://h{k}.{'net/es' if k % 2 else 'com/a'}/{k}") for k in range(60)]
    frame = spark.createDataFrame(spread, "page_id bigint, url string").withColumn("suffix_rate", F.lit("x")).withColumn("label", F.lit("y"))
    found = {r.page_id: r for r in url_filter.filter_urls(frame, RULES, trees=2).collect()}
    assert len(found) == len(spread)
    assert found[1].verdict == found[2].verdict == "allow" and len(found[1].path) == len(long) - len("http://a.com")
    assert found[3].verdict == "block" and found[4].verdict == "allow"
    model = url_filter.fit(url_filter.lexical(url_filter.split_urls(frame, RULES)), trees=1)
    assert abs(model.prior - 31 / 63) < 1e-9  # repeated URLs count once


def test_language_held_out(spark, sf_dir, docs, empty):
    found = QUERIES["op6_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.where("lang_pred = lang").count() / held.count() > 0.95
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()
    model = language_id.fit(docs)
    edge = {r.text: r.p for r in docs.select("text", model.predicted(F.col("text")).alias("p")).collect()}
    assert all(edge[x].lang_pred == "und" for x in (None, "", " ")) and edge[LONG].lang_pred == "en"
    assert language_id.fit(empty).predict("some text") == ("und", 0.0)


def test_language_rare(spark):
    """A language of a few rows is trained beside one that could take the whole bound."""
    rows = [(i, f"the house and the garden number {i}", "en") for i in range(3000)] + [(3000 + i, f"talo ja puutarha on kaunis {i}", "fi") for i in range(4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), most_rows=40)
    assert model.predict("puutarha on talo")[0] == "fi" and model.predict("the garden house")[0] == "en"


def test_sharding(spark, tables, docs, empty):
    folder, rows = tables
    found = QUERIES["op7_sharding"](spark, folder).toPandas()
    assert len(found) == len(rows)
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = found[found.shard != found.grown_shard]
    assert len(moved) and (moved.grown_shard == 8).all()
    placed = sharding.shard_documents(docs, sharding.even_tree(8), sharding.even_tree(9))
    assert sharding.numbered(placed, "shard", ["doc_id", "text_crc32", "size"], bucket_rows=3).select("shard", "slot").distinct().count() == docs.count()
    assert sharding.numbered(placed.limit(0), "shard", ["doc_id"]).count() == 0


def test_sharding_weights(spark):
    tree = sharding.Node("root", (
        sharding.Node("a", (sharding.Node("a0", shard=0, own_weight=3.0), sharding.Node("a1", shard=1))), sharding.Node("b", shard=2, own_weight=4.0),
    ))
    keys = spark.range(8000).select(sharding.placed(F.xxhash64("id"), tree).alias("shard"))
    share = {r.shard: r["count"] / 8000 for r in keys.groupBy("shard").count().collect()}
    assert abs(share[0] - 3 / 8) < 0.02 and abs(share[1] - 1 / 8) < 0.02 and abs(share[2] - 1 / 2) < 0.02


def test_near_dedup(spark, tables, docs, empty):
    folder, rows = tables
    want = brute.near_components(rows)
    for r in QUERIES["op8_near_dedup"](spark, folder).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    edges = near_dedup.near_duplicates(docs)
    want = brute.near_components([(i, t) for i, t in enumerate(CASES)])
    for r in edges.where("doc_id is not null").collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert edges.where("doc_id is null and kept").count() == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_families(spark):
    """Groups whose members are linked only through others, in buckets of many sizes."""
    rng, rows = random.Random(9), []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(4)}"
            rows.append((len(rows), " ".join(copy)))
            base = copy if family % 2 else base
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.near_components(rows)
    for r in near_dedup.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_near_dedup_beyond_pivots(spark, monkeypatch):
    """Chains of links away from the pivot, deleted and replaced words, texts of several lengths, a passage in all."""
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rng, rows = random.Random(31), []
    passage = [f"p{i}" for i in range(40)]
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)] + passage
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = [] if rng.random() < 0.5 else [f"e{rng.randrange(3)}"]
            if rng.random() < 0.3:
                copy = copy[rng.randrange(15) :]
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute.near_components(rows)
    assert 4 < len({c for _, c in want.values()}) < len(rows)
    for r in near_dedup.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_near_dedup_meets_few_pivots(spark, monkeypatch):
    """Copies that are too far from each other meet one more pivot a turn, not one of each bucket."""
    made, write = {}, near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, folder, name: made.setdefault(name, write(df, folder, name)))
    rng, rows = random.Random(7), []
    base = [f"w{i}" for i in range(150)]
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randrange(3, 12)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(9)}"
        rows.append((len(rows), " ".join(copy)))
    want = brute.near_components(rows)
    for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    sizes = {name: df.count() for name, df in made.items() if name.startswith("tried-")}
    assert 0 < sizes["tried-2"] <= len(rows) and sizes["tried-0"] <= len(rows), sizes


def test_near_dedup_meets_strands(spark, monkeypatch):
    """Beyond the pivots, shingles of the same holders are one row, and only those that are sought are looked up."""
    made, write = {}, near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, folder, name: made.setdefault(name, write(df, folder, name)))
    monkeypatch.setattr(near_dedup, "PIVOTS", 1)
    rng, rows = random.Random(31), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(80)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(3)}"
            rows.append((len(rows), " ".join(copy)))
            base = copy if rng.random() < 0.7 else base
    want = brute.near_components(rows)
    for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
    strands = made["outside-strands"]
    assert 0 < strands.count() < strands.agg(F.sum("size")).first()[0]
    assert made["sought"].count() <= strands.count()


def test_hyperminhash_estimate():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.3, 0.75, 0.95, 1.0):
        common = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 1000 - len(common), dtype=np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        found = near_dedup.estimate(near_dedup.registers(a).tobytes(), near_dedup.registers(b).tobytes(), len(a), len(b))
        assert abs(found - true) < 0.15


def test_decontamination_edges(spark, docs, empty):
    items = spark.createDataFrame([(1, "One TWO"), (2, None), (3, "... !"), (4, PASSAGE), (5, "zzz one two"), (6, "ÉTÉ")], "item_id int, text string")
    found = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.report(docs, items).collect()}
    assert found[4] == (2, ["1"]) and found[7][1] == ["4"] and found[11] == (1, ["6"])
    assert found[0] == (0, []) and found[None] == (0, [])
    assert decontamination.report(empty, items).count() == 0
    assert decontamination.report(docs, items.limit(0)).where("n_hit > 0").isEmpty()


def test_proximity(spark, docs, tmp_path):
    terms = spark.createDataFrame([("g", "passage3"), ("g", "passage9"), ("far", "passage1"), ("far", "passage60"), ("no", "absent")], "group string, term string")
    counts = decontamination.term_counts(docs, terms.select("term").distinct())
    rarest = terms.select(F.array("term").alias("window"), "term", F.lit(0).alias("offset")).distinct()
    index = decontamination.build_index(docs, rarest, counts, str(tmp_path))
    found = decontamination.proximity_matches(index, terms, 10).groupBy("group").count().collect()
    assert {r.group: r["count"] for r in found} == {"g": 3}


def test_proximity_of_items(spark):
    """Windows in another order and with words between, on the index that the report builds."""
    item = "alpha beta gamma delta beta"
    texts = [item, "delta x x beta gamma y alpha", "alpha " + "x " * 30 + "beta gamma delta", "alpha beta gamma", "beta " * 50, None, "x " * 40 + "gamma beta alpha z delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "alpha absent"), (3, "zeta")], "item_id int, text string")
    found = {r.doc_id: (r.n_hit, list(r["items"]), r.n_near, list(r.near_items)) for r in decontamination.report(docs, items).collect()}
    none = (0, [], 0, [])
    assert found == {0: (5, ["1"], 1, ["1"]), 1: (0, [], 1, ["1"]), 2: none, 3: none, 4: none, 5: none, 6: (0, [], 1, ["1"])}


def test_proximity_of_groups_on_item_index(spark):
    """Groups of terms that are the rarest of no window are found when they are asked for, else an error."""
    docs = spark.createDataFrame([(0, "rare a b b a"), (1, "a x x x b"), (2, "a " + "x " * 30 + "b a"), (3, "a only")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "rare a b")], "item_id int, text string")
    groups = spark.createDataFrame([("ab", "a"), ("ab", "b"), ("new", "x"), ("new", "only"), ("one", "only"), ("no", "a"), ("no", "gone")], "group string, term string")
    ids = docs.select("doc_id", *[c.alias(n) for c, n in zip(row_keys(), ("k1", "k2"), strict=True)])
    index = decontamination.item_index(docs, items, groups=groups).postings
    found = decontamination.proximity_matches(index, groups, 5).join(ids, ["k1", "k2"]).select("group", "doc_id")
    assert as_rows(found) == [("ab", 0), ("ab", 1), ("ab", 2), ("one", 3)]
    bare = decontamination.item_index(docs, items).postings
    with pytest.raises(Exception, match="no postings of the rarest term"):
        decontamination.proximity_matches(bare, groups.where("group = 'ab'"), 5).collect()
    with pytest.raises(ValueError):
        decontamination.proximity_matches(bare, groups, 21)
    rare = spark.createDataFrame([("r", "rare"), ("r", "b")], "group string, term string")
    assert decontamination.proximity_matches(bare, rare, 2).count() == 1 and decontamination.proximity_matches(bare, rare, 1).count() == 0


def test_warc(spark, empty):
    html = "<html><head><title>no</title></head><body><!-- x --><p>One &amp; two</p><script>a<b</script><div>three<br>four"
    pages = spark.createDataFrame([(1, "http://a.b/", html), (2, None, None), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string")
    rows = warc.derivatives(warc.page_responses(pages)).withColumn("data", warc.serialised()).collect()
    assert len(rows) == 8 and len({r.record_id for r in rows}) == 6
    first = {r.warc_type: r for r in rows if r.page_id == 1}
    assert first["conversion"].block == "One & two\nthree\nfour"
    for r in first.values():
        assert r.refers_to == first["metadata"].refers_to and r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        head, _, rest = bytes(r.data).partition(b"\r\n\r\n")
        assert rest == r.block.encode() + b"\r\n\r\n" and f"Content-Length: {r.content_length}".encode() in head
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("html, text", [
    ("<head><title>t</title><body><p>Lost one</p><p>Lost two</p><script>x</script><p>kept</p>", "Lost one\nLost two\nkept"),
    ("<script>a</style>b</script>c<style>d</style>e", "c e"), ("<header>shown</header><HEAD >no</HEAD\n>yes", "shown\nyes"),
    ("<noscript>n<template>t</noscript>u</template>v", "uv"), ("<p>" + "long " * 40_000 + "<b>end</b>", "long " * 40_000 + "end"),
])
def test_hidden_elements_end_with_their_own_tag(spark, html, text):
    pages = spark.createDataFrame([(1, "u", html, "x", "y")], "page_id bigint, url string, html string, payload string, block string")
    found = warc.derivatives(warc.page_responses(pages)).where("warc_type = 'conversion'").first()
    assert found.block == text


def test_letters():
    assert all(map(language_id.has_letters, ["a", "1é", "\u5b57", "\u02b0"]))
    assert not any(map(language_id.has_letters, [None, "", "1 2", "\u00bd \u00b2", "\u2167", "\u2460", "_"]))


def test_scratch_changes_no_setting():
    """Without a shared folder in spark.checkpoint.dir, tables go below the warehouse."""
    from floodspark.llm.common import scratch

    class Session:
        def __init__(self, **settings):
            self.settings, self.conf = settings, self

        def get(self, key, *default):
            return self.settings.get(key.replace(".", "_"), *default)

    shared = Session(spark_checkpoint_dir="hdfs://x/c/", spark_sql_warehouse_dir="hdfs://x/w")
    assert scratch(shared).startswith("hdfs://x/c/llm-")
    assert scratch(Session(spark_sql_warehouse_dir="hdfs://x/w")).startswith("hdfs://x/w/llm-")
    assert scratch(shared) != scratch(shared)
