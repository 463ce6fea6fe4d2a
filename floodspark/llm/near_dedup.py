"""Near-duplicate documents by HyperMinHash.

A document is the set of its five-word shingles. Its signature has one register for each of 160 hash
functions: the leading zeros of the smallest hash (6 bits) and the 10 bits after its first one. Registers are
banded, four to a band. Documents of equal sets are one class from the start. Every bucket that several classes
share has a pivot, the member that meets most others in all its buckets; it is compared with all members, first
by the registers, with the matches that come from the compression alone taken off, then by the full sets. A member
first meets the pivot that most of its buckets have, and the others only as far as that has not connected them.
Buckets that hold several components afterwards get a second and a third pivot from what is left; of these a member
meets the one that most of its buckets have.

What three pivots have not connected is settled by what lies outside a pivot. Let a set x not be linked with a
pivot p, and hold c of its shingles. A set y that is linked with x has at least 3/7 (|x| + |y|) shingles in
common with it, of which at most c lie in p. So y holds so many of the shingles of x outside p that one of
them is among the rarest of these (a prefix filter), and only sets that share such shingles are compared; sets
small enough for c to suffice are compared within their buckets. Shingles that the same sets hold are met as one.
Near copies of one text differ outside it, so few sets meet there, and no link that a bucket holds is lost.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^40 = 2.6e-7. Nothing grows on the
driver but the number of rounds.

Edge cases: NULL and empty texts have no shingles and are linked with nothing; texts of fewer than five
words are one shingle; rows that agree in id and text are one document; of equal ids the text hash decides;
NULL ids rank last. An empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import row_keys, scratch, staged, text_or_empty

WORDS, PERCENT = 5, 75
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Pivots of a bucket before the rest of it is searched by shingles.
PIVOTS = 3
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(20_011).integers(0, 2**63, (2, max(REGISTERS, 16)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8").translate(_LOWER).split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    count = len(words) - WORDS + 1
    mixed = np.zeros(count, dtype=np.uint64)
    for k in range(WORDS):
        mixed = (mixed ^ hashes[k : k + count]) * _ODD[0, k]
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 register of each hash function: leading zeros and mantissa of the smallest hash."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] ^ _ODD[1, None, :REGISTERS]
        part = part * _ODD[0, None, :REGISTERS]
        part ^= part >> np.uint64(29)
        np.minimum(least, (part * _ODD[1, None, :REGISTERS]).min(axis=0), out=least)
    # The exponent of the float form is the bit length; rounding up to the next power is undone.
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    length -= (length > 0) & (length < 65) & (least < (np.uint64(1) << np.clip(length - 1, 0, 63).astype(np.uint64)))
    length = np.clip(length, 1, 64)
    zeros = 64 - length
    below = np.where(zeros < 63, (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA), np.uint64(0))
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA) | below).astype(np.uint16)


@lru_cache(maxsize=4096)
def accidental(bits_a: int, bits_b: int) -> float:
    """Chance that a register of two sets without common shingles agrees, for sizes of 2^bits."""
    zeros = np.arange(40)[:, None]
    step = 2.0 ** -(zeros + 1 + MANTISSA)
    low = 2.0 ** -(zeros + 1.0) + np.arange(2**MANTISSA)[None, :] * step

    def cell(size: float) -> np.ndarray:
        return np.exp(size * np.log1p(-low)) - np.exp(size * np.log1p(-np.minimum(low + step, 1 - 1e-16)))

    return float((cell(2.0**bits_a) * cell(2.0**bits_b)).sum())


def equal_registers(a: bytes, b: bytes) -> int:
    return int((np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).sum())


def estimate(a: bytes, b: bytes, size_a: int, size_b: int) -> float:
    """Similarity from two signatures, corrected for accidental agreement."""
    by_chance = accidental(round(math.log2(max(1, size_a))), round(math.log2(max(1, size_b))))
    return (equal_registers(a, b) / REGISTERS - by_chance) / (1 - by_chance)


#: Pairs below this estimate are not verified: nine standard deviations under the threshold.
LEAST_ESTIMATE = 0.75 - 9 * math.sqrt(0.75 * 0.25 / REGISTERS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= PERCENT * (len(a) + len(b) - common)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n, s1, s2, registers): set size, 128-bit name of the set, and signature."""
    k1, k2 = row_keys(key, text)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_or_empty(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, marks = [], [], []
            for text in batch.column("text"):
                found = shingles_of(text.as_py())
                sizes.append(len(found))
                names.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), dtype=np.int64))
                marks.append(registers(found).tobytes() if len(found) else None)
            name = np.array(names, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(sizes, pa.int64()),
                 pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(marks, pa.binary())],
                ["doc_id", "k1", "k2", "n", "s1", "s2", "registers"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(sign, f"doc_id {kind}, k1 bigint, k2 bigint, n bigint, s1 bigint, s2 bigint, registers binary")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(cid, shingles) of the documents that stand for the wanted classes (cid, k1, k2)."""
    k1, k2 = row_keys(key, text)
    source = docs.select(k1.alias("k1"), k2.alias("k2"), text_or_empty(text).alias("text"))
    texts = source.join(wanted, ["k1", "k2"]).select("cid", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles_of(x.as_py()).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(sets, pa.binary())], ["cid", "shingles"])

    # Repeated rows give equal sets; one of them is enough.
    return texts.mapInArrow(shingle, "cid bigint, shingles binary").dropDuplicates(["cid"])


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose corrected estimate leaves similarity possible."""
    return _estimated(pairs, classes).where(F.col("likely")).select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, same, likely): equal registers, and whether the corrected estimate leaves similarity possible."""
    marks = classes.select("cid", "n", "registers")

    @F.arrow_udf("struct<same int, likely boolean>")
    def compare(a: pa.Array, b: pa.Array, size_a: pa.Array, size_b: pa.Array) -> pa.Array:
        rows = list(zip(a.to_pylist(), b.to_pylist(), size_a.to_pylist(), size_b.to_pylist(), strict=True))
        same = pa.array([equal_registers(x, y) for x, y, _, _ in rows], pa.int32())
        likely = pa.array([estimate(*row) >= LEAST_ESTIMATE for row in rows], pa.bool_())
        return pa.StructArray.from_arrays([same, likely], ["same", "likely"])

    sides = pairs.join(marks.toDF("a", "n_a", "r_a"), "a").join(marks.toDF("b", "n_b", "r_b"), "b")
    found = sides.withColumn("found", compare("r_a", "r_b", "n_a", "n_b"))
    # Sets of too different sizes cannot reach the threshold.
    possible = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return found.select("a", "b", "found.same", (F.col("found.likely") & possible).alias("likely"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    @F.arrow_udf("boolean")
    def link(a: pa.Array, b: pa.Array) -> pa.Array:
        found = (linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True))
        return pa.array(list(found), pa.bool_())

    sides = pairs.join(sets.toDF("b", "s_b"), "b").join(sets.toDF("a", "s_a"), "a")
    return sides.where(link("s_a", "s_b")).select("a", "b")


def _unpacked(sets: DataFrame) -> DataFrame:
    """(cid, shingle) of sets (cid, shingles)."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, packed in zip(batch.column("cid").to_pylist(), batch.column("shingles"), strict=True):
                found = np.frombuffer(packed.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), cid)), pa.array(found)], ["cid", "shingle"])

    return sets.select("cid", "shingles").mapInArrow(unpack, "cid bigint, shingle bigint")


def _outside(probes: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, shingles, n, held): the shingles of each set outside its pivot (cid, pivot), its size, and what the pivot holds of it."""
    @F.arrow_udf("binary")
    def without(a: pa.Array, b: pa.Array) -> pa.Array:
        left = (np.setdiff1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True) for x, y in zip(a, b, strict=True))
        return pa.array([x.tobytes() for x in left], pa.binary())

    sides = probes.join(sets.toDF("pivot", "s_p"), "pivot").join(sets.toDF("cid", "s"), "cid")
    n, rest = (F.octet_length("s") / 8).cast("bigint"), (F.octet_length("shingles") / 8).cast("bigint")
    return sides.withColumn("shingles", without("s", "s_p")).select("cid", "shingles", n.alias("n")).withColumn("held", F.col("n") - rest)


def _needed(n: str, m: str) -> Column:
    """Least number of common shingles that links sets of these sizes."""
    return F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT))


def _remaining(members: DataFrame, tried: DataFrame, labels: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Pairs (a, b) of different components that can be linked, of the open buckets' members (cid, bucket, pivot).

    ``pivot`` is the first one of the bucket; of two members of different components, one at least is not in
    that of the pivot. It looks for the other, outside the pivot it agrees with most (tried: a, b, same).
    """
    cids = members.select("cid").distinct()
    of = labels.join(cids, "cid")
    pivots = labels.toDF("pivot", "pivot_comp")
    seekers = members.join(of, "cid").join(pivots, "pivot").where("comp <> pivot_comp").select("cid").distinct()
    ends = tried.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), "same").union(tried.select("b", "a", "same"))
    apart = ends.join(seekers, "cid").join(of, "cid").join(pivots, "pivot").where("comp <> pivot_comp")
    best = apart.groupBy("cid").agg(F.max_by("pivot", F.struct("same", "pivot")).alias("pivot"))
    rest = staged(_outside(best, sets), folder, "outside")

    # Shingles that only one component holds lead nowhere; they count as the rarest. Those that the same sets hold
    # (128 bits over the holders' numbers) are one strand: near copies share long runs of them, which are met as one row.
    held = staged(_unpacked(sets.join(cids, "cid")).join(of, "cid"), folder, "open-shingles")
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "cid")).alias(f"t{seed}") for seed in (1, 2)]
    split = held.groupBy("shingle").agg(F.count("*").alias("k"), F.min("comp").alias("c"), F.max("comp").alias("d"), *marks).where("c <> d")
    split = staged(split.select("shingle", "k", "t1", "t2"), folder, "split-shingles")
    strand = ["t1", "t2"]
    live = staged(
        _unpacked(rest).join(split, "shingle").groupBy("cid", *strand).agg(F.first("k").alias("k"), F.count("*").alias("size")), folder, "outside-strands"
    )
    facts = rest.select("cid", "n", "held").join(of, "cid")
    # Position of the strand's last shingle, from the most frequent one back. Of the needed shingles, only so many less
    # one can stand before the prefix.
    back = F.sum("size").over(Window.partitionBy("cid").orderBy(F.desc("k"), *strand).rowsBetween(Window.unboundedPreceding, 0))
    sought = live.withColumn("back", back).join(facts, "cid").where(F.col("back") >= F.ceil(F.col("n") * PERCENT / 100) - F.col("held"))
    sought = staged(sought, folder, "sought")
    sizes = sets.join(cids, "cid").select("cid", (F.octet_length("shingles") / 8).cast("bigint").alias("m")).join(of, "cid")
    x = sought.select(*strand, "back", "n", "held", F.col("cid").alias("x"), F.col("comp").alias("x_comp"))
    # One shingle of a strand tells all its holders; those of sizes that no seeker of the strand can be linked with stay out.
    most = F.least(F.col("n") * 100 / PERCENT, (F.col("back") + F.col("held")) * (100 + PERCENT) / PERCENT - F.col("n")) + 1
    reach = sought.groupBy(*strand).agg(F.min(F.floor(F.col("n") * PERCENT / 100)).alias("low"), F.max(most).alias("high"))
    named = split.join(reach, strand).groupBy(*strand).agg(F.min("shingle").alias("shingle"), F.first("low").alias("low"), F.first("high").alias("high"))
    holders = held.join(sizes.select("cid", "m"), "cid").join(named, "shingle").where(F.col("m").between(F.col("low"), F.col("high")))
    y = holders.select(*strand, "m", F.col("cid").alias("y"), F.col("comp").alias("y_comp"))
    alike = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    missing = _needed("n", "m") - F.col("held")
    by_strand = x.join(y, strand).where((F.col("x_comp") != F.col("y_comp")) & alike & (missing >= 1) & (F.col("back") >= missing))

    # Sets for which what the pivot holds is enough; most buckets have none that is small enough.
    near = members.select("cid", "bucket")
    v = near.join(sizes, "cid").select("bucket", "m", F.col("cid").alias("y"), F.col("comp").alias("y_comp"))
    smallest = v.groupBy("bucket").agg(F.min("m").alias("m"))
    enough = F.col("held") >= F.greatest(F.ceil(F.col("n") * PERCENT / 100), _needed("n", "m"))
    u = near.join(facts, "cid").join(smallest, "bucket").where(enough)
    u = u.select("bucket", "n", "held", F.col("cid").alias("x"), F.col("comp").alias("x_comp"))
    by_bucket = u.join(v, "bucket").where((F.col("x_comp") != F.col("y_comp")) & alike & (missing < 1))
    found = by_strand.select("x", "y").union(by_bucket.select("x", "y"))
    pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def components(labels: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """(cid, comp): labels after joining the components that the links (a, b) connect.

    Smallest labels spread over the graph of components, and every label then jumps to the label of its
    own; each step is written out. Steps grow with the logarithm of the longest chain in practice.
    """
    of = labels.select(F.col("cid"), F.col("comp"))
    ends = links.join(of.toDF("a", "u"), "a").join(of.toDF("b", "v"), "b").where("u <> v").select("u", "v").distinct()
    edges = staged(ends.union(ends.select("v", "u")).distinct().toDF("u", "v"), folder, f"{name}-edges")
    best = staged(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(best.toDF("v", "near"), "v").groupBy("u").agg(F.min("near").alias("near"))
        spread = best.join(near, "u").select("u", F.least("label", "near").alias("next"), "label")
        jump = spread.join(best.toDF("next", "further"), "next", "left").select(
            "u", F.least("next", F.coalesce("further", "next")).alias("label"), F.col("label").alias("old")
        )
        jumped = staged(jump, folder, f"{name}-{step}")
        best = jumped.select("u", "label")
        if jumped.where("label <> old").isEmpty():
            break
    renamed = labels.join(best.toDF("comp", "label"), "comp", "left")
    return staged(renamed.select("cid", F.coalesce("label", "comp").alias("comp")), folder, f"{name}-labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) of every document.

    ``component_id`` is the smallest id among the documents that links lead to; ``kept`` is true for one
    document of each component, the one of that id.
    """
    folder = scratch(docs.sparkSession)
    signed = staged(signatures(docs, key, text), folder, "signatures")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    classes = staged(
        signed.where("n > 0").groupBy("s1", "s2").agg(F.min(rank).alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
        .withColumn("cid", F.monotonically_increasing_id()), folder, "classes",
    )
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]))
    banded = classes.select("cid", band.alias("band", "bucket")).select("cid", "bucket")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(banded.join(shared, "bucket"), folder, "members")
    wanted = members.select("cid").distinct()
    labels = staged(wanted.select("cid", F.col("cid").alias("comp")), folder, "labels")
    sets = staged(
        _sets(docs, classes.join(wanted, "cid").select("cid", "least.k1", "least.k2"), key, text), folder, "sets"
    )

    # The more others a member meets in all its buckets, the more central it is.
    weights = members.groupBy("cid").agg(F.sum("size").alias("weight"))
    members = staged(members.select("cid", "bucket").join(weights, "cid"), folder, "weighted")
    least = F.min(F.struct(-F.col("weight"), "cid"))["cid"]
    firsts = staged(members.groupBy("bucket").agg(least.alias("pivot")), folder, "pivots")
    open_members, tried = members.join(firsts, "bucket"), None
    for turn in range(PIVOTS + 1):
        if turn < 2:
            chosen = open_members
        else:
            # The next pivot comes from the components that no earlier one of the bucket belongs to.
            left = open_members.join(labels, "cid").join(gone, ["bucket", "comp"], "left_anti")
            chosen = open_members.join(left.groupBy("bucket").agg(least.alias("next")), "bucket").withColumn("pivot", F.col("next"))
        x, p = labels.toDF("cid", "comp_x"), labels.toDF("pivot", "comp_p")
        apart = chosen.select("cid", "bucket", "pivot").join(x, "cid").join(p, "pivot").where("comp_x <> comp_p")
        if turn != 1:
            # Of the pivots of its buckets, the one that a member shares most of them with.
            met = apart.groupBy("cid", "pivot").agg(F.count("*").alias("n"))
            apart = met.groupBy("cid").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"))
        pairs = apart.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        compared = staged(_estimated(pairs, classes), folder, f"tried-{turn}")
        links = staged(_verified(compared.where("likely").select("a", "b"), sets), folder, f"links-{turn}")
        tried = compared if tried is None else tried.unionByName(compared)
        if not links.isEmpty():
            labels = components(labels, links, folder, f"components-{turn}")
        if turn == 0:
            continue
        now = chosen.select("bucket", "pivot").distinct()
        used = staged(now if turn == 1 else used.union(now), folder, f"used-{turn}")
        gone = used.join(labels.toDF("pivot", "comp"), "pivot").select("bucket", "comp").distinct()
        # A bucket is open while it holds several components.
        split = open_members.join(labels, "cid").groupBy("bucket").agg(F.min("comp").alias("c"), F.max("comp").alias("d"))
        open_members = staged(open_members.join(split.where("c <> d").select("bucket"), "bucket"), folder, f"open-{turn}")
        if open_members.isEmpty():
            break
    else:
        rest = staged(_remaining(open_members, tried, labels, sets, folder), folder, "tried-rest")
        links = staged(_verified(_likely(rest, classes), sets), folder, "links-rest")
        if not links.isEmpty():
            labels = components(labels, links, folder, "components-rest")

    with_comp = classes.join(labels, "cid", "left").select("s1", "s2", "least", F.coalesce("comp", "cid").alias("comp"))
    firsts = with_comp.groupBy("comp").agg(F.min("least").alias("first"))
    named = with_comp.join(firsts, "comp").select("s1", "s2", "first")
    found = signed.drop("registers").join(named, ["s1", "s2"], "left")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    return found.select(
        "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("first") == own, F.lit(True)).alias("kept"),
    )
