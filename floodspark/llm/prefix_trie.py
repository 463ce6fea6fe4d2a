"""Prefix trie of conversations as a z-fast trie in tables.

A conversation is the sequence of its turns. Its prefix of depth d has a 128-bit name that follows from the name of
depth d - 1 and the digest of turn d, so equal names mean equal prefixes. A compacted node covers the depths
(above, depth] of an edge on which no conversation ends and none branches off. It is filed under its *handle*, the
prefix whose depth is the two-fattest number of that range (the one with most trailing zeros), and under its *top*,
the prefix one below the edge's start.

Conversations are inserted in batches drawn by hash, each eight times as large as those before together. Conversations
of equal turns count as one, so copies cost nothing here. Every conversation of a batch finds its exit node by fat binary search:
each step is one equi-join of its prefix at the two-fattest depth left with the handles, log2(depth) steps in all. Exit
nodes are then cut where conversations leave them or end, and what goes on below becomes new nodes: conversations of
a batch that leave at the same place with the same turn make a small trie of their own. As batches are random draws,
about eight share one; more than 8 k do with probability e^-k, whatever the skew of the turns.

Numbers of whole subtrees are sums up the compacted tree by pointer doubling, log2(height) steps that each aggregate
before the shuffle. Edges are expanded into one row for each depth at the end.

Edge cases: NULL role or text is empty; turns come in their order, NULL first, equal ones by digest; rows whose
conversation id is NULL belong to no conversation. A conversation holds 24 bytes for each of its turns in one row, not
the texts. An empty table has no nodes. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import scratch, staged

#: Name of the prefix of no turns.
ROOT = hashlib.md5(b"").digest()
#: Growth from one batch to the next, and about how many conversations the first one draws.
GROWTH, FIRST_BATCH = 8, 512
#: Ids that one row of the lists of members holds at most.
CHUNK = 10_000
_NODE = "top binary, name binary, up binary, above int, depth int, names array<binary>, sizes array<bigint>, size_above bigint"
_SUMS = {"n": F.sum, "least": F.min, "leaves": F.sum, "member_bytes": F.sum, "edge_bytes": F.sum}


# --- conversations -----------------------------------------------------------------------------------


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): for each conversation its turns in order, as digests and sizes of the text in bytes."""
    who, said = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    entry = F.struct(
        F.col(f"`{turn}`").alias("at"), digest.alias("digest"), F.octet_length(said).cast("bigint").alias("size")
    )
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").alias("conv_id"), entry.alias("entry"))
    # Ascending order of an array of structs puts NULL first.
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("entry"), _in_order).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def _in_order(a: Column, b: Column) -> Column:
    by_digest = F.when(a["digest"] < b["digest"], -1).when(a["digest"] > b["digest"], 1).otherwise(0)
    return (
        F.when(a["at"].isNull() & b["at"].isNull(), by_digest).when(a["at"].isNull(), -1).when(b["at"].isNull(), 1)
        .when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(by_digest)
    )


def rebuilt(lists: DataFrame, stride: int = 5, most: int = 9) -> DataFrame:
    """Every conversation with its head taken from the one it derives from.

    The head is the first h turns of conversation c - c % ``stride``, h being crc32(c) % ``most``; the conversation's own
    turns after its first h follow. A base has at most ``stride`` followers, so the join has no hot key.
    """
    head = lists.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    based = lists.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base"))
    none = F.array().cast(lists.schema["turns"].dataType)
    return based.join(head, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"),
    )


def named(lists: DataFrame) -> DataFrame:
    """(conv_id, name, depth, names, sizes): names of all prefixes, and the bytes of text up to each."""
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, last = [], [], []
            for turns in batch.column("turns"):
                name, size, own, total = ROOT, 0, [], []
                for turn in turns.as_py():
                    name, size = hashlib.md5(name + turn["digest"]).digest(), size + turn["size"]
                    own.append(name)
                    total.append(size)
                names.append(own)
                sizes.append(total)
                last.append(name)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(last, pa.binary()), pa.array([len(x) for x in names], pa.int32()),
                 pa.array(names, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))],
                ["conv_id", "name", "depth", "names", "sizes"],
            )

    kind = lists.schema["conv_id"].dataType.simpleString()
    return lists.mapInArrow(chain, f"conv_id {kind}, name binary, depth int, names array<binary>, sizes array<bigint>")


# --- the trie ----------------------------------------------------------------------------------------


def two_fattest(low: Column, high: Column) -> Column:
    """The number of (low, high] that the highest power of two divides."""
    # All bits from the highest in which the two differ.
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("bigint"))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def handle(above: Column, depth: Column, names: Column) -> Column:
    return F.get(names, two_fattest(above, depth) - above - 1)


def exits(strings: DataFrame, trie: DataFrame, deepest: int) -> DataFrame:
    """Strings with ``at``, how deep the trie holds them, ``top`` of the node whose edge they end in or leave, and
    ``cut``, true if that is inside the edge. ``top`` is NULL for those that leave at the end of an edge."""
    handles = trie.where("depth > 0").select(
        handle(F.col("above"), F.col("depth"), F.col("names")).alias("probe"), F.col("above").alias("n_above"),
        F.col("depth").alias("n_depth"), F.col("name").alias("n_name"),
    )
    low, high = F.col("low"), F.col("high")
    state = strings.withColumns({"low": F.lit(0), "high": F.col("depth")})
    for _ in range(deepest.bit_length() + 1):
        going = low < high
        # A string that is done looks itself up and ignores what it finds.
        probed = state.withColumn("fat", F.when(going, two_fattest(low, high))).withColumn(
            "probe", F.coalesce(F.get("names", F.col("fat") - 1), "name")
        )
        found = probed.join(handles, "probe", "left")
        hit = F.col("n_depth").isNotNull()
        whole = hit & (F.col("n_depth") <= F.col("depth")) & F.coalesce(F.get("names", F.col("n_depth") - 1) == F.col("n_name"), F.lit(False))
        state = found.withColumns({
            "low": F.when(going & whole, F.col("n_depth")).when(going & hit, F.col("n_above")).otherwise(low),
            "high": F.when(~going | whole, high).when(hit, F.col("n_above")).otherwise(F.col("fat") - 1),
        }).drop("probe", "fat", "n_above", "n_depth", "n_name")
    # The node below the last one matched whole, if the string goes on along its edge.
    edges = trie.where("depth > 0").select("top", F.col("names").alias("edge"))
    last = state.withColumn("next", F.coalesce(F.get("names", low), "name")).join(edges.withColumnRenamed("top", "next"), "next", "left")
    own = F.slice("names", low + 1, F.greatest(F.size("edge"), F.lit(1)))
    same = F.size(F.filter(F.zip_with("edge", own, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    along = F.when(F.col("edge").isNotNull() & (low < F.col("depth")), same).otherwise(0)
    return last.withColumns({
        "at": low + along, "top": F.when(along > 0, F.col("next")), "cut": F.coalesce((along > 0) & (along < F.size("edge")), F.lit(False)),
    }).drop("low", "high", "next", "edge")


def cut_edges(trie: DataFrame, located: DataFrame) -> DataFrame:
    """The trie with its edges cut where strings leave them or end."""
    places = located.where("cut").select("top", "at").distinct().groupBy("top").agg(F.array_sort(F.collect_list("at")).alias("places"))
    ends = F.concat(F.coalesce("places", F.array().cast("array<int>")), F.array("depth"))
    pieces = trie.join(places, "top", "left").withColumn("ends", ends).select(
        "*", F.posexplode(F.col("ends")).alias("piece", "end")
    ).withColumn("start", F.when(F.col("piece") == 0, F.col("above")).otherwise(F.get("ends", F.col("piece") - 1)))
    first, count = F.col("start") - F.col("above"), F.col("end") - F.col("start")
    whole = F.col("places").isNull()
    cut = pieces.withColumns({
        "own": F.when(whole, F.col("names")).otherwise(F.slice("names", first + 1, count)),
        "own_sizes": F.when(whole, F.col("sizes")).otherwise(F.slice("sizes", first + 1, count)),
    })
    return cut.select(
        F.when(F.col("piece") == 0, F.col("top")).otherwise(F.get("own", F.lit(0))).alias("top"),
        F.element_at("own", -1).alias("name"),
        F.when(F.col("piece") == 0, F.col("up")).otherwise(F.get("names", first - 1)).alias("up"),
        F.col("start").alias("above"), F.col("end").alias("depth"), F.col("own").alias("names"), F.col("own_sizes").alias("sizes"),
        F.when(F.col("piece") == 0, F.col("size_above")).otherwise(F.get("sizes", first - 1)).alias("size_above"),
    )


def _compacted(strings: list[tuple[list[bytes], list[int], int]]) -> Iterator[tuple]:
    """Nodes of the compacted trie of different strings (names, sizes, at) that leave the trie at one place."""
    strings.sort(key=lambda s: s[0])
    names, _, at = strings[0]
    # Groups of strings with a common prefix of ``at`` names; one that ends there comes first.
    stack = [(0, len(strings), at)]
    while stack:
        low, high, above = stack.pop()
        first, last = strings[low][0], strings[high - 1][0]
        depth = above
        while depth < min(len(first), len(last)) and first[depth] == last[depth]:
            depth += 1
        sizes = strings[low][1]
        yield (
            first[above], first[depth - 1], first[above - 1] if above else ROOT, above, depth, first[above:depth], sizes[above:depth],
            sizes[above - 1] if above else 0,
        )
        start = low + (len(first) == depth)
        for i in range(start, high):
            if i + 1 == high or strings[i + 1][0][depth] != strings[i][0][depth]:
                stack.append((start, i + 1, depth))
                start = i + 1


def new_nodes(located: DataFrame) -> DataFrame:
    """Nodes for what the located strings hold below the place where they leave the trie."""
    leaving = located.where("at < depth").select(F.get("names", F.col("at")).alias("key"), "names", "sizes", "at")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("top", pa.binary()), ("name", pa.binary()), ("up", pa.binary()), ("above", pa.int32()), ("depth", pa.int32()),
            ("names", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("size_above", pa.int64()),
        ])
        key, group = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key and group:
                    out += _compacted(group)
                    group = []
                key = row["key"]
                group.append((row["names"], row["sizes"], row["at"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out = list(_compacted(group)) if group else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return leaving.repartition("key").sortWithinPartitions("key").mapInArrow(grow, _NODE)


def build(strings: DataFrame, folder: str) -> DataFrame:
    """Compacted nodes of the trie of different strings (name, depth, names, sizes)."""
    spark = strings.sparkSession
    count, deepest = strings.agg(F.count("*"), F.max("depth")).first()
    batches = 1
    while FIRST_BATCH * GROWTH ** (batches - 1) < count:
        batches += 1
    # Batch b has drawn b / (batches - 1) of the way; every batch is GROWTH times as large as the one before.
    draw = F.pmod(F.xxhash64("name", F.lit(12)), F.lit(GROWTH ** (batches - 1)))
    number = sum((draw >= GROWTH**b).cast("int") for b in range(batches - 1)) if batches > 1 else F.lit(0)
    drawn = staged(strings.withColumn("batch", number), folder, "strings")
    root = spark.range(1).select(
        F.lit(ROOT).alias("top"), F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("up"), F.lit(-1).alias("above"), F.lit(0).alias("depth"),
        F.array(F.lit(ROOT)).alias("names"), F.array(F.lit(0).cast("bigint")).alias("sizes"), F.lit(0).cast("bigint").alias("size_above"),
    )
    trie = staged(root, folder, "trie")
    for b in range(batches):
        batch = drawn.where(F.col("batch") == b).drop("batch")
        located = staged(exits(batch, trie, deepest or 0), folder, f"located-{b}")
        trie = staged(cut_edges(trie, located).unionByName(new_nodes(located)), folder, f"trie-{b}")
    return trie


# --- numbers of subtrees -------------------------------------------------------------------------------


def subtree_sums(nodes: DataFrame, folder: str) -> DataFrame:
    """``nodes`` (name, up and the columns of _SUMS) with these columns summed over each node's subtree.

    After k steps a node has the sum over descendants less than 2^k below it, and ``up`` names its 2^k-th ancestor.
    """
    columns = list(_SUMS)
    sums, step = staged(nodes.select("name", "up", *columns), folder, "sums-0"), 0
    while not sums.where("up IS NOT NULL").isEmpty():
        below = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(*[f(c).alias(f"more_{c}") for c, f in _SUMS.items()])
        further = sums.select(F.col("name").alias("above"), F.col("up").alias("further"))
        joined = sums.join(below, "name", "left").withColumn("above", F.coalesce("up", "name")).join(further, "above", "left")
        step += 1
        sums = staged(joined.select(
            "name", F.when(F.col("up").isNotNull(), F.col("further")).alias("up"),
            *[(F.least(c, f"more_{c}") if f is F.min else F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c, f in _SUMS.items()],
        ), folder, f"sums-{step}")
    return sums.drop("up")


def member_lists(members: DataFrame) -> DataFrame:
    """(name, ids_sha256): digest of the ascending, comma-joined ids of the conversations that end at a prefix.

    Ids are joined to lists of at most CHUNK before the shuffle; a digest then takes up the lists of its prefix one
    after the other, in bounded memory. That order is what the digest is defined by, so it is one task's work.
    """
    chunk = F.floor(F.col("conv_id") / CHUNK)
    lists = members.groupBy("name", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for found, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if found != name:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = found, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["name", "ids_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["name", "ids_sha256"])

    return lists.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(digest, "name binary, ids_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """One row for each different prefix of the conversations (conv_id, turns).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), conv_id being the smallest member.
    """
    folder = scratch(conversations.sparkSession)
    members = staged(named(conversations), folder, "members")
    ends = members.groupBy("name").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    # One conversation stands for all of the same turns.
    strings = staged(members.join(ends.select(F.col("least").alias("conv_id")), "conv_id", "left_semi").drop("conv_id"), folder, "distinct")
    trie = build(strings.where("depth > 0"), folder)
    children = trie.where("up IS NOT NULL").groupBy(F.col("up").alias("name")).agg(F.count("*").alias("n_children"))
    last = F.element_at("sizes", -1)
    nodes = staged(trie.join(children, "name", "left").join(ends, "name", "left").select(
        "name", "up", "above", "sizes", "size_above", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce("n", F.lit(0)).alias("n"), "least", F.col("n_children").isNull().cast("bigint").alias("leaves"),
        (F.coalesce("n", F.lit(0)) * last).alias("member_bytes"), (last - F.col("size_above")).alias("edge_bytes"),
    ), folder, "nodes")
    sums = staged(subtree_sums(nodes, folder), folder, "sums")
    shape = nodes.select("name", "up", "above", "sizes", "size_above", "n_children", F.col("edge_bytes").alias("own_bytes"))
    parents = sums.select(F.col("name").alias("parent"), F.col("least").alias("parent_least"))
    found = shape.join(sums, "name").join(member_lists(members.select("name", "conv_id")), "name", "left")
    found = found.withColumn("parent", F.coalesce("up", "name")).join(parents, "parent")
    every = found.select("*", F.posexplode("sizes").alias("i", "size")).where("n > 0")
    is_top, is_end = F.col("i") == 0, F.col("i") == F.size("sizes") - 1
    before = F.when(is_top, F.col("size_above")).otherwise(F.get("sizes", F.col("i") - 1))
    # Bytes of all members from this depth on, less those of every different prefix once.
    different = F.col("edge_bytes") - F.col("own_bytes") + F.element_at("sizes", -1) - before
    return every.select(
        F.col("least").alias("conv_id"), (F.col("above") + 1 + F.col("i")).cast("bigint").alias("depth"),
        F.when(is_top & F.col("up").isNull(), None).when(is_top, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(is_end, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("member_bytes") - F.col("n") * before - different).alias("saved_tokens"),
        F.when(is_end & F.col("ids_sha256").isNotNull(), F.col("ids_sha256")).otherwise(F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
