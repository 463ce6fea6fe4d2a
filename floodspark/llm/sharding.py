"""Shards by a weighted hash tree.

A key descends from the root through regions and racks to a shard. At each level every child draws
-ln(u) / weight, u being a hash of key and child name, and the smallest draw wins; the weight of a child is
the sum of the shards below it. Where a subtree's weight grows, the draws of its siblings stay, so keys
move only into it. A shard that opens a subtree of its own therefore takes keys only into itself.

Only hash functions and arithmetic: no shuffle places a row. Edge cases: NULL ids are one key, a NULL text
has size 1; repeated rows go to the same shard and get slots of their own; an empty table gives none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a shard with a number and a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(x.weight for x in self.children) if self.children else self.own_weight


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Node:
    """Shards in racks of two and regions of two racks; those beyond the last full region open new regions."""
    region_size = per_rack * racks
    full = shards // region_size
    regions = []
    for r in range(full):
        rows = tuple(
            Node(f"region{r}/rack{k}", tuple(
                Node(f"shard{i}", shard=i)
                for i in range(r * region_size + k * per_rack, r * region_size + (k + 1) * per_rack)
            ))
            for k in range(racks)
        )
        regions.append(Node(f"region{r}", rows))
    for i in range(full * region_size, shards):
        regions.append(Node(f"single{i}", (Node(f"single{i}/rack0", (Node(f"shard{i}", shard=i),)),)))
    return Node("root", tuple(regions))


def placed(key: Column, node: Node) -> Column:
    """Number of the shard that the key descends to."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return placed(key, node.children[0])
    draws = []
    for child in node.children:
        # 52 bits of the hash as a number strictly between 0 and 1.
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 12).cast("double") + 0.5) / F.lit(math.pow(2, 52))
        draws.append(-F.log(u) / F.lit(child.weight))
    least = F.least(*draws)
    # Equal draws go to the first child.
    chosen = F.when(draws[0] == least, placed(key, node.children[0]))
    for draw, child in zip(draws[1:-1], node.children[1:-1], strict=True):
        chosen = chosen.when(draw == least, placed(key, child))
    return chosen.otherwise(placed(key, node.children[-1]))


def numbered(rows: DataFrame, shard: str, order: list[str], slot: str = "slot", bucket_rows: int = 20_000) -> DataFrame:
    """Adds gapless numbers from 0 within each shard.

    Rows are numbered within hash buckets of a shard, about ``bucket_rows`` each, and the counts of the
    buckets before are added; no task sees a whole shard.
    """
    buckets = max(1, -(-rows.count() // bucket_rows))
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(shard, "_bucket").agg(F.count("*").alias("_n")).select(
        shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    return (
        spread.withColumn("_inside", inside - 1).join(starts, [shard, "_bucket"])
        .withColumn(slot, F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")
    )


def shard_documents(
    docs: DataFrame, tree: Node, grown: Node, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard) for each document: place before and after growth."""
    ident = F.struct(F.col(f"`{id_column}`").cast("string"))
    content = F.col(f"`{text}`").cast("string")
    return docs.select(
        F.col(f"`{id_column}`").alias("doc_id"),
        (F.coalesce(F.octet_length(content), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(content, F.lit("")).cast("binary")).alias("text_crc32"),
        placed(F.xxhash64(ident), tree).cast("int").alias("shard"),
        placed(F.xxhash64(ident), grown).cast("int").alias("grown_shard"),
    )
