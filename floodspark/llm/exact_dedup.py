"""Exact duplicates by distributed radix partitioning, most significant bytes first.

All documents start as one group. Every round splits each group by the next bytes of its members: 64 at first, 64
times as many each round, so that a text of any length is through after few rounds. A member that ends in a round is
told from those that go on. Groups of one drop out, groups that have ended hold equal texts, the rest goes on
with the bytes that are left. Equality is decided by the bytes alone; no digest of a text is compared.

A split is two steps. Counts and smallest ids by (group, bytes) are aggregated before the shuffle, so a group that
holds a third of all documents arrives as one row for each map task. The groups of two or more are written out, and
the members are joined to them; the join splits where many members share a group. A document's bytes move once for
each round it takes part in, and most documents take part in one.

Edge cases: NULL is the empty text, and blanks at either end count as one blank. Rows that agree in id and text are
duplicates of each other; of the rows with the smallest id one stays. A NULL id ranks last. An empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import scratch, staged, text_or_empty

FIRST_WIDTH, WIDENING = 64, 64
_BLANKS = r"[\x20\x09-\x0D]+"
_FACTS = ("group_size", "keep_id", "keep_row")


def normalised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, data, text_sha256): bytes of each text with its runs of blanks as one blank."""
    data = F.regexp_replace(text_or_empty(text), _BLANKS, " ").cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"), data.alias("data"))
    return rows.withColumn("text_sha256", F.sha2("data", 256))


def split(members: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(groups, parts) of one round: the groups of two or more, and all members by the bytes of the round.

    ``members`` has row, doc_id, group and data, the bytes that are left.
    """
    parts = members.select(
        "row", "doc_id", "group", F.substring("data", 1, width).alias("digit"), (F.octet_length("data") <= width).alias("ended"),
        F.substring("data", width + 1, 2**31 - 1).alias("data"),
    )
    groups = parts.groupBy("group", "digit", "ended").agg(
        F.count("*").alias("group_size"), F.min("doc_id").alias("keep_id"),
        F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep_row"),
    )
    return groups.where("group_size > 1"), parts


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    folder = scratch(docs.sparkSession)
    rows = staged(normalised(docs, key, text), folder, "rows")
    members, width, turn, ended = rows.select("row", "doc_id", F.lit(0).cast("bigint").alias("group"), "data"), FIRST_WIDTH, 0, []
    while True:
        groups, parts = split(members, width)
        groups = staged(groups, folder, f"groups-{turn}")
        # The groups grow with the documents: one plan for every size, which splits where a group is large.
        found = parts.join(groups.hint("merge"), ["group", "digit", "ended"])
        # The first row of a group names it from now on.
        name = F.col("keep_row").alias("group")
        if groups.where("NOT ended").isEmpty():
            ended.append(staged(found.where("ended").select("row", *_FACTS), folder, f"ended-{turn}"))
            break
        both = staged(
            found.select("row", "doc_id", "ended", *_FACTS, F.when(~F.col("ended"), F.col("data")).alias("data")),
            folder, f"members-{turn}",
        )
        ended.append(both.where("ended").select("row", *_FACTS))
        members = both.where("NOT ended").select("row", "doc_id", name, "data")
        width, turn = width * WIDENING, turn + 1
    grouped = reduce(DataFrame.unionByName, ended)
    return rows.select("row", "doc_id", "text_sha256").join(grouped, "row", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), "text_sha256",
    )
