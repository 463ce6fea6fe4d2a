"""Exposure totals per flagged region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.display import round_half_even, round_half_even_tenth
from floodspark.functions.fixed_values import (
    BASIN_LEVELS, IMPACT_FIELDS, IMPACT_WHOLE_FIELDS,
)
from floodspark.operators.dedup import keep_last
from floodspark.operators.joins import by_merge

_SUM = "decimal(38,6)"
#: Digits that a packed code can have.
MOST_DIGITS = 17


def packed_code(code: Column) -> Column:
    """A code of digits as BIGINT behind a leading 1, so that leading zeros and the length stay; others are NULL.

    Fixed width keeps first and last rules, groupings and joins on codes in hash aggregation.
    """
    return F.when(code.rlike(f"^[0-9]{{1,{MOST_DIGITS}}}$"), F.concat(F.lit("1"), code).try_cast("bigint"))


def unpacked_code(packed: Column) -> Column:
    return F.substring(packed.cast("string"), 2, MOST_DIGITS)


def packed_prefix(packed: Column, level: Column) -> Column:
    """The first ``level`` digits of a packed code; a shorter code stays."""
    surplus = F.greatest(F.length(packed.cast("string")) - 1 - level, F.lit(0))
    powers = F.array(*[F.lit(10**i) for i in range(MOST_DIGITS + 1)])
    return F.call_function("div", packed, F.get(powers, surplus))


def coded_impact(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Sums and row counts per level-12 code: (packed code, five fields, n_rows); rows without a code of digits drop.

    Summing per id first means the join sees one row per id, however often an id occurs. The lookup
    keeps the last row per id.
    """
    per_id = rows.groupBy("hybas_id").agg(
        *[F.sum(f).cast(_SUM).alias(f) for f in IMPACT_FIELDS], F.count("*").alias("n_rows")
    )
    packed = lookup.select("hybas_id", packed_code(F.col("pfaf")).alias("packed"), "seq")
    # A last row without a code still hides an earlier one.
    codes = keep_last(packed.withColumn("packed", F.coalesce("packed", F.lit(0))), ["hybas_id"], ["packed"])
    return per_id.join(by_merge(codes.where("packed > 0")), "hybas_id").drop("hybas_id")


def _coarsened(coded: DataFrame, levels) -> DataFrame:
    """Sums by the longest prefix any level needs, before rows multiply by level."""
    deepest = max(levels)
    return coded.groupBy(packed_prefix(F.col("packed"), F.lit(deepest)).alias("prefix")).agg(
        *[F.sum(f).cast(_SUM).alias(f) for f in IMPACT_FIELDS], F.sum("n_rows").alias("n_rows")
    )


def region_impact(coded: DataFrame, levels=BASIN_LEVELS, flagged: DataFrame | None = None) -> DataFrame:
    """Totals per region: (res, code, five fields). Regions without rows do not appear.

    Every level-12 basin under a region counts, whether or not its own base-level basin is flagged.
    ``flagged`` (res, code) keeps the totals of flagged regions only; a caller that joins the totals
    to its features needs no second pass over the alerts for that and leaves it out.
    """
    at_level = _coarsened(coded, levels).withColumn("res", F.explode(F.array(*[F.lit(v) for v in levels])))
    keyed = at_level.withColumn("packed", packed_prefix(F.col("prefix"), F.col("res")))
    totals = keyed.groupBy("res", "packed").agg(
        *[F.coalesce(F.sum(f), F.lit(0)).cast("double").alias(f) for f in IMPACT_FIELDS]
    ).select("res", unpacked_code(F.col("packed")).alias("code"), *IMPACT_FIELDS)
    return totals if flagged is None else totals.join(by_merge(flagged.select("res", "code")), ["res", "code"], "left_semi")


def matched_rows(coded: DataFrame, flagged: DataFrame, levels=BASIN_LEVELS) -> DataFrame:
    """One row, ``matched_rows``: input rows inside a flagged region at one level at least."""
    at_level = _coarsened(coded, levels).select(
        "prefix", "n_rows", F.explode(F.array(*[F.lit(v) for v in levels])).alias("res")
    )
    keyed = at_level.withColumn("code", unpacked_code(packed_prefix(F.col("prefix"), F.col("res"))))
    hits = keyed.join(by_merge(flagged.select("res", "code")), ["res", "code"], "left_semi")
    # All rows of a prefix hit the same levels, so each prefix counts once.
    once = hits.groupBy("prefix").agg(F.max("n_rows").alias("n_rows"))
    return once.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("matched_rows"))


def rounded(totals: DataFrame) -> DataFrame:
    """Whole numbers for counts and area, one decimal for lengths."""
    return totals.withColumns({
        f: round_half_even(F.col(f)).cast("bigint") if f in IMPACT_WHOLE_FIELDS else round_half_even_tenth(F.col(f))
        for f in IMPACT_FIELDS
    })


def with_impact(features: DataFrame, totals: DataFrame) -> DataFrame:
    """Features plus a nullable ``impact`` struct; no rows means no impact, not zeros."""
    impact = rounded(totals).select("res", "code", F.struct(*IMPACT_FIELDS).alias("impact"))
    return features.join(by_merge(impact), ["res", "code"], "left")
