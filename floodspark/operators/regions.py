"""Alerts per region: worst severity, counts, agreement, and the roll-up through the code hierarchy.

The unit of work is the *tally*, one row per (region, model) with a count and a worst rank. Tallies
are built with map-side aggregation, merge by adding, and are small whatever the skew of the alerts.
Every coarser level, and every later choice of models, is computed from tallies alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import BASE_LEVEL, BASIN_LEVELS
from floodspark.functions.severity import severity_of_rank, severity_rank
from floodspark.operators.joins import by_merge


def tally(rows: DataFrame, region: list[str]) -> DataFrame:
    """Count and worst rank per (region, model)."""
    return rows.groupBy(*region, "model").agg(
        F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst")
    )


def merge_tallies(tallies: DataFrame, region: list[str], *more: Column) -> DataFrame:
    return tallies.groupBy(*region, "model").agg(
        F.sum("n").alias("n"), F.max("worst").alias("worst"), *more
    )


def summarise(tallies: DataFrame, region: list[str], *more: Column, label=severity_of_rank) -> DataFrame:
    """Per region: severity, model_count (number of forecasts), models, agree.

    A group has one row per model, so its list of models is as short as the set of models.
    """
    grouped = tallies.groupBy(*region).agg(
        F.max("worst").alias("worst"),
        F.sum("n").alias("model_count"),
        F.array_sort(F.collect_set(F.when(F.col("model") != "", F.col("model")))).alias("models"),
        *more,
    )
    return grouped.withColumn("severity", label(F.col("worst"))).drop("worst").withColumn(
        "agree", F.size("models") >= 2
    )


def basin_tallies(alerts: DataFrame, basins: DataFrame) -> DataFrame:
    """(hybas_id, pfaf, model, n, worst) of base-level basins; alerts in unknown basins drop out."""
    return tally(alerts, ["hybas_id"]).join(by_merge(basins.select("hybas_id", "pfaf")), "hybas_id")


def level_tallies(tallies: DataFrame, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL) -> DataFrame:
    """Tallies of every level: (res, code, model, n, worst, hybas_id).

    Basins that share a code are one region. ``hybas_id`` names it at the base level and is
    NULL above, where the level's own polygon does. All levels take one shuffle.
    """
    at_level = tallies.withColumn("res", F.explode(F.array(*[F.lit(level) for level in levels])))
    is_base = F.col("res") == base_level
    keyed = at_level.select(
        "res", region_code(F.col("pfaf"), F.col("res"), base_level).alias("code"), "model", "n", "worst",
        F.when(is_base, F.col("hybas_id")).alias("hybas_id"),
    )
    return merge_tallies(keyed, ["res", "code"], F.max("hybas_id").alias("hybas_id"))


def region_code(pfaf: Column, level: Column, base_level: int = BASE_LEVEL) -> Column:
    """Code of the enclosing region; the base level keeps the full code."""
    return F.when(level == base_level, pfaf).otherwise(F.substring(pfaf, F.lit(1), level))


def first_per_code(polygons: DataFrame) -> DataFrame:
    """(res, code, region_id): the first polygon of each code and level."""
    return polygons.groupBy(F.col("level").alias("res"), F.col("pfaf").alias("code")).agg(
        F.min_by("hybas_id", "seq").alias("region_id")
    )


def level_features(tallies: DataFrame, region_ids: DataFrame) -> DataFrame:
    """Features of all levels: (res, code, basin_id, severity, model_count, models, agree).

    Regions without a polygon drop out. ``region_ids`` covers the levels above the base.
    """
    summary = summarise(tallies, ["res", "code"], F.max("hybas_id").alias("hybas_id"))
    named = summary.join(by_merge(region_ids), ["res", "code"], "left").withColumn(
        "basin_id", F.coalesce("hybas_id", "region_id")
    )
    return named.where(F.col("basin_id").isNotNull()).drop("hybas_id", "region_id")


def level_forecasts(alerts: DataFrame, basins: DataFrame, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL) -> DataFrame:
    """Every alert once per level, as rows: (res, code, pfaf, forecast columns). No shuffle beyond
    the code lookup."""
    coded = alerts.join(by_merge(basins.select("hybas_id", "pfaf")), "hybas_id")
    at_level = coded.withColumn("res", F.explode(F.array(*[F.lit(level) for level in levels])))
    return at_level.withColumn("code", region_code(F.col("pfaf"), F.col("res"), base_level))
