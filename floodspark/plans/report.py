"""Counters of a build as rows (metric, value). Every counter is an aggregate; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import BASE_LEVEL, BASIN_LEVELS, GAUGE_MODEL, RIVER_MODEL
from floodspark.operators import forecasts, grid, impact, regions
from floodspark.operators.joins import by_merge
from floodspark.plans import basins


def _metrics(one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table as (metric, value) rows."""
    entries = F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in one_row.columns
    ]))
    return one_row.select(entries.alias("m")).select("m.*")


def _count(rows: DataFrame, metric: str) -> DataFrame:
    return _metrics(rows.agg(F.count("*").alias(metric)))


def written(spark: SparkSession, counters: dict[str, int | None]) -> DataFrame:
    """Counters that a build has observed, as (metric, value) rows in one file."""
    return spark.createDataFrame([(k, int(v or 0)) for k, v in counters.items()], "metric string, value bigint").coalesce(1)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def basin_report(
    inputs: basins.BasinInputs, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL, alerts: DataFrame | None = None,
    tallies: DataFrame | None = None, found: DataFrame | None = None, coded: DataFrame | None = None,
) -> DataFrame:
    """Counters of the basin build. Who has staged tables passes them; a missing one is derived."""
    crosswalk = forecasts.clean_crosswalk(inputs.crosswalk)
    reaches = forecasts.flagged_reaches(inputs.reaches)
    base = basins.base_polygons(inputs.polygons, base_level)
    if alerts is None:
        alerts = basins.placed_alerts(inputs, base_level)
    if tallies is None:
        tallies = basins.tallies(alerts, inputs.polygons, levels, base_level)
    if found is None:
        found = basins.features(tallies, inputs.polygons, inputs.impact_rows, inputs.code_lookup, levels, base_level, coded)
    per_basin = regions.tally(alerts, ["hybas_id"])

    placed = per_basin.agg(
        F.coalesce(F.sum(F.when(F.col("model") == GAUGE_MODEL, F.col("n"))), F.lit(0)).alias("gauges_placed"),
        F.count_if(F.col("model") == RIVER_MODEL).alias("basins_river"),
    )
    gauges = inputs.gauges.agg(F.count("*").alias("gauge_alerts"))
    # Two one-row tables.
    placement_counts = gauges.select("gauge_alerts", F.lit(1).alias("one")).join(
        placed.withColumn("one", F.lit(1)), "one"
    ).select(
        "gauge_alerts", "gauges_placed", (F.col("gauge_alerts") - F.col("gauges_placed")).alias("gauges_outside"), "basins_river"
    )
    shared = _shared_codes(per_basin, base)
    features_by_level = found.groupBy("res").agg(F.count("*").alias("value")).select(
        F.concat(F.lit("features_level_"), F.col("res")).alias("metric"), "value"
    )
    tables = [
        _metrics(inputs.crosswalk.agg(F.count_if("is_hole").alias("crosswalk_holes"))),
        _count(crosswalk, "crosswalk_basins"),
        _count(forecasts.only_in_crosswalk(reaches, crosswalk), "reaches_flooding"),
        _metrics(placement_counts),
        _count(per_basin.select("hybas_id").distinct(), "basins_both"),
        _metrics(shared),
        features_by_level,
    ]
    if inputs.impact_rows is not None and inputs.code_lookup is not None:
        coded_rows = impact.coded_impact(inputs.impact_rows, inputs.code_lookup) if coded is None else coded
        tables += [
            _metrics(inputs.code_lookup.agg(F.count_distinct("hybas_id").alias("lookup_basins"))),
            _metrics(impact.matched_rows(coded_rows, tallies, levels).withColumnRenamed("matched_rows", "impact_rows_matched")),
            _metrics(found.agg(F.count("impact").alias("features_with_impact"), F.count("*").alias("features"))),
        ]
    return _union(tables)


def _shared_codes(per_basin: DataFrame, base: DataFrame) -> DataFrame:
    """Base-level regions that more than one flagged basin shares a code for."""
    coded = per_basin.join(by_merge(base.select("hybas_id", "pfaf")), "hybas_id")
    return coded.groupBy("pfaf").agg((F.max("hybas_id") != F.min("hybas_id")).alias("shared")).agg(F.count_if("shared").alias("codes_shared"))


def staged_counters(
    inputs: basins.BasinInputs, alerts: DataFrame, tallies: DataFrame, coded: DataFrame | None, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL,
) -> DataFrame:
    """Counters that need a grouping, from the staged tables of a build."""
    crosswalk = forecasts.clean_crosswalk(inputs.crosswalk)
    per_basin = regions.tally(alerts, ["hybas_id"])
    tables = [
        _count(crosswalk, "crosswalk_basins"),
        _count(forecasts.only_in_crosswalk(forecasts.flagged_reaches(inputs.reaches, inputs.tiers), crosswalk), "reaches_flooding"),
        _count(per_basin.select("hybas_id").distinct(), "basins_both"),
        _metrics(_shared_codes(per_basin, basins.base_polygons(inputs.polygons, base_level))),
    ]
    if coded is not None:
        tables += [
            _metrics(inputs.code_lookup.agg(F.count_distinct("hybas_id").alias("lookup_basins"))),
            _metrics(impact.matched_rows(coded, tallies, levels).withColumnRenamed("matched_rows", "impact_rows_matched")),
        ]
    return _union(tables)


def cell_report(points: DataFrame, usable: DataFrame, scheme: str, resolutions) -> DataFrame:
    """Counters of a grid build: points read and skipped, cells per resolution."""
    per_cell = grid.cell_tallies(usable, scheme, resolutions)
    cells = per_cell.select("res", "cell").distinct().groupBy("res").agg(F.count("*").alias("value"))
    counts = points.agg(F.count("*").alias("points")).select(F.lit("points").alias("metric"), F.col("points").alias("value"))
    kept = usable.agg(F.count("*").alias("value")).select(F.lit("points_usable").alias("metric"), "value")
    by_level = cells.select(F.concat(F.lit("cells_"), F.col("res")).alias("metric"), "value")
    return _union([counts, kept, by_level])
