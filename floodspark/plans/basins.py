"""Flagged drainage basins: rivers by crosswalk, gauges by location, then the roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import BASE_LEVEL, BASIN_LEVELS, IMPACT_FILES, RETURN_PERIOD_TIERS
from floodspark.operators import documents, forecasts, impact, placement, regions
from floodspark.operators.joins import by_merge
from floodspark.sources import polygons as polygon_source, text_files


@dataclass
class BasinInputs:
    """Parsed inputs. ``polygons`` is the ingested table of all levels, ``malformed`` the lines of the CSV inputs that
    are not as they should be; None where nobody looked."""

    crosswalk: DataFrame
    reaches: DataFrame
    gauges: DataFrame
    polygons: DataFrame
    impact_rows: DataFrame | None = None
    code_lookup: DataFrame | None = None
    tiers: tuple = RETURN_PERIOD_TIERS
    malformed: DataFrame | None = None


def read_inputs(
    spark: SparkSession, crosswalk_csv: str, reaches_csv: str, gauges_csv: str, basin_folder: str,
    impact_folder: str | None, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL, tiers=RETURN_PERIOD_TIERS,
    labels: dict[str, str] | None = None, min_mean_flow: float | None = None, **csv_options,
) -> BasinInputs:
    """Inputs from files. A missing crosswalk, reach file or polygon level is an error; missing
    gauges, exposure files or code lookup only leave their part out.

    ``tiers`` and ``labels`` replace the severity rules, ``min_mean_flow`` drops smaller rivers, and
    ``seq_column`` and ``multi_line`` (for cells that hold line breaks) go to the three CSV readers, ``multi_line`` to the exposure
    files as well. Without ``multi_line``, the lines that do not stand for themselves are told in ``malformed``.
    """
    for path in (crosswalk_csv, reaches_csv, *[polygon_source.level_file(basin_folder, v) for v in {base_level, *levels}]):
        if not text_files.path_exists(spark, path):
            raise FileNotFoundError(path)
    ingested = None
    for level in sorted({base_level, *levels}):
        raw = polygon_source.read_level_polygons(spark, basin_folder, level)
        table = polygon_source.ingest_polygons(raw, level)
        ingested = table if ingested is None else ingested.unionByName(table)
    rows = lookup = None
    if impact_folder and text_files.path_exists(spark, polygon_source.level_file(basin_folder, 12)):
        files = text_files.read_impact_files(spark, impact_folder, multi_line=csv_options.get("multi_line", False))
        if files:
            rows = text_files.parse_impact(files)
            lookup = polygon_source.read_code_lookup(spark, basin_folder)
    malformed = None
    if not csv_options.get("multi_line", False):
        paths = {"crosswalk": crosswalk_csv, "reaches": reaches_csv, "gauges": gauges_csv}
        if rows is not None:
            paths |= {name: f"{impact_folder.rstrip('/')}/{name}" for name in IMPACT_FILES}
        found = [text_files.malformed_lines(spark, path, name) for name, path in paths.items() if text_files.path_exists(spark, path)]
        malformed = reduce(DataFrame.unionByName, found)
    return BasinInputs(
        text_files.parse_crosswalk(text_files.read_crosswalk(spark, crosswalk_csv, **csv_options)),
        text_files.parse_reaches(text_files.read_reaches(spark, reaches_csv, **csv_options), tiers, min_mean_flow),
        text_files.parse_gauges(text_files.read_gauges(spark, gauges_csv, **csv_options), labels),
        ingested, rows, lookup, tiers, malformed,
    )


def base_polygons(polygons: DataFrame, base_level: int = BASE_LEVEL) -> DataFrame:
    return polygons.where(F.col("level") == base_level)


def placed_alerts(inputs: BasinInputs, base_level: int = BASE_LEVEL) -> DataFrame:
    """(hybas_id, forecast columns, list_rank, list_seq): all alerts with their base-level basin."""
    reaches = forecasts.flagged_reaches(inputs.reaches, inputs.tiers)
    river = forecasts.basin_river_alerts(forecasts.clean_crosswalk(inputs.crosswalk), reaches)
    placed = placement.place_points(inputs.gauges, base_polygons(inputs.polygons, base_level))
    inside = inputs.gauges.join(by_merge(placed), "seq")
    return forecasts.all_alerts(river, forecasts.gauge_forecasts(inside, "hybas_id"))


def tallies(alerts: DataFrame, polygons: DataFrame, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL) -> DataFrame:
    per_basin = regions.basin_tallies(alerts, base_polygons(polygons, base_level))
    return regions.level_tallies(per_basin, levels, base_level)


def features(
    level_tallies: DataFrame, polygons: DataFrame, impact_rows: DataFrame | None = None,
    code_lookup: DataFrame | None = None, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL, coded: DataFrame | None = None,
) -> DataFrame:
    """Features of all levels with ids and, where there are exposure rows, totals; no geometry. A build passes the
    exposure sums by code that it has staged."""
    region_ids = regions.first_per_code(polygons.where(F.col("level") != base_level))
    found = regions.level_features(level_tallies, region_ids)
    if coded is None:
        if impact_rows is None or code_lookup is None:
            return found
        coded = impact.coded_impact(impact_rows, code_lookup)
    return impact.with_impact(found, impact.region_impact(coded, levels))


def with_geometry(found: DataFrame, polygons: DataFrame) -> DataFrame:
    """Adds geometry, multi and the bounding box of each feature's polygon."""
    shapes = polygons.select(
        F.col("level").alias("res"), F.col("hybas_id").alias("basin_id"), F.col("parts").alias("geometry"),
        "multi", "xmin", "ymin", "xmax", "ymax",
    )
    return found.join(by_merge(shapes), ["res", "basin_id"])


REGION = ["res", "code"]


def lines(found: DataFrame, rows: DataFrame, bound: int = documents.LIST_BOUND, large: DataFrame | None = None) -> DataFrame:
    """GeoJSON lines of features with geometry; ``rows`` are the level forecasts.

    With a small bound most regions are ``large``; who has not staged them has them merged, not broadcast.
    """
    if large is None:
        large = by_merge(documents.large_regions(found, REGION, bound))
    lists = documents.forecast_lists(rows, large, REGION, ["pfaf", "list_rank", "list_seq"])
    named = found.withColumn("basin_id", F.col("basin_id").cast("string")).withColumn("cell_id", F.col("basin_id"))
    return documents.feature_lines(named, lists, large, REGION, ["cell_id", "basin_id"])
