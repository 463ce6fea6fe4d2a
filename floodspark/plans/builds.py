"""Batch builds that write a whole collection to shared storage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import (
    BASE_LEVEL, BASIN_LEVELS, FORECAST_FIELDS, GAUGE_MODEL, HEX_RESOLUTIONS, KIND_BASINS, KIND_HEX, KIND_S2, RIVER_MODEL, S2_LEVELS,
)
from floodspark.operators import documents, forecasts, grid, impact, regions
from floodspark.operators.joins import by_merge
from floodspark.operators.points import open_points, usable
from floodspark.plans import basins, cells, report
from floodspark.session import removed, stage_folder, staged
from floodspark.sources import collections

DEFAULT_RESOLUTIONS = {"s2": S2_LEVELS, "hex": HEX_RESOLUTIONS}
KINDS = {"s2": KIND_S2, "hex": KIND_HEX}


def build_basins(
    spark: SparkSession, inputs: basins.BasinInputs, folder: str, levels=BASIN_LEVELS, base_level: int = BASE_LEVEL,
    list_bound: int = documents.LIST_BOUND, whole_documents: bool = False,
) -> None:
    """Write the collection: tables ``features``, ``tallies``, ``forecasts``, ``report`` and GeoJSON lines.

    Every input is read once: what is parsed of it, placed alerts, tallies and features are staged as tables, and a lost
    executor then costs a re-read, not a re-join. The counters of the report are taken while these tables are written, the
    rest from the staged tables. ``list_bound`` is about how many forecasts a document lists. Lines of the CSV inputs that
    are not as they should be are counted in the report and kept in the table ``malformed``. ``whole_documents`` adds the
    lines as FeatureCollections.
    """
    stage, target = stage_folder(spark, folder), collections.new_snapshot(folder)
    seen = {name: Observation(name) for name in ("crosswalk", "gauges", "alerts", "features")}
    shapes = staged(inputs.polygons, stage, "polygons")
    # Staged before they are placed: the row numbers that gauges are joined back on are then the same ones.
    inputs = replace(
        inputs, polygons=shapes, reaches=staged(inputs.reaches, stage, "reaches"),
        crosswalk=staged(inputs.crosswalk.observe(seen["crosswalk"], F.count_if("is_hole").alias("crosswalk_holes")), stage, "crosswalk"),
        gauges=staged(inputs.gauges.observe(seen["gauges"], F.count(F.lit(1)).alias("gauge_alerts")), stage, "gauges"),
        code_lookup=None if inputs.code_lookup is None else staged(inputs.code_lookup, stage, "lookup"),
    )
    coded = None
    if inputs.impact_rows is not None and inputs.code_lookup is not None:
        coded = staged(impact.coded_impact(inputs.impact_rows, inputs.code_lookup), stage, "coded")
    alerts = staged(basins.placed_alerts(inputs, base_level).observe(
        seen["alerts"], F.count_if(F.col("model") == GAUGE_MODEL).alias("gauges_placed"), F.count_if(F.col("model") == RIVER_MODEL).alias("basins_river")
    ), stage, "alerts")
    level_tallies = staged(basins.tallies(alerts, shapes, levels, base_level), stage, "tallies")
    found = basins.features(level_tallies, shapes, None, None, levels, base_level, coded)
    with_impact = [F.count("impact").alias("features_with_impact")] if coded is not None else []
    shaped = staged(basins.with_geometry(found, shapes).observe(
        seen["features"], *[F.count_if(F.col("res") == v).alias(f"features_level_{v}") for v in levels], F.count(F.lit(1)).alias("features"), *with_impact
    ), stage, "features")
    rows = regions.level_forecasts(alerts, basins.base_polygons(shapes, base_level), levels, base_level)

    ids = by_merge(shaped.select("res", "code", F.col("basin_id").cast("string").alias("cell_id")))
    collections.write_table(
        shaped.withColumn("cell_id", F.col("basin_id").cast("string")), target, "features", by="cell_id"
    )
    named = staged(level_tallies.drop("hybas_id").join(ids, ["res", "code"]), stage, "named")
    collections.write_table(named, target, "tallies", by="cell_id")
    collections.write_table(
        rows.join(ids, ["res", "code"]).select("res", "cell_id", *FORECAST_FIELDS, "list_rank", "list_seq"),
        target, "forecasts",
    )
    large = staged(documents.large_regions(shaped, basins.REGION, list_bound), stage, "large")
    collections.write_lines(basins.lines(shaped, rows, large=large), target)
    collections.write_manifest(spark, target, KIND_BASINS, levels)
    if whole_documents:
        collections.write_feature_collections(spark, target, KIND_BASINS, levels)
    counted = {k: v for one in seen.values() for k, v in one.get.items()}
    if inputs.malformed is not None:
        bad = Observation("malformed")
        kept = inputs.malformed.observe(
            bad, F.count(F.lit(1)).alias("malformed_lines"), F.count_if(F.col("reason") == "quotes").alias("malformed_quotes")
        )
        kept.write.parquet(f"{target}/malformed")
        counted |= bad.get
    counted["gauges_outside"] = counted["gauge_alerts"] - counted["gauges_placed"]
    more = report.staged_counters(inputs, alerts, level_tallies, coded, levels, base_level)
    report.written(spark, counted).unionByName(more).coalesce(1).write.parquet(f"{target}/report")
    collections.publish(spark, folder, target)
    removed(spark, stage)


def build_cells(
    spark: SparkSession, points: DataFrame, folder: str, scheme: str, resolutions=None, kind: str | None = None,
    list_bound: int = documents.LIST_BOUND, whole_documents: bool = False,
) -> None:
    """Write the collection of one grid scheme: features, tallies, forecasts, report and GeoJSON lines.

    ``points`` has lat, lon, severity and whatever other columns; points without usable coordinates are counted and left
    out, and so are those off the globe. Columns that are no forecast fields come back from ``forecasts`` and from the
    lines as members of ``payload``. The counters of the report are taken while the tables are written.
    ``kind`` is what the manifest calls the collection; the hexagon kind only selects a viewer's
    wording, the ids are the scheme's own. ``whole_documents`` adds the lines as FeatureCollections.
    """
    resolutions = tuple(resolutions or DEFAULT_RESOLUTIONS[scheme])
    stage, target = stage_folder(spark, folder), collections.new_snapshot(folder)
    read, made, tallied = Observation("points"), Observation("features"), Observation("tallies")
    opened = open_points(points)
    points = usable(opened.observe(
        read, F.count(F.lit(1)).alias("points"), F.count_if(forecasts.has_coordinate("lat", "lon")).alias("points_usable")
    ))
    if "list_seq" not in points.columns:
        # Written out with the points, so that equal ones stay apart and the number never changes.
        points = points.withColumn("list_seq", F.monotonically_increasing_id())
    points = staged(points, stage, "points")
    per_cell = staged(grid.cell_tallies(points, scheme, resolutions).observe(
        tallied, F.sum(F.when(F.col("res") == resolutions[0], F.col("n"))).alias("points_placed")
    ), stage, "tallies")
    found = cells.features(points, scheme, resolutions, per_cell)
    shaped = staged(
        found.observe(made, *[F.count_if(F.col("res") == r).alias(f"cells_{r}") for r in resolutions]), stage, "features"
    )
    rows = grid.cell_forecasts(points, scheme, resolutions)
    collections.write_table(shaped, target, "features", by="cell_id")
    named = per_cell.withColumn("cell_id", grid.cell_id(scheme, resolutions)).drop("cell")
    collections.write_table(named, target, "tallies", by="cell_id")
    collections.write_table(rows, target, "forecasts")
    large = staged(documents.large_regions(shaped, cells.REGION, list_bound), stage, "large")
    collections.write_lines(cells.lines(shaped, rows, large=large), target)
    kind = kind or KINDS.get(scheme, f"{scheme}-telescoping")
    collections.write_manifest(spark, target, kind, resolutions)
    if whole_documents:
        collections.write_feature_collections(spark, target, kind, resolutions)
    counted = {**read.get, **tallied.get, **made.get}
    skipped = {
        "points_skipped": counted["points"] - counted["points_usable"],
        "points_off_globe": counted["points_usable"] - (counted["points_placed"] or 0),
    }
    report.written(spark, {**counted, **skipped}).write.parquet(f"{target}/report")
    collections.publish(spark, folder, target)
    removed(spark, stage)
