"""Registered queries: each one runs library operators over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions import display, parsing
from floodspark.functions.cells import tile_index
from floodspark.functions.fixed_values import (
    HEX_RESOLUTIONS, IMPACT_FIELDS, RIVER_MODEL, S2_LEVELS,
)
from floodspark.functions.severity import severity_of_rank, severity_rank, shown_severity_of_rank
from floodspark.operators import documents, forecasts, grid, impact, placement, regions, serve
from floodspark.plans import basins, builds, cells, report, serving
from floodspark.session import staged
from floodspark.sources import collections, polygons as polygon_source
from floodspark.testbed import fixtures
from floodspark.testbed.fixtures import LEVELS

TILE_ZOOMS = (3, 5, 7)
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def models_text():
    return F.array_join("models", ",").alias("models")


def as_microdegrees(*names: str):
    return [F.round(F.col(n) * 1e6).cast("bigint").alias(n) for n in names]


# --- shared steps ------------------------------------------------------------------------------------


class Basins:
    """The basin build over the derived tables, each step made once per query."""

    def __init__(self, spark, sf_dir, levels=LEVELS, exposure: bool = False):
        self.levels = levels
        self.inputs = fixtures.basin_inputs(spark, sf_dir, levels, exposure)

    @cached_property
    def alerts(self):
        return basins.placed_alerts(self.inputs)

    @cached_property
    def tallies(self):
        return basins.tallies(self.alerts, self.inputs.polygons, self.levels)

    @cached_property
    def features(self):
        return basins.features(
            self.tallies, self.inputs.polygons, self.inputs.impact_rows, self.inputs.code_lookup, self.levels
        )

    @cached_property
    def shaped(self):
        return basins.with_geometry(self.features, self.inputs.polygons)

    @cached_property
    def forecasts(self):
        return regions.level_forecasts(self.alerts, basins.base_polygons(self.inputs.polygons), self.levels)

    @cached_property
    def coded_impact(self):
        return impact.coded_impact(self.inputs.impact_rows, self.inputs.code_lookup)


def _points(spark, sf_dir):
    raw = fixtures.raw_points(spark, sf_dir)
    return forecasts.usable_points(raw, parsing.float_text(F.col("lat")), parsing.float_text(F.col("lon")))


# --- inputs ------------------------------------------------------------------------------------------


@query
def crosswalk_clean(spark, sf_dir):
    return forecasts.clean_crosswalk(fixtures.crosswalk(spark, sf_dir))


@query
def crosswalk_holes(spark, sf_dir):
    return fixtures.crosswalk(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_if("is_hole").alias("n_holes")
    )


@query
def reach_flagged(spark, sf_dir):
    flagged = forecasts.flagged_reaches(fixtures.reaches(spark, sf_dir))
    return forecasts.only_in_crosswalk(flagged, forecasts.clean_crosswalk(fixtures.crosswalk(spark, sf_dir)))


@query
def gauge_alerts(spark, sf_dir):
    return fixtures.gauges(spark, sf_dir).select(
        "gauge_id", "severity", "lat", "lon", "country", "issued", "starts", "ends"
    )


@query
def severity_ranks(spark, sf_dir):
    labelled = fixtures.table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("CASE event_type WHEN 'click' THEN 'Warning' WHEN 'signup' THEN 'DANGER' "
               "WHEN 'purchase' THEN 'extreme' WHEN 'view' THEN 'none' END").alias("label"),
    )
    ranked = labelled.withColumn("rank", severity_rank(F.col("label")))
    return ranked.select(
        "event_id", "rank", severity_of_rank(F.col("rank")).alias("built"),
        shown_severity_of_rank(F.col("rank")).alias("shown"),
    )


@query
def parsed_numbers(spark, sf_dir):
    text = F.expr("""CASE l_linenumber WHEN 1 THEN cast(l_partkey AS string)
        WHEN 2 THEN concat(' ', l_partkey, ' ') WHEN 3 THEN concat(l_partkey, '.9')
        WHEN 4 THEN concat('-', l_partkey, '.5e0') WHEN 5 THEN concat(l_partkey, 'd')
        WHEN 6 THEN '' ELSE 'nan' END""")
    rows = fixtures.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return rows.select(
        "l_orderkey", "l_linenumber", parsing.strict_int(F.col("text")).alias("strict"),
        parsing.truncated_int(F.col("text")).alias("truncated"),
        parsing.finite(parsing.float_text(F.col("text"))).alias("number"),
    )


@query
def polygon_ingest(spark, sf_dir):
    ingested = polygon_source.ingest_polygons(fixtures.raw_polygons(spark, sf_dir), 8)
    return ingested.select(
        "level", "hybas_id", "pfaf", "multi", F.size(F.col("parts")[0]).alias("n_rings"),
        F.expr("size(flatten(flatten(parts)))").alias("n_points"), "xmin", "ymin", "xmax", "ymax",
    )


@query
def usable_point_counts(spark, sf_dir):
    raw = fixtures.raw_points(spark, sf_dir)
    numbers = raw.select(*[parsing.float_text(F.col(c)).alias(c) for c in ("lat", "lon")])
    usable = forecasts.has_coordinate("lat", "lon")
    return numbers.agg(F.count_if(usable).alias("usable"), F.count_if(~usable).alias("skipped"))


# --- alerts and basins -------------------------------------------------------------------------------


@query
def basin_river_alerts(spark, sf_dir):
    river = forecasts.basin_river_alerts(
        forecasts.clean_crosswalk(fixtures.crosswalk(spark, sf_dir)),
        forecasts.flagged_reaches(fixtures.reaches(spark, sf_dir)),
    )
    return regions.summarise(regions.tally(river, ["hybas_id"]), ["hybas_id"]).select(
        "hybas_id", "severity", "model_count"
    )


@query
def forecast_union(spark, sf_dir):
    return Basins(spark, sf_dir, (8,)).alerts.drop("list_rank", "list_seq")


@query
def gauge_in_basin(spark, sf_dir):
    inputs = fixtures.basin_inputs(spark, sf_dir, (8,))
    return placement.place_points(inputs.gauges, inputs.polygons).withColumnRenamed("seq", "event_id")


@query
def gauges_outside(spark, sf_dir):
    inputs = fixtures.basin_inputs(spark, sf_dir, (8,))
    placed = placement.place_points(inputs.gauges, inputs.polygons)
    return placement.split_placed(inputs.gauges, placed)[1].select("gauge_id", "severity")


@query
def basin_features(spark, sf_dir):
    return Basins(spark, sf_dir, (8,)).features.select("res", "basin_id", "severity", "model_count", models_text(), "agree")


@query
def rollup_levels(spark, sf_dir):
    return Basins(spark, sf_dir).tallies.select("res", "code", "model", "n", "worst")


@query
def level_features(spark, sf_dir):
    return Basins(spark, sf_dir).shaped.select(
        "res", "code", "basin_id", "severity", "model_count", models_text(), "agree", "xmin", "ymin", "xmax", "ymax"
    )


@query
def level_forecasts(spark, sf_dir):
    return Basins(spark, sf_dir).forecasts.select("res", "code", "model", "severity", "riverId")


@query
def build_report(spark, sf_dir):
    """Counters taken from tables; what several of them count is staged, so the exposure files are read once."""
    run, stage = Basins(spark, sf_dir, exposure=True), fixtures.collection_folder(spark)
    coded = staged(run.coded_impact, stage, "coded")
    run.alerts = staged(run.alerts, stage, "alerts")
    run.tallies = staged(run.tallies, stage, "tallies")
    found = staged(basins.features(run.tallies, run.inputs.polygons, levels=LEVELS, coded=coded), stage, "features")
    return report.basin_report(run.inputs, LEVELS, alerts=run.alerts, tallies=run.tallies, found=found, coded=coded)


@query
def stored_report(spark, sf_dir):
    """The same counters as a build takes them while it writes."""
    folder = fixtures.collection_folder(spark)
    builds.build_basins(spark, fixtures.basin_inputs(spark, sf_dir, exposure=True), folder, LEVELS)
    return collections.read_report(spark, folder)


@query
def point_report(spark, sf_dir):
    raw = fixtures.raw_points(spark, sf_dir)
    return report.cell_report(raw, _points(spark, sf_dir), "s2", S2_LEVELS)


# --- exposure ----------------------------------------------------------------------------------------


@query
def impact_by_region(spark, sf_dir):
    run = Basins(spark, sf_dir, exposure=True)
    return impact.region_impact(run.coded_impact, LEVELS, run.tallies)


@query
def features_with_impact(spark, sf_dir):
    return Basins(spark, sf_dir, exposure=True).features.select(
        "res", "basin_id", "severity", "model_count", *[F.col("impact")[f].alias(f) for f in IMPACT_FIELDS]
    )


@query
def impact_matched_rows(spark, sf_dir):
    run = Basins(spark, sf_dir, exposure=True)
    return impact.matched_rows(run.coded_impact, run.tallies, LEVELS)


@query
def rounded_values(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        display.round_half_even_tenth(F.col("l_extendedprice")).alias("tenth"),
        display.round_half_even(F.col("l_extendedprice") / 2).cast("bigint").alias("whole"),
    )


# --- grids -------------------------------------------------------------------------------------------


def _rollup(scheme, resolutions):
    def run(spark, sf_dir):
        points = _points(spark, sf_dir)
        found = grid.cell_features(grid.cell_tallies(points, scheme, resolutions), scheme, resolutions)
        return found.select("res", "cell_id", "severity", "model_count", models_text(), "agree")
    return run


REGISTRY["s2_rollup"] = _rollup("s2", S2_LEVELS)
REGISTRY["hex_rollup"] = _rollup("hex", HEX_RESOLUTIONS)
REGISTRY["tile_rollup"] = _rollup("tile", TILE_ZOOMS)


def _outlines(scheme, resolutions):
    def run(spark, sf_dir):
        shaped = cells.features(_points(spark, sf_dir), scheme, resolutions)
        return shaped.select("res", "cell_id", "multi", *as_microdegrees("xmin", "ymin", "xmax", "ymax"))
    return run


REGISTRY["s2_outlines"] = _outlines("s2", S2_LEVELS)
REGISTRY["hex_outlines"] = _outlines("hex", HEX_RESOLUTIONS)
REGISTRY["tile_outlines"] = _outlines("tile", TILE_ZOOMS)


@query
def ready_cell_rollup(spark, sf_dir):
    """Cell ids that the points bring along; cells without a river point have no outline and drop out."""
    at = tile_index(F.col("lon"), F.col("lat"), F.lit(6))
    points = _points(spark, sf_dir).withColumn("ready", (at["x"] * 64 + at["y"]).cast("string"))
    outlines = points.where(F.col("model") == RIVER_MODEL).select(F.col("ready").alias("cell_id")).distinct()
    outlines = outlines.withColumn("parts", F.expr("array(array(array(array(0D, 0D))))"))
    return grid.ready_cell_features(points, {6: "ready"}, outlines).select(
        "res", "cell_id", "severity", "model_count"
    )


@query
def map_tiles(spark, sf_dir):
    gauges = fixtures.gauges(spark, sf_dir)
    at = tile_index(F.col("lon"), F.col("lat"), F.lit(9))
    return gauges.select("gauge_id", at["x"].alias("tile_x"), at["y"].alias("tile_y"))


# --- serving -----------------------------------------------------------------------------------------


@query
def visible_by_model(spark, sf_dir):
    shown = serve.visible_by_model(Basins(spark, sf_dir).tallies, [RIVER_MODEL], ["res", "code"])
    return shown.select("res", "code", "severity", "model_count", models_text(), "agree")


@query
def visible_forecasts(spark, sf_dir):
    rows = serve.visible_forecasts(Basins(spark, sf_dir, (8,)).alerts, [RIVER_MODEL])
    return rows.select("hybas_id", "model", "severity", "riverId")


@query
def zoom_resolution(spark, sf_dir):
    zooms = fixtures.table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 40 / 2D AS zoom")
    return serve.at_zoom(zooms, HEX_RESOLUTIONS)


@query
def features_by_resolution(spark, sf_dir):
    return serve.features_by_resolution(Basins(spark, sf_dir).features, declared=[3, 4, 5, 8])


@query
def model_list(spark, sf_dir):
    return serve.model_list(Basins(spark, sf_dir).tallies, LEVELS)


@query
def extent(spark, sf_dir):
    return serve.extent(Basins(spark, sf_dir).shaped, ["res"])


@query
def feature_detail(spark, sf_dir):
    return serve.feature_detail(Basins(spark, sf_dir, (8,)).alerts, "hybas_id", "riverId")


@query
def detail_rows(spark, sf_dir):
    return serve.detail_rows(Basins(spark, sf_dir, (8,)).alerts, "hybas_id", "riverId")


@query
def impact_display(spark, sf_dir):
    return serve.impact_display(Basins(spark, sf_dir, exposure=True).features, "res", "basin_id")


@query
def compact_counts(spark, sf_dir):
    prices = fixtures.table(spark, sf_dir, "orders")
    return prices.select(
        "o_orderkey", display.compact_count(F.col("o_totalprice")).alias("price"),
        display.compact_count(F.col("o_totalprice") * 1000).alias("thousandfold"),
        display.compact_count(F.col("o_totalprice") / 1000).alias("thousandth"),
    )


@query
def model_labels(spark, sf_dir):
    names = fixtures.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "concat(lower(c_mktsegment), '_model-', c_custkey, '_x') AS model"
    )
    return names.select("c_custkey", display.model_label(F.col("model")).alias("label"))


@query
def url_components(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(display.url_component(F.col("text"))).alias("encoded_md5")
    )


@query
def agreement(spark, sf_dir):
    return serve.agreement(Basins(spark, sf_dir).features, "res", "code")


@query
def lookup_cell(spark, sf_dir):
    named = Basins(spark, sf_dir).features.withColumn("cell_id", F.col("basin_id").cast("string"))
    return serve.lookup_cell(named, "8000000001").select("res", "cell_id", "severity", "model_count")


@query
def empty_check(spark, sf_dir):
    return serve.is_empty(Basins(spark, sf_dir).features, LEVELS)


# --- documents ---------------------------------------------------------------------------------------


def _lines(spark, sf_dir, bound=documents.LIST_BOUND):
    """What several steps use is staged, as in a build, so one plan does not derive it again for each of them."""
    run, stage = Basins(spark, sf_dir, exposure=True), fixtures.collection_folder(spark)
    run.inputs = replace(run.inputs, polygons=staged(run.inputs.polygons, stage, "polygons"))
    run.alerts = staged(run.alerts, stage, "alerts")
    run.tallies = staged(run.tallies, stage, "tallies")
    return basins.lines(staged(run.shaped, stage, "features"), run.forecasts, bound)


@query
def geojson_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query
def geojson_roundtrip(spark, sf_dir):
    """Lists cut into parts of about eight, written as lines and read back as rows."""
    rows = documents.read_forecast_rows(documents.parse_lines(_lines(spark, sf_dir, bound=8)))
    return rows.groupBy("res", "cell_id", "model").agg(
        F.count("*").alias("n"), F.sum("returnPeriodYr").alias("years"),
        F.min("lat").alias("south"), F.max("lon").alias("east"),
    )


@query
def geojson_features(spark, sf_dir):
    # Features of several parts are found by a join of the lines with themselves.
    lines = staged(_lines(spark, sf_dir, bound=8), fixtures.collection_folder(spark), "lines")
    read = documents.read_feature_rows(documents.parse_lines(lines))
    return read.select(
        "res", "cell_id", "basin_id", "severity", "model_count", F.col("impact.population").alias("population"),
        F.expr("size(geometry[0])").alias("n_rings"),
    )


@query
def cell_lines(spark, sf_dir):
    points = _points(spark, sf_dir)
    found = cells.features(points, "tile", TILE_ZOOMS)
    rows = grid.cell_forecasts(points, "tile", TILE_ZOOMS)
    parsed = documents.parse_lines(cells.lines(found, rows, bound=50))
    back = documents.read_forecast_rows(parsed)
    return back.groupBy("res", "cell_id").agg(
        F.count("*").alias("n"), F.count("returnPeriodYr").alias("n_rivers"), F.min("lon").alias("west")
    )


# --- stored collections ------------------------------------------------------------------------------


@query
def open_point_cells(spark, sf_dir):
    """Points without a model and with columns of their own, built into cells and read back from the lines."""
    folder = fixtures.collection_folder(spark)
    builds.build_cells(spark, fixtures.open_points(spark, sf_dir), folder, "tile", TILE_ZOOMS)
    rows = documents.read_forecast_rows(collections.read_lines(spark, folder, payload=True))
    own = rows.select(
        "res", "cell_id", "model", F.try_variant_get("payload", "$['station.name']", "string").alias("station"),
        F.try_variant_get("payload", "$.reading.level", "double").alias("level"),
        F.try_variant_get("payload", "$.reading.unit", "string").alias("unit"),
    )
    summed = own.groupBy("res", "cell_id").agg(
        F.count("*").alias("n"), F.sum("level").alias("levels"), F.min("station").alias("station"), F.max("unit").alias("unit"),
        F.count_if(F.col("model") != "").alias("with_model"),
    )
    stored = collections.read_table(spark, folder, "features").select("res", "cell_id", "severity", "model_count", models_text(), "agree")
    return stored.join(summed, ["res", "cell_id"])


@query
def open_point_report(spark, sf_dir):
    """Counters that a grid build takes while it writes."""
    folder = fixtures.collection_folder(spark)
    builds.build_cells(spark, fixtures.open_points(spark, sf_dir), folder, "tile", TILE_ZOOMS)
    return collections.read_report(spark, folder)


@query
def serving_view(spark, sf_dir):
    """A stored collection at zoom 5 as the river model alone makes it, with geometry and exposure."""
    folder = fixtures.collection_folder(spark)
    builds.build_basins(spark, fixtures.basin_inputs(spark, sf_dir, exposure=True), folder, LEVELS)
    view = serving.open_view(spark, folder, zoom=5, models=[RIVER_MODEL])
    listed = view.forecasts.groupBy("res", "cell_id").agg(F.count("*").alias("n_listed"), F.sum("returnPeriodYr").alias("years"))
    # One row.
    frame = view.extent.select("west", "south", "east", "north", F.lit(view.res).alias("res"))
    return view.features.join(listed, ["res", "cell_id"]).join(frame, "res").select(
        "res", "cell_id", "severity", "model_count", models_text(), "agree", "xmin", "ymax", F.size(F.col("geometry")[0]).alias("n_rings"),
        *[F.col("impact")[f].alias(f) for f in IMPACT_FIELDS], "n_listed", "years", "west", "south", "east", "north",
    )


@query
def stored_lookup(spark, sf_dir):
    """One feature of a stored collection by resolution and id."""
    folder = fixtures.collection_folder(spark)
    builds.build_cells(spark, fixtures.open_points(spark, sf_dir), folder, "tile", TILE_ZOOMS)
    stored = collections.read_table(spark, folder, "features")
    first = stored.where("res = 7").agg(F.min("cell_id")).first()[0]
    return serve.lookup_cell(stored, first, 7).select("res", "cell_id", "severity", "model_count")


@query
def resolution_forms(spark, sf_dir):
    parsed = documents.parse_lines(fixtures.feature_forms(spark, sf_dir))
    return parsed.select("cell_id", "res", serve.default_resolution(F.col("res")).alias("counted_as"))
