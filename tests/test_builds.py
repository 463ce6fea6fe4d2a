"""Whole builds through files, and properties that hold whatever the data."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from floodspark.functions import parsing
from floodspark.functions.cells import SCHEMES
from floodspark.functions.planar import extent_of
from floodspark.operators import documents, forecasts, grid, placement, regions, serve
from floodspark.plans import basins, builds
from floodspark.sources import collections
from floodspark.testbed import fixtures
from floodspark.testbed.fixtures import LEVELS
from floodspark.testbed.queries import REGISTRY, Basins


@pytest.fixture(scope="module")
def files(spark, sf_dir, tmp_path_factory):
    """The derived inputs written out as the files the build expects."""
    folder = str(tmp_path_factory.mktemp("inputs"))

    def csv(df, name):
        # Two files whose path order is the row order, so "last wins" spans files.
        if "seq" in df.columns:
            df = df.repartitionByRange(2, "seq").sortWithinPartitions("seq")
        df.write.csv(f"{folder}/{name}", header=True, mode="overwrite")

    csv(fixtures.raw_crosswalk(spark, sf_dir), "matches.csv")
    csv(fixtures.raw_reaches(spark, sf_dir), "reaches.csv")
    csv(fixtures.raw_gauges(spark, sf_dir), "gauges.csv")
    for name, df in fixtures.raw_impact(spark, sf_dir).items():
        csv(df, f"impact/{name}")
    fixtures.raw_polygons(spark, sf_dir).drop("seq").coalesce(2).write.parquet(f"{folder}/basins/HUC08.parquet")
    for level in (4, 6):
        shapes = fixtures.coarse_shapes(spark, sf_dir, (level,)).selectExpr("hybas_id AS HYBAS_ID", "pfaf AS PFAF_ID", "parts", "seq")
        encoded = shapes.mapInArrow(fixtures._encode_wkb, "HYBAS_ID bigint, PFAF_ID string, geometry binary, seq bigint")
        encoded.drop("seq").coalesce(1).write.parquet(f"{folder}/basins/HUC{level:02d}.parquet")
    lookup = fixtures.code_lookup(spark, sf_dir).selectExpr("hybas_id AS HYBAS_ID", "cast(pfaf AS bigint) AS PFAF_ID")
    lookup.coalesce(1).write.parquet(f"{folder}/basins/HUC12.parquet")
    return folder


def read(spark, files, levels, **changes):
    paths = {
        "crosswalk_csv": f"{files}/matches.csv", "reaches_csv": f"{files}/reaches.csv", "gauges_csv": f"{files}/gauges.csv",
        "basin_folder": f"{files}/basins", "impact_folder": f"{files}/impact",
    }
    return basins.read_inputs(spark, **{**paths, **changes}, levels=levels)


@pytest.fixture(scope="module")
def built(spark, files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("basins"))
    builds.build_basins(spark, read(spark, files, (4, 6, 8)), folder, (4, 6, 8))
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_build_from_files_equals_the_tables(spark, sf_dir, built):
    expected = Basins(spark, sf_dir, (4, 6, 8), exposure=True).features
    columns = ["res", "code", "basin_id", "severity", "model_count", "models", "agree", "impact"]
    assert rows(collections.read_table(spark, built, "features").select(columns)) == rows(expected.select(columns))


def test_written_lines_are_geojson(spark, built):
    texts = [r.value for r in spark.read.text(f"{collections.published(spark, built)}/lines").collect()]
    features = [json.loads(t) for t in texts]
    assert len(features) == collections.read_table(spark, built, "features").count()
    river = [f for f in features for c in f["properties"]["forecasts"] if c["model"] == "river"]
    assert river and all(f["geometry"]["type"] == "Polygon" for f in features)
    for feature in features:
        properties = feature["properties"]
        assert list(properties)[:6] == ["res", "cell_id", "basin_id", "severity", "model_count", "forecasts"]
        assert properties["model_count"] == len(properties["forecasts"])
        assert properties.get("impact", {"population": 0})["population"] is not None
        models = [c["model"] for c in properties["forecasts"]]
        if properties["res"] == 8:
            assert models == sorted(models, key=lambda m: m != "river")
        for c in properties["forecasts"]:
            assert (c["returnPeriodYr"] == "") == (c["model"] == "gauge")
    manifest = collections.read_manifest(spark, built).collect()[0]
    assert (manifest.kind, manifest.resolutions) == ("basins-telescoping", [4, 6, 8])
    counters = {r.metric: r.value for r in spark.read.parquet(f"{collections.published(spark, built)}/report").collect()}
    assert counters["features"] == len(features) and counters["gauges_placed"] + counters["gauges_outside"] == counters["gauge_alerts"]
    malformed = spark.read.parquet(f"{collections.published(spark, built)}/malformed")
    assert malformed.columns == ["source", "file", "line", "reason"] and counters["malformed_lines"] == malformed.count()
    assert counters["malformed_quotes"] == malformed.where("reason = 'quotes'").count()


def test_lines_read_back(spark, built):
    parsed = collections.read_lines(spark, built)
    stored = collections.read_table(spark, built, "features")
    same = ["res", "cell_id", "severity", "model_count", "geometry"]
    assert rows(documents.read_feature_rows(parsed).select(same)) == rows(stored.select(same))
    fields = ["res", "cell_id", "model", "severity", "riverId", "issuedTime", "returnPeriodYr", "peakDischargeCms", "lat", "lon"]
    assert rows(documents.read_forecast_rows(parsed).select(fields)) == rows(
        collections.read_table(spark, built, "forecasts").select(fields)
    )


def test_whole_document_reads_the_same(spark, built, tmp_path):
    features = [json.loads(r.value) for r in spark.read.text(f"{collections.published(spark, built)}/lines").collect()]
    path = tmp_path / "data.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "kind": "basins-telescoping", "resolutions": ["4", 6, 8], "features": features}))
    manifest, parsed = collections.read_documents(spark, str(path))
    assert manifest.collect()[0].resolutions == [4, 6, 8]
    assert rows(parsed.select("res", "cell_id", "geometry")) == rows(collections.read_lines(spark, built).select("res", "cell_id", "geometry"))


def test_views_on_a_stored_collection(spark, built):
    tallies = collections.read_table(spark, built, "tallies")
    features = collections.read_table(spark, built, "features")
    view = tallies.where("res = 6")
    shown = serve.visible_by_model(view, ["river", "gauge"], ["cell_id"])
    assert rows(shown.select("cell_id", "severity", "model_count", "agree")) == rows(
        features.where("res = 6").select("cell_id", "severity", "model_count", "agree")
    )
    assert "PartitionFilters: [isnotnull(res" in view._jdf.queryExecution().toString()
    one = features.where("res = 8").select("cell_id").first().cell_id
    assert serve.lookup_cell(features, one).count() == 1
    assert "EqualTo(cell_id" in serve.lookup_cell(features, one)._jdf.queryExecution().toString()


def test_missing_inputs(spark, files):
    with pytest.raises(FileNotFoundError):
        read(spark, files, (8,), crosswalk_csv=f"{files}/none.csv")
    with pytest.raises(FileNotFoundError):
        read(spark, files, (5, 8))
    inputs = read(spark, files, (8,), gauges_csv=f"{files}/none.csv", impact_folder=f"{files}/none")
    assert inputs.impact_rows is None
    models = basins.placed_alerts(inputs).select("model").distinct().collect()
    assert [r.model for r in models] == ["river"]


# --- properties ----------------------------------------------------------------------------------------


def test_counts_and_worst_agree_between_levels(spark, sf_dir):
    tallies = Basins(spark, sf_dir).tallies.cache()
    per_level = tallies.groupBy("res").agg(F.sum("n").alias("n"), F.max("worst").alias("worst")).collect()
    assert len({(r.n, r.worst) for r in per_level}) == 1 and len(per_level) == len(LEVELS)
    children = tallies.where("res = 5").groupBy(F.substring("code", 1, 4).alias("code"), "model").agg(F.max("worst").alias("w"))
    parents = tallies.where("res = 4")
    assert parents.join(children, ["code", "model"]).where("w <> worst").count() == 0


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    before = rows(REGISTRY["features_with_impact"](spark, sf_dir))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows(REGISTRY["features_with_impact"](spark, sf_dir)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def winding_inside(x, y, rings):
    """Brute force by the sum of turns, independent of the crossing rule."""
    total = 0.0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            total += math.atan2((ax - x) * (by - y) - (ay - y) * (bx - x), (ax - x) * (bx - x) + (ay - y) * (by - y))
    return round(total / (2 * math.pi)) % 2 == 1


def test_placement_equals_brute_force(spark):
    rng = random.Random(5)
    polygons = []
    for i in range(40):
        cx, cy, size = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.01, 0.2, 3, 30])
        angles = sorted(rng.uniform(0, 6.28) for _ in range(9))
        shell = [[cx + size * rng.uniform(0.3, 1) * math.cos(a), cy + size * rng.uniform(0.3, 1) * math.sin(a)] for a in angles]
        polygons.append((i, str(i), i, [[shell + [shell[0]]]]))
    points = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25)) for i in range(400)]
    points += [(1000 + i, p[3][0][0][0][0] * 0.999 + 0.001, p[3][0][0][0][1]) for i, p in enumerate(polygons)]
    expected = {}
    for i, x, y in points:
        inside = [p[0] for p in polygons if winding_inside(x, y, p[3][0])]
        if inside:
            expected[i] = inside[0]
    shapes = spark.createDataFrame(polygons, "hybas_id long, pfaf string, seq long, parts array<array<array<array<double>>>>")
    shapes = shapes.withColumns(extent_of(F.col("parts")))
    df = spark.createDataFrame(points, "seq long, lon double, lat double")
    for sizes in (placement.TILE_SIZES, (5.0, 360.0)):
        assert {r.seq: r.hybas_id for r in placement.place_points(df, shapes, sizes=sizes).collect()} == expected


@pytest.mark.parametrize("scheme, resolutions", [("s2", (2, 3, 4, 5, 6, 7, 8)), ("hex", (3, 5)), ("tile", (2, 5, 9))])
def test_points_lie_in_the_box_of_their_cell(spark, scheme, resolutions):
    rng = random.Random(7)
    points = [(i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(300)]
    df = spark.createDataFrame(points, "i long, lat double, lon double")
    placed = SCHEMES[scheme].outlined(grid.addressed_points(df, scheme, resolutions))
    boxes = placed.select("i", "res", "lat", "lon", F.explode("parts").alias("part")).select(
        "i", "res", "lat", "lon", *[c.alias(n) for n, c in extent_of(F.array("part")).items()]
    )
    # Sides of S2 cells bulge a little beyond the corners; hexagons may poke over the 180th meridian.
    slack = {"s2": 12.0, "hex": 1e-6, "tile": 1e-6}[scheme]
    inside = boxes.where(
        F.col("lon").between(F.col("xmin") - slack, F.col("xmax") + slack) & F.col("lat").between(F.col("ymin") - slack, F.col("ymax") + slack)
    )
    assert inside.select("i", "res").distinct().count() == len(points) * len(resolutions)
    assert boxes.agg(F.max("xmax"), F.min("xmin")).collect()[0][0] <= 180.0


def test_s2_parents_nest(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)], "lat double, lon double")
    ids = [int(r[0].ljust(16, "0"), 16) for r in grid.cell_forecasts(df, "s2", (8,)).select("cell_id").collect()]
    found = {r.cell_id for r in grid.cell_forecasts(df, "s2", (4, 8)).where("res = 4").select("cell_id").collect()}
    low = 1 << (60 - 2 * 4)
    assert found == {f"{(i & -low) | low:016x}".rstrip("0") for i in ids}


def test_a_hot_region_is_split_and_whole(spark):
    """One region holds most rows; its documents stay bounded and no forecast is lost."""
    alerts = spark.range(3000).select(
        F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).cast("string").alias("cell_id"), F.lit(3).alias("res"),
        F.col("id").alias("list_seq"), F.lit("m").alias("model"), F.lit("danger").alias("severity"),
    )
    tallies = regions.tally(alerts, ["res", "cell_id"])
    counts = regions.summarise(tallies, ["res", "cell_id"])
    large = documents.large_regions(counts, ["res", "cell_id"], bound=200)
    lists = documents.forecast_lists(alerts, large, ["res", "cell_id"], ["list_seq"], fields=("model", "list_seq"))
    found = lists.select("cell_id", "part", "parts", "forecasts").collect()
    hot = [r for r in found if r.cell_id == "1"]
    assert len(hot) == 14 and all(r.parts == 14 for r in hot) and max(len(r.forecasts) for r in hot) < 300
    assert sorted(f.list_seq for r in found for f in r.forecasts) == list(range(3000))
    assert all([f.list_seq for f in r.forecasts] == sorted(f.list_seq for f in r.forecasts) for r in found)


def test_cell_build_through_files(spark, sf_dir, tmp_path):
    raw = fixtures.raw_points(spark, sf_dir)
    points = forecasts.usable_points(raw, parsing.float_text(F.col("lat")), parsing.float_text(F.col("lon")))
    folder = str(tmp_path / "cells")
    builds.build_cells(spark, points, folder, "s2", (2, 5))
    parsed = collections.read_lines(spark, folder)
    assert parsed.where("basin_id IS NOT NULL OR impact IS NOT NULL").count() == 0
    per_level = documents.read_forecast_rows(parsed).groupBy("res").count().collect()
    assert {r["count"] for r in per_level} == {points.count()} and len(per_level) == 2
    assert collections.read_manifest(spark, folder).collect()[0].kind == "s2-telescoping"


def test_no_shuffle_partition_gathers_a_hot_region(spark):
    """The list step regroups on (region, part), not on the region."""
    alerts = spark.range(10).selectExpr("'c' AS cell_id", "3 AS res", "id AS list_seq", "'m' AS model")
    counts = spark.createDataFrame([(3, "c", 10)], "res int, cell_id string, model_count long")
    large = documents.large_regions(counts, ["res", "cell_id"], bound=3)
    lists = documents.forecast_lists(alerts, large, ["res", "cell_id"], ["list_seq"], fields=("model",))
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "part#" in [line for line in plan.splitlines() if "Exchange hashpartitioning" in line][0]


def test_equal_rows_and_gaps_in_parts_lose_no_feature(spark):
    """3,000 forecasts that differ in their number only; and regions whose part 0 stays empty."""
    alerts = spark.range(3000).selectExpr("'c' AS cell_id", "3 AS res", "id AS list_seq", "'m' AS model", "'danger' AS severity")
    small = spark.range(400).selectExpr("concat('s', id div 4) AS cell_id", "3 AS res", "10000 + id AS list_seq", "'m' AS model", "'danger' AS severity")
    rows_in = alerts.unionByName(small)
    for bound in (2, 8, 200):
        counts = rows_in.groupBy("res", "cell_id").agg(F.count("*").alias("model_count")).withColumns({
            "severity": F.lit("danger"), "multi": F.lit(False),
            "geometry": F.expr("array(array(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 0D))))"),
        })
        full = rows_in.select("*", *[F.lit("").alias(c) for c in ("riverId", "country", "issuedTime", "startTime", "peakTime", "endTime", "historicalComparison")],
                              F.lit(7).cast("bigint").alias("returnPeriodYr"), *[F.lit(1.0).alias(c) for c in ("peakDischargeCms", "lat", "lon")])
        large = documents.large_regions(counts, ["res", "cell_id"], bound)
        lists = documents.forecast_lists(full, large, ["res", "cell_id"], ["list_seq"])
        assert lists.agg(F.max(F.size("forecasts"))).first()[0] < bound * 1.5 + 12
        parsed = documents.parse_lines(documents.feature_lines(counts, lists, large, ["res", "cell_id"], ["cell_id"]))
        assert documents.read_feature_rows(parsed).select("cell_id").distinct().count() == 101
        assert documents.read_feature_rows(parsed).count() == 101
        assert documents.read_forecast_rows(parsed).count() == 3400


def test_features_go_to_the_parts_of_their_lists(spark, tiny_skew_limits):
    """No exchange on the bare region comes after the list step."""
    alerts = spark.range(100).selectExpr("cast(id % 2 AS string) AS cell_id", "cast(id % 2 AS int) AS res", "id AS list_seq", "'m' AS model")
    counts = spark.createDataFrame([(0, "0", 50), (1, "1", 50)], "res int, cell_id string, model_count long")
    large = documents.large_regions(counts, ["res", "cell_id"], bound=3)
    lists = documents.forecast_lists(alerts, large, ["res", "cell_id"], ["list_seq"], fields=("model",))
    repeated = documents._with_parts(counts, large, ["res", "cell_id"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    # The features are shuffled once more, to the parts; the lists are not.
    assert shuffles(repeated.join(lists, ["res", "cell_id", "part", "parts"])) == shuffles(repeated) + 1 + shuffles(lists)


# --- skew ----------------------------------------------------------------------------------------------


@pytest.fixture
def tiny_skew_limits(spark):
    """Adaptive limits small enough for test data to count as skewed; no broadcasts."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key in limits:
        spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_a_hot_reach_is_split(spark, tiny_skew_limits):
    """A third of all basins share one reach; the join splits them and the count stays whole."""
    crosswalk = spark.range(60000).repartition(8).selectExpr("id AS basin_id", "if(id % 3 = 0, 7, id) AS comid")
    reaches = spark.range(60000).selectExpr(
        "id AS comid", "20L AS ret_per", "1D AS mean", "0D AS lat", "0D AS lon", "'extreme' AS severity"
    )
    counted = regions.tally(forecasts.basin_river_alerts(crosswalk, reaches), ["hybas_id"]).agg(F.sum("n"))
    assert "SortMergeJoin(skew=true)" in final_plan(counted)
    assert counted.collect()[0][0] == 60000


def test_a_hot_tile_is_split(spark, tiny_skew_limits):
    """A third of all gauges stand in one basin."""
    polygons = spark.range(400).selectExpr(
        "id AS hybas_id", "id AS seq",
        "array(array(transform(array(array(0, 0), array(1, 0), array(1, 1), array(0, 1), array(0, 0)), "
        "o -> array(id % 20 + o[0] + 0D, id div 20 + o[1] + 0D)))) AS parts",
    ).withColumns(extent_of(F.expr("parts")))
    points = spark.range(60000).repartition(8).selectExpr(
        "id AS seq", "if(id % 3 = 0, 5.5D, id % 20 + 0.25D) AS lon", "if(id % 3 = 0, 5.5D, id % 400 div 20 + 0.25D) AS lat"
    )
    counted = placement.place_points(points, polygons, sizes=(1.0, 360.0)).agg(F.count("*"))
    assert "SortMergeJoin(skew=true)" in final_plan(counted)
    assert counted.collect()[0][0] == 60000


def test_bands_hold_every_edge_on_a_parallel(spark):
    """Polygons of thousands of edges, combs with long upright teeth, level edges and holes, by the winding number."""
    rng = random.Random(21)

    def star(cx, cy, size, n):
        ring = [[cx + size * rng.uniform(0.6, 1) * math.cos(2 * math.pi * k / n), cy + size * rng.uniform(0.6, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
        return [*ring, ring[0]]

    def comb(cx, cy, teeth):
        ring = [[cx, cy]]
        for k in range(teeth):
            ring += [[cx + 2 * k, cy + 9.0], [cx + 2 * k + 1, cy + 9.0], [cx + 2 * k + 1, cy + 1.0], [cx + 2 * k + 2, cy + 1.0]]
        ring += [[cx + 2 * teeth, cy], [cx, cy]]
        return ring

    shapes = [[star(-60, 0, 10, 3000), star(-60, 0, 2, 500)], [star(0, 30, 5, 65)], [star(20, -30, 0.01, 1000)], [comb(40.5, -5.25, 40)]]
    polygons = [(i, str(i), i, [rings]) for i, rings in enumerate(shapes)]
    points = [(rng.uniform(-71, -49), rng.uniform(-11, 11)) for _ in range(150)] + [(rng.uniform(-6, 6), rng.uniform(24, 36)) for _ in range(60)]
    points += [(20 + rng.uniform(-0.01, 0.01), -30 + rng.uniform(-0.01, 0.01)) for _ in range(60)]
    points += [(40 + rng.uniform(0, 82), rng.uniform(-6, 4)) for _ in range(150)]
    # Latitudes of corners, where bands meet most often.
    points += [(-60 + rng.uniform(-5, 5), shapes[0][0][k][1]) for k in range(0, 3000, 40)]
    expected = {}
    for i, (x, y) in enumerate(points):
        inside = [p[0] for p in polygons if winding_inside(x, y, p[3][0])]
        if inside:
            expected[i] = inside[0]
    table = spark.createDataFrame(polygons, "hybas_id long, pfaf string, seq long, parts array<array<array<array<double>>>>")
    table = table.withColumns(extent_of(F.col("parts")))
    found = placement.place_points(spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "seq long, lon double, lat double"), table)
    assert {r.seq: r.hybas_id for r in found.collect()} == expected
    bands = placement.banded(table).groupBy("hybas_id").agg(F.max("n_bands").alias("n"), F.sum(F.size("edges")).alias("filed")).collect()
    assert {r.hybas_id: r.n > 1 for r in bands} == {0: True, 1: True, 2: True, 3: True}
    assert all(r.filed <= 4 * sum(len(ring) for ring in shapes[r.hybas_id]) + 64 for r in bands)


def test_hexagons_close_at_the_antimeridian(spark):
    df = spark.createDataFrame([(lat, lon) for lat in (0.0, 3.7, -41.0) for lon in (179.99, -179.99, 180.0, -180.0)], "lat double, lon double")
    for resolution in (0, 1, 3, 4):
        ids = grid.cell_forecasts(df, "hex", (resolution,)).groupBy("lat").agg(F.count_distinct("cell_id").alias("n"))
        on_equator = ids.where("lat = 0").first().n
        assert on_equator == 1 and {r.n for r in ids.collect()} <= {1, 2}


@pytest.mark.parametrize("resolution", [0, 1])
def test_hexagons_cover_the_globe_once(spark, resolution):
    """Areas in the equal-area projection add up to the globe, so no two hexagons overlap and nothing is left out."""
    df = spark.range(361 * 181 * 4).selectExpr("(id % 722) / 2D - 180 AS lon", "id div 722 / 2D - 90 AS lat").where("lat <= 90 AND lon <= 180")
    cells = grid.addressed_points(df, "hex", (resolution,)).select("res", "cell").distinct()
    # Neighbours of the rows at the poles that no point falls in have no area left.
    parts = SCHEMES["hex"].outlined(cells).select(F.explode("parts").alias("part")).collect()
    total = 0.0
    for (ring,) in (r.part for r in parts):
        plane = [(x, math.degrees(math.sin(math.radians(y)))) for x, y in ring]
        total += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(plane, plane[1:])) / 2
    assert total == pytest.approx(360 * 2 * math.degrees(1), rel=1e-3)


def test_only_cells_that_were_found_are_outlined(spark, sf_dir):
    """The formulas of an outline stay above the grouping; a filter on them used to go down to the points."""
    for name in ("hex_outlines", "tile_outlines", "s2_outlines"):
        plan = REGISTRY[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        above, below = plan.split("Aggregate [res", 1)
        assert "transform(" in above
        assert not [line for line in below.splitlines() if "Filter" in line and "transform(" in line]


@pytest.mark.parametrize("name", ["gauges_outside", "geojson_roundtrip", "geojson_features"])
def test_what_grows_is_not_broadcast(spark, sf_dir, name):
    """Polygons, codes and placed gauges look small by the file they come from; the driver never holds them."""
    df = REGISTRY[name](spark, sf_dir)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["geojson_roundtrip", "geojson_features", "cell_lines"])
def test_regions_of_several_parts_are_not_broadcast_by_the_running_plan(spark, sf_dir, name):
    """With a small bound most regions have several parts; adaptive execution used to broadcast them."""
    df = REGISTRY[name](spark, sf_dir)
    assert df.collect()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_shared_steps_of_the_lines_are_staged(spark, sf_dir):
    """Alerts, tallies, features and polygons are tables; nothing above them goes back to the exposure files."""
    plan = REGISTRY["geojson_roundtrip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan and "c_custkey" not in plan


def test_the_report_reads_the_exposure_files_once(spark, sf_dir):
    """Three counters need the exposure sums; they come from one staged table."""
    df = REGISTRY["build_report"](spark, sf_dir)
    assert "l_orderkey" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.metric: r.value for r in df.collect()}["features_with_impact"] > 0
