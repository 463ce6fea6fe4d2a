"""Points with columns of their own, published snapshots, views and lookups on stored collections."""

import json
import math

import pytest
from pyspark.sql import functions as F

from floodspark.operators import documents, serve
from floodspark.operators.points import open_points, usable
from floodspark.plans import builds, serving
from floodspark.sources import collections
from floodspark.testbed import fixtures


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def basin_folder(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("served"))
    builds.build_basins(spark, fixtures.basin_inputs(spark, sf_dir, (4, 6, 8), exposure=True), folder, (4, 6, 8))
    return folder


# --- points of any columns -----------------------------------------------------------------------------


ODD = "lat string, lon double, severity string, `a.b` string, `quo\"te` int, payload double, nested struct<x: array<int>, y: string>"
ODD_ROWS = [
    ("10.5", 20.0, "danger", "é \" \\", 1, 2.5, ([1, 2], None)), (" 11 ", 20.5, "EXTREME", None, None, math.nan, None),
    ("x", 1.0, "danger", "no place", 3, 1.0, None), (None, 1.0, "danger", "no place", 3, 1.0, None),
    ("95", 1.0, "danger", "off the globe", 3, 1.0, None), ("10.5", 20.0, None, "no severity", 4, 0.0, ([], "y")),
]


def test_any_columns_go_through_a_build_and_back(spark, tmp_path):
    folder = str(tmp_path / "cells")
    builds.build_cells(spark, spark.createDataFrame(ODD_ROWS, ODD), folder, "tile", (2, 4))
    texts = [r.value for r in spark.read.text(f"{collections.published(spark, folder)}/lines").collect()]
    listed = [f for t in texts for f in json.loads(t)["properties"]["forecasts"]]
    assert len(listed) == 6 and all(list(f)[:4] == ["model", "severity", "lat", "lon"] for f in listed)
    first = next(f for f in listed if f["severity"] == "danger")
    assert (first["a.b"], first['quo"te'], first["payload"], first["nested"]["x"]) == ("é \" \\", 1, 2.5, [1, 2])
    back = documents.read_forecast_rows(collections.read_lines(spark, folder, payload=True)).where("res = 2")
    own = back.select("severity", "lat", F.try_variant_get("payload", "$['a.b']", "string"), F.try_variant_get("payload", "$.nested.x[1]", "int"))
    assert rows(own) == rows(spark.createDataFrame([("danger", 10.5, "é \" \\", 2), ("EXTREME", 11.0, None, None), (None, 10.5, "no severity", None)],
                                                   "a string, b double, c string, d int"))
    counters = {r.metric: r.value for r in collections.read_report(spark, folder).collect()}
    assert counters == {
        "points": 6, "points_usable": 4, "points_placed": 3, "points_skipped": 2, "points_off_globe": 1, "cells_2": 1, "cells_4": 1,
    }


def test_points_without_further_columns_have_no_payload(spark, tmp_path):
    points = spark.createDataFrame([(1.0, 2.0, "danger")], "lat double, lon double, severity string")
    assert open_points(points).columns == ["model", "severity", "lat", "lon"]
    builds.build_cells(spark, points, str(tmp_path / "cells"), "s2", (3,))
    (feature,) = collections.read_table(spark, str(tmp_path / "cells"), "features").collect()
    assert (feature.severity, feature.model_count, feature.models, feature.agree) == ("danger", 1, [], False)


def test_points_need_a_place_and_a_severity(spark):
    with pytest.raises(ValueError, match="severity"):
        open_points(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"))
    none = spark.createDataFrame([], "lat double, lon double, severity string, more string")
    assert usable(open_points(none)).count() == 0


def test_a_build_of_no_points(spark, tmp_path):
    none = spark.createDataFrame([], "lat double, lon double, severity string, more string")
    builds.build_cells(spark, none, str(tmp_path / "cells"), "hex", (3, 4))
    counters = {r.metric: r.value for r in collections.read_report(spark, str(tmp_path / "cells")).collect()}
    assert set(counters.values()) == {0} and len(counters) == 7


# --- views ---------------------------------------------------------------------------------------------


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "FileScan parquet" in line]


def test_a_view_reads_one_resolution(spark, basin_folder):
    view = serving.open_view(spark, basin_folder, zoom=4.5)
    assert (view.res, view.resolutions) == (6, (4, 6, 8))
    stored = collections.read_table(spark, basin_folder, "features").where("res = 6")
    same = ["cell_id", "basin_id", "severity", "model_count", "models", "agree", "geometry", "impact"]
    assert rows(view.features.select(same)) == rows(stored.select(same))
    for table in (view.features, view.forecasts):
        found = scans(table)
        assert found and all("PartitionFilters: [isnotnull(res" in x for x in found)
    assert [r.model for r in view.models.collect()] == ["gauge", "river"]


def test_a_view_of_one_model(spark, basin_folder):
    view = serving.open_view(spark, basin_folder, zoom=99, models=["gauge"])
    every = collections.read_table(spark, basin_folder, "forecasts").where("res = 8 AND model = 'gauge'")
    assert {r.cell_id for r in view.features.collect()} == {r.cell_id for r in every.select("cell_id").distinct().collect()}
    assert view.forecasts.count() == every.count()
    lines = [json.loads(r.line) for r in serving.view_lines(view, bound=3).collect()]
    listed = [c for f in lines for c in f["properties"]["forecasts"]]
    assert len(listed) == every.count() and {c["model"] for c in listed} == {"gauge"}
    totals = {f["properties"]["cell_id"]: f["properties"]["model_count"] for f in lines}
    assert totals == {r.cell_id: r.model_count for r in view.features.collect()}
    assert any("impact" in f["properties"] for f in lines)


def test_a_view_of_a_window(spark, basin_folder):
    whole = serving.open_view(spark, basin_folder, zoom=99)
    box = whole.features.select("xmin", "ymin", "xmax", "ymax", "cell_id").first()
    part = serving.open_view(spark, basin_folder, zoom=99, window=(box.xmin, box.ymin, box.xmin + 1e-3, box.ymin + 1e-3))
    found = {r.cell_id for r in part.features.collect()}
    assert box.cell_id in found and len(found) < whole.features.count()
    assert {r.cell_id for r in part.forecasts.select("cell_id").distinct().collect()} == found


def test_default_models_are_those_of_the_coarsest_resolution(spark, tmp_path):
    folder = str(tmp_path / "own")
    snapshot = collections.new_snapshot(folder)
    tallies = [(1, "a", "m", 1, 2), (2, "b", "m", 1, 1), (2, "b", "late", 4, 3), (2, "c", "late", 1, 3), (2, "d", "", 1, 3)]
    collections.write_table(spark.createDataFrame(tallies, "res int, cell_id string, model string, n long, worst int"), snapshot, "tallies", by="cell_id")
    shapes = [(r, c, 0.0, 0.0, 1.0, 1.0) for r, c in ((1, "a"), (2, "b"), (2, "c"), (2, "d"))]
    collections.write_table(spark.createDataFrame(shapes, "res int, cell_id string, xmin double, ymin double, xmax double, ymax double"), snapshot, "features")
    collections.write_table(spark.createDataFrame([(2, "b", "m")], "res int, cell_id string, model string"), snapshot, "forecasts")
    collections.write_manifest(spark, snapshot, "own", [])
    collections.publish(spark, folder, snapshot)
    view = serving.open_view(spark, folder, zoom=4)
    assert [(r.cell_id, r.severity, r.model_count) for r in view.features.collect()] == [("b", "warning", 1)]


@pytest.mark.parametrize("zoom, res", [(0, 3), (2, 3), (3.9, 3), (4, 4), (8, 6), (19, 6), (1e12, 6), (-1e300, 3), (math.inf, 6)])
def test_any_zoom_has_a_resolution(spark, zoom, res):
    assert serve.resolution_at(zoom, (6, 3, 5, 4)) == res
    asked = spark.createDataFrame([(float(zoom),)], "zoom double")
    assert serve.at_zoom(asked, (3, 4, 5, 6)).first().res == res


# --- stored tables ---------------------------------------------------------------------------------------


def test_a_lookup_reads_the_file_of_its_id(spark, tmp_path):
    folder = str(tmp_path / "own")
    wide = spark.range(20_000).selectExpr("cast(id % 2 AS int) AS res", "lpad(id, 8, '0') AS cell_id", "id AS v").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        collections.write_table(wide, folder, "features", by="cell_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = collections.read_table(spark, folder, "features")
    ranges = stored.where("res = 1").groupBy(F.input_file_name()).agg(F.min("cell_id").alias("low"), F.max("cell_id").alias("high")).collect()
    assert len(ranges) > 1 and sum(r.low <= "00004321" <= r.high for r in ranges) == 1
    one = serve.lookup_cell(stored, "00004321", 1)
    assert [r.v for r in one.collect()] == [4321]
    metrics = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert metrics.apply("numOutputRows").value() <= 10_000 / len(ranges) * 2


def test_a_build_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "cells")
    columns = "lat double, lon double, severity string, model string"
    builds.build_cells(spark, spark.createDataFrame([(1.0, 2.0, "danger", "a")], columns), folder, "tile", (3,))
    before = collections.published(spark, folder)

    def fail(*args):
        raise OSError("no more space")

    later = spark.createDataFrame([(1.0, 2.0, "extreme", "b"), (40.0, 2.0, "extreme", "b")], columns)
    with monkeypatch.context() as patch:
        patch.setattr(collections, "write_lines", fail)
        with pytest.raises(OSError):
            builds.build_cells(spark, later, folder, "tile", (3,))
    assert collections.published(spark, folder) == before
    assert [r.severity for r in serving.open_view(spark, folder).features.collect()] == ["danger"]
    opened = collections.read_table(spark, folder, "features")
    builds.build_cells(spark, later, folder, "tile", (3,))
    assert collections.published(spark, folder) != before
    assert {r.severity for r in serving.open_view(spark, folder).features.collect()} == {"extreme"}
    # A reader that came before still reads what it has opened.
    assert opened.count() == 1
