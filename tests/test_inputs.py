"""No value of an input ends a job, and every kind of input has one row order."""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from floodspark.operators import impact
from floodspark.plans import builds
from floodspark.sources import collections, polygons, text_files
from floodspark.testbed import fixtures
from floodspark.testbed.queries import REGISTRY

SQUARE = fixtures._SQUARE


def wkb():
    import struct

    body = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", len(SQUARE))
    return body + b"".join(struct.pack("<dd", *p) for p in SQUARE)


@pytest.mark.parametrize("kind, ids", [
    ("string", ["7", " 8 ", "n/a", "9.0", "", None]), ("double", [7.0, 8.0, float("nan"), 9.5, float("inf"), None]), ("bigint", [7, 8, None, None, None, None]),
])
def test_polygon_ids_of_any_kind(spark, kind, ids):
    rows = [(i, "4" + str(k), bytearray(wkb()), k) for k, i in enumerate(ids)]
    raw = spark.createDataFrame(rows, f"HYBAS_ID {kind}, PFAF_ID string, geometry binary, seq bigint")
    assert sorted(r.hybas_id for r in polygons.ingest_polygons(raw, 8).collect()) == [7, 8]
    drops = polygons.polygon_drops(raw).first()
    assert (drops.polygons, drops.without_id, drops.without_code, drops.without_shape) == (6, 4, 0, 0)


def test_codes_held_as_floating_numbers(spark):
    raw = spark.createDataFrame([(1, 12345678.0, bytearray(wkb()), 0), (2, None, bytearray(wkb()), 1), (3, 4.0, None, 2)],
                                "HYBAS_ID bigint, PFAF_ID double, geometry binary, seq bigint")
    assert [r.pfaf for r in polygons.ingest_polygons(raw, 8).collect()] == ["12345678"]
    drops = polygons.polygon_drops(raw).first()
    assert (drops.without_id, drops.without_code, drops.without_shape) == (0, 1, 1)


def test_lookup_with_bad_ids(spark, tmp_path):
    spark.createDataFrame([("1", "11"), ("n/a", "12"), (None, "13")], "HYBAS_ID string, PFAF_ID string").write.parquet(str(tmp_path / "HUC12.parquet"))
    assert [(r.hybas_id, r.pfaf) for r in polygons.read_code_lookup(spark, str(tmp_path)).collect()] == [(1, "11")]


def test_row_orders_have_one_type(spark, tmp_path):
    header = ",".join(text_files.GAUGE_COLUMNS)
    (tmp_path / "gauges.csv").write_text(f"{header},n\nSEVERE,1,2,g,c,,,,5\n")
    present = text_files.read_gauges(spark, str(tmp_path / "gauges.csv"))
    numbered = text_files.read_gauges(spark, str(tmp_path / "gauges.csv"), seq_column="n")
    absent = text_files.read_gauges(spark, str(tmp_path / "none.csv"))
    assert {dict(df.dtypes)["seq"] for df in (present, numbered, absent)} == {"decimal(38,0)"}
    assert numbered.first().seq == 5


def test_exposure_files_with_line_breaks(spark, tmp_path):
    (tmp_path / "population_statistics.csv").write_text('HYBAS_ID,note,pop_value\n1,"two\nlines",5\n')
    files = text_files.read_impact_files(spark, str(tmp_path), multi_line=True)
    assert [(r.hybas_id, int(r.population)) for r in text_files.parse_impact(files).collect()] == [(1, 5)]


def test_document_resolutions_of_any_form(spark, tmp_path):
    path = tmp_path / "data.geojson"
    path.write_text('{"kind":"own","resolutions":["1e99","x",3,"4",null],"features":[]}')
    assert collections.read_documents(spark, str(path))[0].first().resolutions == [3, 4]


def test_packed_codes(spark):
    codes = ["0", "012", "123456789012", "9" * 17, "9" * 18, "", "x", "1 ", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string").withColumn("packed", impact.packed_code(F.col("code")))
    found = df.select(
        "i", impact.unpacked_code(F.col("packed")).alias("whole"), impact.unpacked_code(impact.packed_prefix(F.col("packed"), F.lit(2))).alias("two")
    ).orderBy("i").collect()
    assert [r.whole for r in found] == [*codes[:4], *[None] * 5]
    assert [r.two for r in found[:4]] == ["0", "01", "12", "99"]


def test_last_code_of_an_id_wins_even_if_it_is_none(spark):
    rows = spark.createDataFrame([(1, Decimal(5)), (2, Decimal(7))], "hybas_id long, population decimal(38,6)")
    rows = rows.select("*", *[F.lit(None).cast("decimal(38,6)").alias(f) for f in ("buildings", "farmland_m2", "highway_km", "railway_km")])
    lookup = spark.createDataFrame([(1, "0123", 0), (1, "0456", 1), (2, "78", 0), (2, "n/a", 1)], "hybas_id long, pfaf string, seq long")
    totals = impact.region_impact(impact.coded_impact(rows, lookup), (2, 4)).collect()
    assert sorted((r.res, r.code, r.population) for r in totals) == [(2, "04", 5.0), (4, "0456", 5.0)]


def test_exposure_by_region_aggregates_by_hash(spark, sf_dir):
    plan = REGISTRY["impact_by_region"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_builds_leave_no_stage_behind(spark, tmp_path, monkeypatch):
    places = []
    monkeypatch.setattr(builds, "stage_folder", lambda spark, folder: places.append(str(tmp_path / f"stage{len(places)}")) or places[-1])
    points = spark.createDataFrame([(1.0, 2.0, "danger")], "lat double, lon double, severity string")
    builds.build_cells(spark, points, str(tmp_path / "cells"), "tile", (3,))
    assert places and not any(os.path.exists(p) for p in places)
    assert collections.read_table(spark, str(tmp_path / "cells"), "features").count() == 1


def test_lines_that_do_not_stand_for_themselves_are_told(spark, tmp_path):
    path = tmp_path / "matches.csv"
    path.write_bytes(b'Basin_ID,Best_Match,note\r\n1,2,"a ""b"", c"\r\n2,3,"two\r\nlines"\r\n\r\n4,5\r\n6,7,x,y\r\n"8",9,\r\n')
    found = text_files.malformed_lines(spark, str(path), "crosswalk").collect()
    assert sorted((r.reason, r.line) for r in found) == [("cells", "4,5"), ("cells", "6,7,x,y"), ("quotes", '2,3,"two'), ("quotes", 'lines"')]
    assert {r.source for r in found} == {"crosswalk"} and all(r.file.endswith("matches.csv") for r in found)


def test_feature_collections_are_documents(spark, tmp_path):
    rows = [(float(k % 60), float(k), "danger", 'a "quoted" name') for k in range(150)]
    points = spark.createDataFrame(rows, "lat double, lon double, severity string, name string").repartition(5)
    folder = str(tmp_path / "cells")
    builds.build_cells(spark, points, folder, "tile", (3, 5), whole_documents=True)
    place = collections.published(spark, folder)
    for res in (3, 5):
        files = [f"{place}/documents/res={res}/{x}" for x in os.listdir(f"{place}/documents/res={res}") if x.endswith(".txt")]
        read = [json.load(open(x)) for x in files]
        assert read and all(x["type"] == "FeatureCollection" and x["resolutions"] == [res] for x in read)
        lines = [json.loads(r.value) for r in spark.read.text(f"{place}/lines/res={res}").collect()]
        key = json.dumps
        assert sorted(key(f) for x in read for f in x["features"]) == sorted(map(key, lines))
        back = collections.read_documents(spark, f"{place}/documents/res={res}")[1]
        assert back.count() == len(lines)
