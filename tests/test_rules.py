"""Literal rows for every parse, order, label and display rule."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from floodspark.functions import display, parsing, severity
from floodspark.functions.cells import SCHEMES
from floodspark.functions.planar import PARTS_TYPE, extent_of, split_at_antimeridian
from floodspark.operators import documents, forecasts, grid, impact, placement, regions, serve
from floodspark.plans import basins
from floodspark.sources import polygons as polygon_source, text_files


def evaluate(spark, values, kind, *functions):
    """Rows of function results over literal values."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = df.select("i", *[f(F.col("v")).alias(f"r{n}") for n, f in enumerate(functions)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(functions) > 1 else r[1] for r in rows]


def test_strict_integers(spark):
    texts = ["7", " 7 ", "+7", "-7", "1_000", "7.0", "", "x", None, "12345678901234567890"]
    assert evaluate(spark, texts, "string", parsing.strict_int) == [7, 7, 7, -7, 1000, None, None, None, None, None]


def test_truncating_parse(spark):
    texts = ["12.0", "12.9", "-12.9", "1e3", ".5", "5.", "", "nan", "inf", "12d", "1f", "1_0.5"]
    expected = [12, 12, -12, 1000, 0, 5, None, None, None, None, None, 10]
    assert evaluate(spark, texts, "string", parsing.truncated_int) == expected


def test_float_parse_keeps_nan_and_infinity(spark):
    found = evaluate(spark, ["nan", "-inf", "Infinity", " 1.5 ", "1.5x"], "string", parsing.float_text)
    assert math.isnan(found[0]) and found[1:] == [-math.inf, math.inf, 1.5, None]


def test_plain_numbers_are_read_without_the_pattern(spark):
    """The short way gives what the pattern gives, and the pattern stands behind it."""
    texts = [
        "12", "-0", "+5", "007", "\x0112", "12\x00", "\u00a012", "1_0", "1__0", "9223372036854775807", "9223372036854775808", "1.0", "-0.0", "0.125",
        "1.0E10", "1.0E-5", "1e3", "1.7976931348623157E308", "1.0E309", "NaN", "nan", "Infinity", "-Infinity", "+Infinity", "1d", "1.0D", "0x1", "１２", " ", "", None,
    ]
    for parse, pattern, kind in (
        (parsing.strict_int, parsing.INT_PATTERN, "bigint"), (parsing.float_text, parsing.FLOAT_PATTERN, "double"),
    ):
        def by_pattern(text, pattern=pattern, kind=kind):
            return F.replace(F.regexp_extract(text, pattern, 1), F.lit("_"), F.lit("")).try_cast(kind)

        rows = evaluate(spark, texts, "string", lambda t: parse(t).cast("string"), lambda t: by_pattern(t).cast("string"))
        assert [a for a, _ in rows] == [b for _, b in rows]
        plan = spark.range(1).select(parse(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
        assert "ELSE" in plan and "regexp_extract" not in plan.split("ELSE")[0]


@pytest.mark.parametrize("text, label", [
    ("1.99", None), ("2", "warning"), ("4.99", "warning"), ("5", "danger"), ("19.99", "danger"), ("20", "extreme"),
    ("x", None), ("inf", None),
])
def test_return_period(spark, text, label):
    assert evaluate(spark, [text], "string", lambda v: severity.return_period_severity(parsing.truncated_int(v))) == [label]


def test_gauge_labels(spark):
    found = evaluate(spark, [" severe ", "Extreme", "ABOVE_NORMAL", "NO_FLOODING", "", None], "string", severity.gauge_severity)
    assert found == ["danger", "extreme", "warning", None, None, None]


def test_ranks_and_labels(spark):
    found = evaluate(
        spark, ["none", "Warning", "EXTREME", "other", None], "string", severity.severity_rank,
        lambda v: severity.severity_of_rank(severity.severity_rank(v)),
        lambda v: severity.shown_severity_of_rank(severity.severity_rank(v)),
    )
    assert found == [(0, "none", ""), (1, "warning", "warning"), (3, "extreme", "extreme"), (-1, "", ""), (-1, "", "")]


def test_rounding_follows_the_binary_value(spark):
    found = evaluate(spark, [0.25, 0.15, 0.35, 0.75, 0.05, 2.5, 1e16], "double", display.round_half_even_tenth)
    assert found == [round(v, 1) for v in [0.25, 0.15, 0.35, 0.75, 0.05, 2.5, 1e16]]
    assert evaluate(spark, [0.5, 1.5, 2.5], "double", display.round_half_even) == [0.0, 2.0, 2.0]


def test_compact_counts(spark):
    values = [999.0, 1000.0, 1500.0, 8181280.0, 1.15e3, 1.25e3, 2e9, 999.6, 0.5, math.nan, None, -1234.0]
    expected = ["999", "1k", "1.5k", "8.2M", "1.1k", "1.3k", "2B", "1,000", "1", "—", "—", "-1,234"]
    assert evaluate(spark, values, "double", display.compact_count) == expected


def test_deep_links(spark):
    rows = [
        ("river", 1.0, -2.25, "9"), ("gauge", 0.5, 1e-7, "a b/c"), ("gauge", 0.5, 1.0, ""),
        ("gauge", None, 1.0, "x"), ("other", 1.0, 1.0, "x"), ("RIVER", math.nan, 1.0, "x"),
    ]
    df = spark.createDataFrame(rows, "model string, lat double, lon double, id string")
    links = [r[0] for r in df.select(display.deep_link(*[F.col(c) for c in ("model", "lat", "lon", "id")])).collect()]
    assert links == [
        "https://rivers.example/#lon=-2.25&lat=1&zoom=13",
        "https://gauges.example/l/0.5/1e-7/10/g/a%20b%2Fc",
        "https://gauges.example/l/0.5/1/10", None, None, None,
    ]


def test_url_component_leaves_marks_alone(spark):
    assert evaluate(spark, ["a-b_c.d!e~f*g'h(i)j é+"], "string", display.url_component) == ["a-b_c.d!e~f*g'h(i)j%20%C3%A9%2B"]


def test_model_labels(spark):
    found = evaluate(spark, ["gauge", "river", "my_big-model", "éa b", "x"], "string", display.model_label)
    assert found == ["Gauge model", "River model", "My Big-Model", "éA B", "X"]


def test_zoom_to_resolution(spark):
    zooms = spark.createDataFrame([(z,) for z in (0.0, 2.0, 3.9, 4.0, 8.0, 19.0)], "zoom double")
    assert [r.res for r in serve.at_zoom(zooms, [6, 3, 5, 4]).orderBy("zoom").collect()] == [3, 3, 3, 4, 6, 6]


# --- files -------------------------------------------------------------------------------------------


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_crosswalk_file_with_byte_order_mark_and_blanks_in_header(spark, tmp_path):
    path = write(tmp_path / "c.csv", "﻿Basin_ID, Best_Match\n1,12.9\n1,13.0\n2,\n,5\n3,12d\nx,5\n4,nan\n1,bad\n")
    parsed = text_files.parse_crosswalk(text_files.read_crosswalk(spark, path))
    assert parsed.where("is_hole").count() == 5
    assert [tuple(r) for r in forecasts.clean_crosswalk(parsed).collect()] == [(1, 13)]


def test_reach_file_rules(spark, tmp_path):
    path = write(tmp_path / "r.csv", "comid , ret_per,mean\n1,20,5\n1,5,x\n1,1,9\n2,inf,1\nx,20,1\n3,2\n")
    found = forecasts.flagged_reaches(text_files.parse_reaches(text_files.read_reaches(spark, path)))
    rows = {r.comid: (r.ret_per, r["mean"], r.severity, r.lat) for r in found.collect()}
    assert rows == {1: (5, 0.0, "danger", None), 3: (2, 0.0, "warning", None)}
    floor = text_files.parse_reaches(text_files.read_reaches(spark, path), min_mean_flow=1.0)
    assert [r.ret_per for r in floor.collect()] == [20]


def test_missing_column_and_empty_file_are_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="mean"):
        text_files.read_reaches(spark, write(tmp_path / "a.csv", "comid,ret_per\n1,2\n"))
    with pytest.raises(ValueError):
        text_files.read_reaches(spark, write(tmp_path / "b.csv", ""))


def test_explicit_row_number_orders_rows(spark, tmp_path):
    path = write(tmp_path / "s.csv", "Basin_ID,Best_Match,row\n1,5,2\n1,6,1\n")
    parsed = text_files.parse_crosswalk(text_files.read_crosswalk(spark, path, seq_column="row"))
    assert forecasts.clean_crosswalk(parsed).collect()[0].comid == 5


def test_gauge_file(spark, tmp_path):
    head = ",".join(text_files.GAUGE_COLUMNS)
    path = write(tmp_path / "g.csv", f"{head}\n severe ,1,2, g1 ,,t,,\nEXTREME,nan,2,g2,,,,\nEXTREME,,2,g3,,,,\nCALM,1,2,g4,,,,\n")
    found = text_files.parse_gauges(text_files.read_gauges(spark, path)).orderBy("gauge_id").collect()
    assert [(r.gauge_id, r.severity, r.country, r.issued) for r in found] == [("g1", "danger", "", "t"), ("g2", "extreme", "", "")]
    assert text_files.read_gauges(spark, str(tmp_path / "none.csv")).count() == 0


def test_impact_files(spark, tmp_path):
    write(tmp_path / "population_statistics.csv", "HYBAS_ID,pop_value\n1,2.5\n1,\ntotal,99\n2,x\n,4\n7.0,4\n9,5\n3,nan\n")
    write(tmp_path / "transportation_statistics.csv", "HYBAS_ID,highway_km,railway_km\n1,0.25,1\n")
    files = text_files.read_impact_files(spark, str(tmp_path))
    assert set(files) == {"population_statistics.csv", "transportation_statistics.csv"}
    rows = text_files.parse_impact(files)
    # The later code of id 1 counts; id 9 has no code.
    lookup = spark.createDataFrame(
        [(1, "22222222", 0), (1, "11111111", 1), (2, "11121111", 2), (3, "33333333", 3)], "hybas_id long, pfaf string, seq long"
    )
    flagged = spark.createDataFrame([(4, "1111"), (4, "1112"), (4, "4444")], "res int, code string")
    coded = impact.coded_impact(rows, lookup)
    totals = {r.code: r for r in impact.rounded(impact.region_impact(coded, (4,), flagged)).collect()}
    assert set(totals) == {"1111", "1112"}
    first = totals["1111"]
    assert (first.population, first.buildings, first.highway_km, first.railway_km) == (2, 0, 0.2, 1.0)
    assert totals["1112"].population == 0
    # Rows, not ids: two of id 1 in one file, one in the other, one of id 2.
    assert impact.matched_rows(coded, flagged, (4,)).collect()[0][0] == 4
    features = flagged.withColumn("severity", F.lit("danger"))
    kept = {r.code: r.impact for r in impact.with_impact(features, impact.region_impact(coded, (4,), flagged)).collect()}
    assert kept["4444"] is None and kept["1111"].population == 2


# --- polygons ----------------------------------------------------------------------------------------


def ring(*points):
    return [list(map(float, p)) for p in points]


SQUARE = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
HOLE = ring((0.5, 0.5), (0.5, 1), (1, 1), (1, 0.5), (0.5, 0.5))
FAR = ring((10, 10), (11, 10), (11, 11), (10, 11), (10, 10))
NEIGHBOUR = ring((2, 0), (4, 0), (4, 2), (2, 2), (2, 0))


def shapes(spark, rows):
    from floodspark.functions.planar import PARTS_TYPE, extent_of

    df = spark.createDataFrame(rows, f"hybas_id long, pfaf string, seq long, parts {PARTS_TYPE}")
    return df.withColumn("level", F.lit(8)).withColumn("multi", F.size("parts") > 1).withColumns(extent_of(F.col("parts")))


@pytest.mark.parametrize("sizes", [placement.TILE_SIZES, (360.0,), (0.3, 360.0)])
def test_containment(spark, sizes):
    polygons = shapes(spark, [(1, "1", 0, [[SQUARE, HOLE], [FAR]]), (2, "2", 1, [[NEIGHBOUR]]), (3, "3", 2, [[NEIGHBOUR]])])
    points = {
        "in": (1.5, 1.5), "hole": (0.75, 0.75), "hole edge": (0.5, 0.75), "edge": (1, 0), "vertex": (0, 0),
        "shared": (2, 1), "second part": (10.5, 10.5), "both": (3, 1), "outside": (7, 7), "level with vertex": (1.5, 1),
        "nan": (math.nan, 1), "left of all": (-1, 1),
    }
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in points.items()], "seq string, lon double, lat double")
    found = {r.seq: r.hybas_id for r in placement.place_points(df, polygons, sizes=sizes).collect()}
    assert found == {"in": 1, "second part": 1, "both": 2, "level with vertex": 1}


def wkb(parts, order="<", z=False):
    def polygon(rings):
        out = struct.pack(order + "BII", order == "<", 1003 if z else 3, len(rings))
        for r in rings:
            out += struct.pack(order + "I", len(r))
            for p in r:
                out += struct.pack(order + ("ddd" if z else "dd"), *p, *([7.0] if z else []))
        return out
    if len(parts) == 1:
        return polygon(parts[0])
    return struct.pack(order + "BII", order == "<", 6, len(parts)) + b"".join(polygon(p) for p in parts)


def test_wkb_ingest(spark):
    rows = [
        (1, "11", wkb([[SQUARE, HOLE]]), 0), (2, "12", wkb([[SQUARE], [FAR]], ">"), 1), (3, "13", wkb([[FAR]], z=True), 2),
        (1, "99", wkb([[FAR]]), 3), (4, None, wkb([[FAR]]), 4), (5, "15", None, 5),
    ]
    raw = spark.createDataFrame(rows, "HYBAS_ID long, PFAF_ID string, geometry binary, seq long")
    found = {r.hybas_id: r for r in polygon_source.ingest_polygons(raw, 8).collect()}
    assert {k: (r.pfaf, r.multi) for k, r in found.items()} == {1: ("11", False), 2: ("12", True), 3: ("13", False)}
    assert found[1].parts == [[SQUARE, HOLE]] and found[2].parts == [[SQUARE], [FAR]] and found[3].parts == [[FAR]]
    assert (found[2].xmin, found[2].xmax) == (0.0, 11.0)


def test_other_geometry_types_are_refused(spark):
    point = struct.pack("<BIdd", 1, 1, 0.0, 0.0)
    raw = spark.createDataFrame([(1, "1", point, 0)], "HYBAS_ID long, PFAF_ID string, geometry binary, seq long")
    with pytest.raises(Exception, match="not a polygon"):
        polygon_source.ingest_polygons(raw, 8).collect()


def alerts(spark, rows):
    return spark.createDataFrame(rows, "hybas_id long, model string, severity string")


def test_roll_up_levels_and_shared_codes(spark):
    polygons = shapes(spark, [(1, "11111111", 0, [[SQUARE]]), (2, "11112222", 1, [[SQUARE]]), (3, "11112222", 2, [[SQUARE]])])
    rows = alerts(spark, [(1, "a", "warning"), (1, "b", "EXTREME"), (2, "a", "danger"), (3, "a", "none"), (9, "a", "extreme")])
    tallies = basins.tallies(rows, polygons, (4, 8))
    coarse = polygons.where("hybas_id < 3").select(F.lit(4).alias("level"), (F.col("hybas_id") + 40).alias("hybas_id"),
                                                   F.lit("1111").alias("pfaf"), "seq")
    found = {(r.res, r.code): r for r in regions.level_features(tallies, regions.first_per_code(coarse)).collect()}
    assert set(found) == {(4, "1111"), (8, "11111111"), (8, "11112222")}
    whole = found[4, "1111"]
    assert (whole.basin_id, whole.severity, whole.model_count, whole.models, whole.agree) == (41, "extreme", 4, ["a", "b"], True)
    shared = found[8, "11112222"]
    assert (shared.basin_id, shared.model_count, shared.severity, shared.agree) == (3, 2, "danger", False)


def test_worst_severity_of_unknown_labels(spark):
    rows = alerts(spark, [(1, "a", "other"), (2, "a", "none"), (3, "", "danger")])
    tallies = regions.tally(rows, ["hybas_id"])
    built = {r.hybas_id: r.severity for r in regions.summarise(tallies, ["hybas_id"]).collect()}
    shown = {r.hybas_id: r.severity for r in serve.visible_by_model(tallies, ["a", ""], ["hybas_id"]).collect()}
    assert built == {1: "", 2: "none", 3: "danger"} and shown == {1: "", 2: ""}


def test_model_filter_drops_emptied_regions(spark):
    tallies = regions.tally(alerts(spark, [(1, "a", "warning"), (1, "b", "danger"), (2, "b", "danger")]), ["hybas_id"])
    shown = serve.visible_by_model(tallies, ["a"], ["hybas_id"]).collect()
    assert [(r.hybas_id, r.severity, r.agree) for r in shown] == [(1, "warning", False)]
    everything = serve.visible_by_model(tallies, ["a", "b"], ["hybas_id"]).collect()
    assert sorted((r.hybas_id, r.model_count, r.agree) for r in everything) == [(1, 2, True), (2, 1, False)]


def test_resolutions_default_and_declared(spark):
    features = spark.createDataFrame([(None, "a"), (3, "b"), (3, "c"), (9, "d")], "res int, cell_id string")
    assert [tuple(r) for r in serve.features_by_resolution(features).collect()] == [(0, 1), (3, 2), (9, 1)]
    assert [tuple(r) for r in serve.features_by_resolution(features, ["5", 3]).collect()] == [(3, 2), (5, 0)]
    assert serve.is_empty(features, [5]).collect()[0].empty and not serve.is_empty(features, [3]).collect()[0].empty


# --- cells -------------------------------------------------------------------------------------------


def tokens(spark, points, level):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    cells = SCHEMES["s2"].addressed(df, level).withColumn("res", F.lit(level))
    return [r[0] for r in cells.orderBy("i").select(SCHEMES["s2"].key(F.col("cell"), F.col("res"), level)).collect()]


def test_s2_tokens_of_known_places(spark):
    # New York, Paris; face centres at level 0; the origin on the finest level used here.
    assert tokens(spark, [(40.7484, -73.9857), (48.8566, 2.3522)], 8) == ["89c25", "47e67"]
    centres = [(0.0, 0.0), (0.0, 90.0), (90.0, 0.0), (0.0, 180.0), (0.0, -90.0), (-90.0, 0.0)]
    assert tokens(spark, centres, 0) == ["1", "3", "5", "7", "9", "b"]


def test_points_off_the_globe_have_no_cell(spark):
    df = spark.createDataFrame([("m", "danger", 91.0, 0.0), ("m", "danger", 0.0, 181.0), ("m", "danger", 1.0, 1.0)],
                               "model string, severity string, lat double, lon double")
    for scheme, resolutions in (("s2", (2, 4)), ("hex", (3, 4)), ("tile", (2, 3))):
        assert grid.cell_tallies(df, scheme, resolutions).agg(F.sum("n")).collect()[0][0] == 2


def test_split_at_antimeridian(spark):
    ring_text = [ring((179, 0), (-179, 0), (-179, 1), (179, 1), (179, 0)), SQUARE]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ring_text)], "i int, r array<array<double>>")
    split, whole = [r[0] for r in df.orderBy("i").select(split_at_antimeridian(F.col("r"))).collect()]
    spans = sorted((min(p[0] for p in part[0]), max(p[0] for p in part[0])) for part in split)
    assert spans == [(-180.0, -179.0), (179.0, 180.0)] and whole == [[SQUARE]]


def test_ready_cell_ids_without_outline_drop(spark):
    points = spark.createDataFrame([("m", "danger", "x"), ("n", "warning", "x"), ("m", "danger", "y"), ("m", "danger", None)],
                                   "model string, severity string, h string")
    outlines = spark.createDataFrame([("x", [[SQUARE]])], "cell_id string, parts array<array<array<array<double>>>>")
    found = grid.ready_cell_features(points, {5: "h"}, outlines).collect()
    assert [(r.cell_id, r.res, r.model_count, r.severity, r.agree) for r in found] == [("x", 5, 2, "danger", True)]


# --- inputs that must not end a job --------------------------------------------------------------------


def test_far_coordinates_are_outside(spark):
    square = [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]
    shapes = spark.createDataFrame([(1, "1", 0, square)], f"hybas_id long, pfaf string, seq long, parts {PARTS_TYPE}").withColumns(extent_of(F.col("parts")))
    points = [(0, 0.5, 0.5), *[(i + 1, x, 0.5) for i, x in enumerate((1e9, -1e9, 1e20, 1e300, -1e300))], (9, 0.5, 1e300)]
    placed = placement.place_points(spark.createDataFrame(points, "seq long, lon double, lat double"), shapes).collect()
    assert [(r.seq, r.hybas_id) for r in placed] == [(0, 1)]


def test_large_numbers_as_text(spark):
    numbers = [1e13, 1e14, 1e20, 1e21, 1.5e22, -1e14, 123456789012345.5, math.nan, math.inf, 0.0, 1e-7, 0.25]
    texts = ["10000000000000", "100000000000000", "100000000000000000000", "1e+21", "1.5e+22", "-100000000000000",
             "123456789012345.5", "NaN", "Infinity", "0", "1e-7", "0.25"]
    assert evaluate(spark, numbers, "double", display.plain_number) == texts


def test_own_models_links_and_tiers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, "x"), ("b", 1.0, 2.0, "x y")], "model string, lat double, lon double, id string")
    links = df.select(display.deep_link(*[F.col(c) for c in df.columns], river=("a", "r://{lon},{lat}"), gauge=("b", "g://{lat}", "#{id}")).alias("l"))
    assert [r.l for r in links.collect()] == ["r://2,1", "g://1#x%20y"]
    assert df.select(display.model_label(F.col("model"), {"a": "Own"}).alias("t")).collect()[0].t == "Own"
    raw = spark.createDataFrame([("1", "1.5", "2", "0", "0", 1)], "comid string, ret_per string, mean string, lat string, lon string, seq long")
    tiers = ((1, "warning"),)
    last = forecasts.flagged_reaches(text_files.parse_reaches(raw, tiers), tiers)
    assert [r.severity for r in last.collect()] == ["warning"]


def test_headers_and_line_breaks(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    write(folder / "a.csv", "Basin_ID,Best_Match\n1,2\n")
    write(folder / "b.csv", "Best_Match,Basin_ID\n7,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        text_files.read_crosswalk(spark, str(folder)).collect()
    path = write(tmp_path / "q.csv", 'severity,gaugeId,queriedCountryName,issuedTime\nSEVERE,g,"Land\nname",now\n')
    row = text_files.read_gauges(spark, path, multi_line=True).collect()
    assert [(r.queriedCountryName, r.issuedTime) for r in row] == [("Land\nname", "now")]


def test_one_order_for_one_and_many_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        write(folder / f"f {i}.csv", "Basin_ID,Best_Match\n" + "".join(f"{i},{j}\n" for j in range(3)))
    many, one = text_files.read_crosswalk(spark, str(folder)), text_files.read_crosswalk(spark, str(folder / "f 0.csv"))
    assert many.schema == one.schema
    assert [(r.Basin_ID, r.Best_Match) for r in many.orderBy("seq").collect()] == [(str(i), str(j)) for i in range(3) for j in range(3)]
    plan = forecasts.clean_crosswalk(text_files.parse_crosswalk(many))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_resolution_in_any_form(spark):
    forms = {'"4"': 4, "4": 4, "4.0": 4, "null": 0}
    lines = [f'{{"type":"Feature","geometry":null,"properties":{{"res":{x},"cell_id":"c","forecasts":[]}}}}' for x in forms]
    lines.append('{"type":"Feature","geometry":null,"properties":{"cell_id":"c","forecasts":[]}}')
    parsed = documents.parse_lines(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [r.res for r in parsed.collect()] == [*forms.values(), 0]
