"""Input tables derived from the test tables; every formula covers the whole source table.

Integers and exact binary fractions only, so that another engine derives the very same rows.
Basins sit in a 3^8 x 3^8 square of units of 1/64 degree, and the eight base-9 digits of a basin's
code walk down a 3 x 3 subdivision, so every code prefix is an enclosing square.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from floodspark.functions.planar import extent_of
from floodspark.operators import forecasts
from floodspark.operators.joins import by_merge
from floodspark.plans.basins import BasinInputs
from floodspark.sources import text_files

LEVELS = (4, 5, 6, 7, 8)
N_CODES = 9**8


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def settled(rows: DataFrame, **columns: str) -> DataFrame:
    """Rows with these columns added, computed once.

    Filters are not pushed below a generator, so predicates on the new columns do not evaluate their
    formulas a second time; it makes derived text behave as if it had been read from a file.
    """
    fields = ", ".join(f"'{name}', {formula}" for name, formula in columns.items())
    kept = [c for c in rows.columns if c not in columns]
    return rows.selectExpr(*kept, f"inline(array(named_struct({fields})))")


def located(rows: DataFrame, key: str) -> DataFrame:
    """Adds n, pfaf, x, y of the basin whose number is ``key``."""
    # Written out digit by digit, so that it is compiled; lambdas are interpreted row by row.
    places = range(7, -1, -1)
    digit = {i: f"(n div {9 ** i}L % 9)" for i in places}
    return settled(
        rows.withColumn("n", F.expr(f"({key} * 101) % {N_CODES}")),
        pfaf=f"concat_ws('', {', '.join(f'cast({digit[i]} + 1 AS string)' for i in places)})",
        x=" + ".join(f"{digit[i]} % 3 * {3 ** i}L" for i in places),
        y=" + ".join(f"{digit[i]} div 3 * {3 ** i}L" for i in places),
    )


def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, n, hybas_id, pfaf, x, y)."""
    keys = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "8000000000 + c_custkey AS hybas_id")
    # A small file is one task, but each of its keys becomes a polygon.
    return located(keys.repartition("k"), "k")


def _unit_ring(offsets, side: str = "1D") -> str:
    """Ring around (x, y); offsets are in parts of the side, coordinates in degrees."""
    corners = ", ".join(
        f"array((x + {dx}D * {side}) / 64D - 50D, (y + {dy}D * {side}) / 64D - 50D)" for dx, dy in offsets
    )
    return f"array({corners})"


_SHELL = [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)]
_HOLE = [(0.125, 0.125), (0.125, 0.25), (0.25, 0.25), (0.25, 0.125), (0.125, 0.125)]
_SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


def base_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-8 basins: an L, with a square hole in every fifth."""
    return basins(spark, sf_dir).selectExpr(
        "8 AS level", "hybas_id", "pfaf", "k AS seq", "false AS multi",
        f"CASE WHEN k % 5 = 0 THEN array(array({_unit_ring(_SHELL)}, {_unit_ring(_HOLE)})) "
        f"ELSE array(array({_unit_ring(_SHELL)})) END AS parts",
    )


def coarse_shapes(spark: SparkSession, sf_dir: str, levels=LEVELS) -> DataFrame:
    """Levels above the base: the enclosing square of every prefix that occurs."""
    above = [level for level in levels if level != 8]
    base = basins(spark, sf_dir).withColumn("level", F.explode(F.array(*[F.lit(v) for v in above])))
    squares = base.selectExpr(
        "level", "level * 1000000000L + n div cast(power(9, 8 - level) AS bigint) AS hybas_id",
        "substring(pfaf, 1, level) AS pfaf", "cast(power(3, 8 - level) AS bigint) AS side", "x", "y",
    ).selectExpr("level", "hybas_id", "pfaf", "side", "x - x % side AS x", "y - y % side AS y").distinct()
    return squares.selectExpr(
        "level", "hybas_id", "pfaf", "hybas_id AS seq", "false AS multi",
        f"array(array({_unit_ring(_SQUARE, 'side')})) AS parts",
    )


def polygons(spark: SparkSession, sf_dir: str, levels=LEVELS) -> DataFrame:
    """The ingested polygon table of all levels."""
    shapes = base_shapes(spark, sf_dir)
    if any(level != 8 for level in levels):
        shapes = shapes.unionByName(coarse_shapes(spark, sf_dir, levels))
    return shapes.select("*", *[c.alias(n) for n, c in extent_of(F.col("parts")).items()])


def _encode_wkb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encoded = []
        for part in batch.column("parts").to_pylist():
            rings = part[0]
            body = [struct.pack("<BII", 1, 3, len(rings))]
            for ring in rings:
                body.append(struct.pack("<I", len(ring)))
                body += [struct.pack("<dd", *point) for point in ring]
            encoded.append(b"".join(body))
        yield pa.RecordBatch.from_arrays(
            [batch.column("HYBAS_ID"), batch.column("PFAF_ID"), pa.array(encoded, pa.binary()), batch.column("seq")],
            names=["HYBAS_ID", "PFAF_ID", "geometry", "seq"],
        )


def raw_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-8 basins as an input file has them: id, code and WKB."""
    shapes = base_shapes(spark, sf_dir).selectExpr("hybas_id AS HYBAS_ID", "pfaf AS PFAF_ID", "parts", "seq")
    return shapes.mapInArrow(_encode_wkb, "HYBAS_ID bigint, PFAF_ID string, geometry binary, seq bigint")


def raw_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows. Some matches are missing or bad, some basins have a second, later row."""
    source = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k")
    rows = source.selectExpr(
        "k",
        """explode(CASE WHEN k % 19 = 0 THEN array(
             named_struct('seq', k, 'match', CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'n/a'
                                             ELSE concat(k * 7 + 1, '.0') END),
             named_struct('seq', 1000000 + k, 'match', concat((k + 1) * 7 + 1, '.0')))
           ELSE array(
             named_struct('seq', k, 'match', CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 'n/a'
                                             ELSE concat(k * 7 + 1, '.0') END)) END) AS r""",
    )
    return rows.selectExpr("cast(8000000000 + k AS string) AS Basin_ID", "r.match AS Best_Match", "r.seq AS seq")


def raw_reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows, many per reach."""
    source = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_totalprice")
    placed = located(source, "o_custkey")
    return settled(
        placed,
        comid="cast(o_custkey * 7 + 1 AS string)",
        ret_per="concat(o_orderkey * 31 % 26, '.9')",
        mean="CASE WHEN o_orderkey % 23 = 0 THEN 'bad' ELSE cast(o_totalprice AS string) END",
        lat="CASE WHEN o_orderkey % 29 <> 0 THEN cast(y / 64D - 50D AS string) END",
        lon="CASE WHEN o_orderkey % 29 <> 0 THEN cast(x / 64D - 50D AS string) END",
        seq="o_orderkey",
    ).select("comid", "ret_per", "mean", "lat", "lon", "seq")


def raw_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows; the points lie inside, on the edge, in the notch or in the hole of a basin."""
    n_basins = table(spark, sf_dir, "customer").select(F.count("*")).scalar()
    source = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    aimed = located(source.withColumn("k", F.col("event_id") * 7 % n_basins), "k")
    cells = {
        "severity": """CASE event_type WHEN 'click' THEN 'ABOVE_NORMAL' WHEN 'signup' THEN ' severe '
             WHEN 'purchase' THEN 'EXTREME' WHEN 'view' THEN 'NO_FLOODING' ELSE 'UNKNOWN' END""",
        "gaugeLocation.latitude": "cast((y + event_id * 5 % 16 / 16D + 0.03125D) / 64D - 50D AS string)",
        "gaugeLocation.longitude": """cast((x + CASE WHEN event_id % 50 = 0 THEN 0D
             ELSE event_id * 13 % 16 / 16D + 0.03125D END) / 64D - 50D AS string)""",
        "gaugeId": "cast(event_id AS string)",
        "queriedCountryName": "cast(NULL AS string)",
        "issuedTime": "cast(ts AS string)",
        "forecastTimeRange.start": "''",
        "forecastTimeRange.end": "cast(NULL AS string)",
        "seq": "event_id",
    }
    return settled(aimed, **cells).select(*[f"`{name}`" for name in cells])


def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-12 basins below the level-8 ones."""
    source = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey")
    known = table(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey")
    tail = ", ".join(f"o_orderkey div {9 ** (3 - i)} % 9 + 1" for i in range(4))
    return located(source.join(by_merge(known), "o_custkey", "left_semi"), "o_custkey").selectExpr(
        "12000000000 + o_orderkey AS hybas_id", f"concat(pfaf, {tail}) AS pfaf", "o_orderkey AS seq"
    )


def raw_impact(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four exposure files, one row per line item plus a total row each."""
    item = table(spark, sf_dir, "lineitem")
    total = spark.range(1)
    values = {
        "population_statistics.csv": {"pop_value": "l_quantity"},
        "building_statistics.csv": {"building_count": "l_linenumber"},
        "farmland_statistics.csv": {"area_m2": "l_quantity * 1000"},
        "transportation_statistics.csv": {"highway_km": "l_linenumber / 8D", "railway_km": "l_linenumber / 16D"},
    }
    return {
        name: item.selectExpr(
            "cast(12000000000 + l_orderkey AS string) AS HYBAS_ID",
            *[f"cast({value} AS string) AS {column}" for column, value in columns.items()],
        ).unionByName(total.selectExpr("'TOTAL' AS HYBAS_ID", *[f"'1' AS {column}" for column in columns]))
        for name, columns in values.items()
    }


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.parse_crosswalk(raw_crosswalk(spark, sf_dir))


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.parse_reaches(raw_reaches(spark, sf_dir))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.parse_gauges(raw_gauges(spark, sf_dir))


def impact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.parse_impact(raw_impact(spark, sf_dir))


def basin_inputs(spark: SparkSession, sf_dir: str, levels=LEVELS, exposure: bool = False) -> BasinInputs:
    return BasinInputs(
        crosswalk(spark, sf_dir), reaches(spark, sf_dir), gauges(spark, sf_dir), polygons(spark, sf_dir, levels),
        impact_rows(spark, sf_dir) if exposure else None,
        code_lookup(spark, sf_dir) if exposure else None,
    )


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of both models as points with text coordinates, some of them missing or not numbers."""
    points = forecasts.flood_points(
        forecasts.flagged_reaches(reaches(spark, sf_dir)), gauges(spark, sf_dir)
    )
    text = "coalesce(cast({} AS string), CASE WHEN cast(riverId AS bigint) % 2 = 0 THEN 'n/a' END)"
    return settled(points, lat=text.format("lat"), lon=text.format("lon"))


def open_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge alerts as points of another source: a place, a severity and two columns of its own, but no model."""
    return gauges(spark, sf_dir).selectExpr(
        "CASE WHEN seq % 31 = 0 THEN 'n/a' ELSE cast(lat AS string) END AS lat", "lon", "severity",
        "concat('station ', seq % 97) AS `station.name`", "named_struct('level', seq / 8D, 'unit', 'm') AS reading",
    )


def feature_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON lines whose resolution is written in every form that documents have: number, text, absent, no number."""
    forms = "element_at(array('4', '\"5\"', '6.0', '\"7.0\"', 'null', '\"x\"', '1e99', '\"1e99\"', '\" 8 \"'), cast(c_custkey % 9 + 1 AS int))"
    return table(spark, sf_dir, "customer").selectExpr(
        f"""concat('{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},"properties":{{"res":',
            {forms}, ',"cell_id":"', c_custkey, '","severity":"warning","model_count":1,"forecasts":[]}}}}') AS line"""
    )


def collection_folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, for a query that builds a collection and reads it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/collection-{uuid.uuid4().hex}"
