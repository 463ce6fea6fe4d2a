"""Point in polygon as an equi-join on tiles.

Tiles come in several sizes. A polygon is filed under the smallest size its bounding box fits, so it
covers at most 2 x 2 tiles however large it is, and a tile holds only polygons of about its own
size. A point looks up one tile per size. That bounds the candidates of a point without a size to
tune, and the boxes are compared inside the join, so candidate pairs are never written out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.parsing import is_finite
from floodspark.functions.planar import edges_of, strictly_inside
from floodspark.operators.joins import by_merge

#: Edges that a band of a polygon holds, about.
BAND_EDGES = 64

#: Tile sizes in degrees; the last one must cover any polygon.
TILE_SIZES = (1 / 64, 1 / 16, 0.25, 1.0, 4.0, 16.0, 64.0, 360.0)


def _size(level: Column, sizes) -> Column:
    return F.get(F.array(*[F.lit(float(s)) for s in sizes]), level)


def _tile(value: Column, level: Column, sizes) -> Column:
    # BIGINT: a coordinate far off the globe gets a far tile, which holds no polygon.
    return F.floor(value / _size(level, sizes))


def _tile_level(sizes) -> Column:
    """The smallest size that holds the bounding box."""
    extent = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.size(F.filter(F.array(*[F.lit(float(s)) for s in sizes[:-1]]), lambda s: s < extent))


def _band(y: Column) -> Column:
    """Number of the latitude band of a polygon that a latitude falls in; it never falls as the latitude rises."""
    height = (F.col("ymax") - F.col("ymin")) / F.col("n_bands")
    return F.greatest(F.lit(0), F.least(F.col("n_bands") - 1, F.floor((y - F.col("ymin")) / height).cast("int")))


def banded(polygons: DataFrame, band_edges: int = BAND_EDGES) -> DataFrame:
    """(hybas_id, seq, box, n_bands, band, edges): the edges of each polygon by latitude band.

    An edge is filed under every band it reaches into, so the band of a point holds all edges that the point's parallel can
    meet. Bands are about ``band_edges`` edges high, but only so many that edges are filed four times on average at most: of
    a polygon with long upright edges any parallel meets many. Small polygons have one band and are not regrouped.
    """
    known = ["hybas_id", "seq", "xmin", "ymin", "xmax", "ymax"]
    edged = polygons.where("ymax > ymin AND xmax > xmin").select(*known, edges_of(F.col("parts")).alias("edges"))
    small = edged.where(F.size("edges") <= band_edges)
    upright = F.aggregate("edges", F.lit(0.0), lambda total, e: total + F.abs(e.y2 - e.y1)) / (F.col("ymax") - F.col("ymin"))
    bands = F.least(F.ceil(F.size("edges") / band_edges), F.ceil(F.size("edges") * 3 / F.greatest(upright, F.lit(1.0))))
    # The whole array stays behind: no exploded edge carries it along.
    counted = edged.where(F.size("edges") > band_edges).withColumn("n_bands", bands.cast("int"))
    each = counted.select(*known, "n_bands", F.explode("edges").alias("edge"))
    low, high = F.least("edge.y1", "edge.y2"), F.greatest("edge.y1", "edge.y2")
    filed = each.select(*known, "n_bands", "edge", F.explode(F.sequence(_band(low), _band(high))).alias("band"))
    large = filed.groupBy(*known, "n_bands", "band").agg(F.collect_list("edge").alias("edges"))
    return small.withColumns({"n_bands": F.lit(1), "band": F.lit(0)}).unionByName(large)


def polygon_tiles(polygons: DataFrame, sizes=TILE_SIZES) -> DataFrame:
    """Bands of polygons with their edges, once per tile they touch: (tile_level, tx, ty, ...)."""
    ordered = sorted(sizes)
    height = (F.col("ymax") - F.col("ymin")) / F.col("n_bands")
    # A little higher than computed, so that rounding never keeps a point and its band in different tiles.
    slack = (F.abs("ymin") + F.abs("ymax")) * 1e-12
    sized = banded(polygons).withColumns({
        "tile_level": _tile_level(ordered),
        "_low": F.greatest(F.col("ymin"), F.col("ymin") + F.col("band") * height - slack),
        "_high": F.least(F.col("ymax"), F.col("ymin") + (F.col("band") + 1) * height + slack),
    })

    def span(low: str, high: str) -> Column:
        first, last = (_tile(F.col(c), F.col("tile_level"), ordered) for c in (low, high))
        return F.explode(F.sequence(first, last))

    return sized.withColumn("tx", span("xmin", "xmax")).withColumn("ty", span("_low", "_high")).drop("_low", "_high")


def place_points(points: DataFrame, polygons: DataFrame, key: str = "seq", sizes=TILE_SIZES) -> DataFrame:
    """(key, hybas_id) of every point strictly inside a polygon, the first polygon in file order.

    Only the key and the coordinates take part; the caller joins its payload back on the key. Points are looked up in
    the tile sizes that some polygon is filed under.
    """
    ordered = sorted(sizes)
    slim = points.select(F.col(key).alias("point_key"), "lon", "lat").where(
        is_finite(F.col("lon")) & is_finite(F.col("lat"))
    )
    in_use = polygons.select(_tile_level(ordered).alias("tile_level")).agg(F.collect_set("tile_level")).scalar()
    probes = slim.withColumn("tile_level", F.explode(in_use))
    probes = probes.withColumns({
        "tx": _tile(F.col("lon"), F.col("tile_level"), ordered),
        "ty": _tile(F.col("lat"), F.col("tile_level"), ordered),
    })
    tiles = polygon_tiles(polygons, ordered)
    lon, lat = F.col("lon"), F.col("lat")
    same_tile = reduce(lambda a, b: a & b, [probes[c] == tiles[c] for c in ("tile_level", "tx", "ty")])
    in_box = (lon > F.col("xmin")) & (lon < F.col("xmax")) & (lat > F.col("ymin")) & (lat < F.col("ymax"))
    hits = probes.join(by_merge(tiles), same_tile & in_box & (_band(lat) == F.col("band"))).where(strictly_inside(F.col("edges"), lon, lat))
    return hits.groupBy(F.col("point_key").alias(key)).agg(F.min_by("hybas_id", "seq").alias("hybas_id"))


def split_placed(points: DataFrame, placed: DataFrame, key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(points with their basin, points outside all basins)."""
    return points.join(by_merge(placed), key), points.join(by_merge(placed.select(key)), key, "left_anti")
