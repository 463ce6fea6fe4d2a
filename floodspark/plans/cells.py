"""Grid cells: flood points binned at several resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import FORECAST_FIELDS
from floodspark.functions.planar import extent_of
from floodspark.operators import documents, grid
from floodspark.operators.joins import by_merge
from floodspark.operators.points import ORDER_FIELDS, PAYLOAD, with_payload_text

REGION = ["res", "cell_id"]


def features(points: DataFrame, scheme: str, resolutions, tallies: DataFrame | None = None) -> DataFrame:
    """Cell features with geometry, multi and bounding box; a build passes the tallies it has staged."""
    if tallies is None:
        tallies = grid.cell_tallies(points, scheme, resolutions)
    found = grid.cell_features(tallies, scheme, resolutions)
    shaped = grid.with_outline(found, scheme).drop("cell").withColumnRenamed("parts", "geometry")
    return shaped.select("*", *[c.alias(n) for n, c in extent_of(F.col("geometry")).items()])


def lines(
    found: DataFrame, rows: DataFrame, fields=None, bound: int = documents.LIST_BOUND,
    large: DataFrame | None = None,
) -> DataFrame:
    """GeoJSON lines of cell features; ``rows`` are the cell forecasts, with the ``fields`` they have."""
    rows = with_payload_text(rows)
    fields = fields or [n for n in (*FORECAST_FIELDS, PAYLOAD) if n in rows.columns]
    if large is None:
        large = by_merge(documents.large_regions(found, REGION, bound))
    order = [name for name in ORDER_FIELDS if name in rows.columns] or list(fields)
    lists = documents.forecast_lists(rows, large, REGION, order, fields=fields)
    return documents.feature_lines(found, lists, large, REGION, ["cell_id"], fields=fields)
