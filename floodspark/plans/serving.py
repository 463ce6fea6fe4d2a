"""A view on a published collection: one resolution as the chosen models make it.

The manifest is one row, so the resolution is known before the tables are read and becomes a partition filter of every
scan. Severity, counts and agreement come from the tallies of the chosen models; geometry and exposure come from the stored
features, forecasts from the stored rows. Nothing but the manifest passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import FORECAST_FIELDS
from floodspark.operators import documents, serve
from floodspark.operators.joins import by_merge
from floodspark.operators.points import ORDER_FIELDS, PAYLOAD, with_payload_text
from floodspark.sources import collections

_DERIVED = ("severity", "model_count", "models", "agree")
REGION = ["res", "cell_id"]


@dataclass(frozen=True)
class View:
    """``features`` (res, cell_id, severity, model_count, models, agree, then what is stored of them: geometry, box, exposure),
    ``forecasts`` of the chosen models as rows, ``extent`` of the coarsest resolution (one row), ``models`` to choose from."""

    res: int
    resolutions: tuple[int, ...]
    features: DataFrame
    forecasts: DataFrame
    extent: DataFrame
    models: DataFrame


def declared_resolutions(spark: SparkSession, folder: str) -> tuple[int, ...]:
    """Resolutions of the manifest, ascending; those of the stored features where it names none."""
    row = collections.read_manifest(spark, folder).first()
    declared = (row and row.resolutions) or [
        r.res for r in collections.read_table(spark, folder, "features").select("res").distinct().collect()
    ]
    return tuple(sorted(declared))


def open_view(spark: SparkSession, folder: str, zoom: float | None = None, models=None, window=None) -> View:
    """The view at a zoom, the coarsest one if none is given.

    ``models`` are the visible ones; by default all that occur at the coarsest resolution. ``window`` (west, south, east,
    north) keeps the features whose boxes meet it, and their forecasts.
    """
    resolutions = declared_resolutions(spark, folder)
    if not resolutions:
        raise ValueError(f"{folder}: a collection without features")
    res = resolutions[0] if zoom is None else serve.resolution_at(zoom, resolutions)

    def stored(name: str, at: int) -> DataFrame:
        return collections.read_table(spark, folder, name).where(F.col("res") == at)

    names = serve.model_list(stored("tallies", resolutions[0]), resolutions)

    def visible(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("model") != "")
        return rows.join(names.select("model"), "model", "left_semi") if models is None else serve.visible_forecasts(rows, models)

    def features(at: int) -> DataFrame:
        shown = serve.shown_features(visible(stored("tallies", at)), REGION)
        shapes = stored("features", at).drop(*_DERIVED)
        if window is not None:
            west, south, east, north = map(float, window)
            shapes = shapes.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))
        return shown.join(by_merge(shapes), REGION)

    found = features(res)
    forecasts = visible(stored("forecasts", res))
    if window is not None:
        forecasts = forecasts.join(found.select(*REGION), REGION, "left_semi")
    return View(res, resolutions, found, forecasts, serve.extent(features(resolutions[0]), []), names)


def view_lines(view: View, bound: int = documents.LIST_BOUND) -> DataFrame:
    """(res, line): the view as GeoJSON features, with the forecasts of the chosen models only."""
    rows = with_payload_text(view.forecasts)
    fields = [n for n in (*FORECAST_FIELDS, PAYLOAD) if n in rows.columns]
    order = [n for n in ORDER_FIELDS if n in rows.columns] or fields
    large = by_merge(documents.large_regions(view.features, REGION, bound))
    lists = documents.forecast_lists(rows, large, REGION, order, fields=fields)
    ids = [n for n in ("cell_id", "basin_id") if n in view.features.columns]
    return documents.feature_lines(view.features, lists, large, REGION, ids, fields=fields)
