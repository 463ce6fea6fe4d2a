"""Points binned into grid cells at several resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.cells import SCHEMES
from floodspark.operators.regions import merge_tallies, summarise, tally


def cell_tallies(points: DataFrame, scheme: str, resolutions) -> DataFrame:
    """Tallies per (res, cell address, model); points off the globe have no cell and drop out.

    In a nested scheme the points are tallied once, at the finest resolution, and the coarser cells
    are merged from those tallies. Otherwise every resolution is addressed from the points; the
    tally then still shrinks them before the shuffle.
    """
    cells = SCHEMES[scheme]
    points = _with_model(points)
    if not cells.nested:
        return tally(addressed_points(points, scheme, resolutions), ["res", "cell"])
    finest = max(resolutions)
    addressed = cells.addressed(points.select("model", "severity", "lat", "lon"), finest)
    finest_tallies = tally(addressed.where(F.col("cell").isNotNull()), ["cell"])
    return merge_tallies(_with_parents(finest_tallies, cells, finest, resolutions), ["res", "cell"])


def _with_model(points: DataFrame) -> DataFrame:
    """Points that name no model have an empty one, which no list of models shows."""
    return points if "model" in points.columns else points.withColumn("model", F.lit(""))


def _with_parents(rows: DataFrame, cells, finest: int, resolutions) -> DataFrame:
    """Rows of finest cells once per resolution, with the enclosing cell."""
    every = rows.withColumn("res", F.explode(F.array(*[F.lit(r) for r in resolutions])))
    return every.withColumn("cell", cells.parent(F.col("cell"), finest, F.col("res")))


def addressed_points(points: DataFrame, scheme: str, resolutions) -> DataFrame:
    """Every point once per resolution with its cell and all its columns."""
    cells = SCHEMES[scheme]
    if cells.nested:
        finest = max(resolutions)
        inside = cells.addressed(points, finest).where(F.col("cell").isNotNull())
        return _with_parents(inside, cells, finest, resolutions)
    every = points.withColumn("res", F.explode(F.array(*[F.lit(r) for r in resolutions])))
    return cells.addressed(every).where(F.col("cell").isNotNull())


def cell_id(scheme: str, resolutions) -> Column:
    return SCHEMES[scheme].key(F.col("cell"), F.col("res"), max(resolutions))


def cell_forecasts(points: DataFrame, scheme: str, resolutions) -> DataFrame:
    """Every point once per resolution, as rows: (res, cell_id, point columns)."""
    if scheme == "s2":
        # The walk along the curve is done once per point; the levels only mask its result.
        cells, finest = SCHEMES["s2"], max(resolutions)
        inside = cells.addressed(points, finest).where(F.col("cell").isNotNull())
        leaves = inside.withColumn("_leaf", cells.leaf(F.col("cell"), F.lit(finest), finest)).drop("cell")
        every = leaves.withColumn("res", F.explode(F.array(*[F.lit(r) for r in resolutions])))
        return every.withColumn("cell_id", cells.token(F.col("_leaf"), F.col("res"))).drop("_leaf")
    addressed = addressed_points(points, scheme, resolutions)
    return addressed.withColumn("cell_id", cell_id(scheme, resolutions)).drop("cell")


def cell_features(tallies: DataFrame, scheme: str, resolutions) -> DataFrame:
    """(res, cell_id, cell, severity, model_count, models, agree) of the distinct cells."""
    return summarise(tallies, ["res", "cell"]).withColumn("cell_id", cell_id(scheme, resolutions))


def with_outline(features: DataFrame, scheme: str) -> DataFrame:
    """Cell polygons, computed from the address of each distinct cell; no join is needed."""
    # A filter is not pushed below a generator; pushed on, it would outline every point before they are grouped.
    outlined = SCHEMES[scheme].outlined(features).withColumn("parts", F.explode(F.array("parts")))
    return outlined.where(F.col("parts").isNotNull()).withColumn("multi", F.size("parts") > 1)


def ready_cell_features(points: DataFrame, id_columns: dict[int, str], outlines: DataFrame) -> DataFrame:
    """Roll-up of cell ids that another tool has put on the points.

    ``id_columns`` maps a resolution to the column that holds its cell ids; NULL ids drop out.
    ``outlines`` has (cell_id, parts); cells without one drop out.
    """
    ids = F.explode(F.array(*[
        F.struct(F.lit(res).alias("res"), F.col(column).cast("string").alias("cell_id"))
        for res, column in id_columns.items()
    ]))
    placed = _with_model(points).select("model", "severity", ids.alias("at")).select("model", "severity", "at.*")
    tallies = tally(placed.where(F.col("cell_id").isNotNull()), ["res", "cell_id"])
    return summarise(tallies, ["res", "cell_id"]).join(
        outlines.withColumn("multi", F.size("parts") > 1), "cell_id"
    )


def cells_without_outline(features: DataFrame, outlines: DataFrame) -> DataFrame:
    """Cells to warn about: they have alerts but no polygon."""
    return features.join(outlines.select("cell_id"), "cell_id", "left_anti")
