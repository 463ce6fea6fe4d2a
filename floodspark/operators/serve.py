"""Views on a built collection: models, zoom, extent, details. All of them are parametrised reads.

A choice of models is answered from the tallies, so its cost follows the number of regions and not
the number of forecasts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions import display
from floodspark.functions.fixed_values import DETAIL_FIELDS, FIRST_ZOOM, ZOOM_STEP
from floodspark.functions.severity import shown_severity_of_rank
from floodspark.operators.regions import summarise


def default_resolution(res: Column) -> Column:
    """A feature without a resolution counts as 0."""
    return F.coalesce(res.cast("int"), F.lit(0))


def visible_by_model(tallies: DataFrame, models, region: list[str], *more: Column) -> DataFrame:
    """Features as the chosen models alone make them; a region they leave empty disappears."""
    return shown_features(tallies.where(F.col("model").isin(*models) & (F.col("model") != "")), region, *more)


def shown_features(tallies: DataFrame, region: list[str], *more: Column) -> DataFrame:
    """Features of tallies as a view shows them: a severity of only ``none`` is empty."""
    return summarise(tallies, region, *more, label=shown_severity_of_rank)


def visible_forecasts(forecasts: DataFrame, models) -> DataFrame:
    """Forecast rows of the chosen models; a narrow filter."""
    return forecasts.where(F.col("model").isin(*models))


def features_by_resolution(features: DataFrame, declared=None) -> DataFrame:
    """(res, n_features) of the declared resolutions, or of those observed; ascending.

    Declared resolutions without features count 0; features at other resolutions drop out.
    """
    counts = features.groupBy(default_resolution(F.col("res")).alias("res")).agg(
        F.count("*").alias("n_features")
    )
    if declared:
        wanted = features.sparkSession.createDataFrame(
            [(int(float(r)),) for r in sorted(declared, key=float)], "res int"
        )
        counts = wanted.join(counts, "res", "left").withColumn(
            "n_features", F.coalesce("n_features", F.lit(0).cast("bigint"))
        )
    return counts.orderBy("res")


def model_list(tallies: DataFrame, resolutions) -> DataFrame:
    """Models at the coarsest resolution, with their display names, sorted."""
    coarsest = tallies.where(default_resolution(F.col("res")) == min(resolutions))
    named = coarsest.where(F.col("model") != "").select("model").distinct()
    return named.withColumn("label", display.model_label(F.col("model"))).orderBy("model")


def is_empty(features: DataFrame, resolutions) -> DataFrame:
    """One row, ``empty``: no feature at any of the resolutions."""
    shown = features.where(default_resolution(F.col("res")).isin(*resolutions))
    return shown.limit(1).agg((F.count("*") == 0).alias("empty"))


def at_zoom(zooms: DataFrame, resolutions, first_zoom: int = FIRST_ZOOM, step: int = ZOOM_STEP) -> DataFrame:
    """Requested zooms with the resolution each one shows."""
    return zooms.withColumn("res", display.zoom_resolution(F.col("zoom"), resolutions, first_zoom, step))


def resolution_at(zoom: float, resolutions, first_zoom: int = FIRST_ZOOM, step: int = ZOOM_STEP) -> int:
    """The resolution that one zoom shows: the last one whose start zoom is reached, else the first."""
    ordered = sorted(resolutions)
    reached = [r for i, r in enumerate(ordered) if zoom >= first_zoom + step * i]
    return reached[-1] if reached else ordered[0]


def extent(features: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box over the features' own boxes."""
    return features.groupBy(*by).agg(
        F.min("xmin").alias("west"), F.min("ymin").alias("south"),
        F.max("xmax").alias("east"), F.max("ymax").alias("north"),
    )


def feature_detail(forecasts: DataFrame, *keep: str) -> DataFrame:
    """One row per forecast: title, link, the display text of each field and the historical note."""
    fields = [
        display.value_text(name, display.plain_number(F.col(name)) if name == "peakDischargeCms" else F.col(name).cast("string"))
        .alias(f"{name}_text")
        for name, _ in DETAIL_FIELDS
        if name != "historicalComparison"
    ]
    return forecasts.select(
        *keep,
        display.model_label(F.col("model")).alias("title"),
        display.deep_link(F.col("model"), F.col("lat"), F.col("lon"), F.col("riverId")).alias("link"),
        *fields,
        F.when(F.col("historicalComparison") != "", F.col("historicalComparison")).alias("note"),
    )


def detail_rows(forecasts: DataFrame, *keep: str) -> DataFrame:
    """The same as (keep..., field_order, caption, text) rows."""
    wide = feature_detail(forecasts, *keep)
    shown = [(n, c) for n, c in DETAIL_FIELDS if n != "historicalComparison"]
    entries = F.explode(F.array(*[
        F.struct(F.lit(i).alias("field_order"), F.lit(caption).alias("caption"), F.col(f"{name}_text").alias("text"))
        for i, (name, caption) in enumerate(shown)
    ]))
    return wide.select(*keep, entries.alias("entry")).select(*keep, "entry.*")


def impact_display(features: DataFrame, *keep: str) -> DataFrame:
    """Compact texts of the exposure totals; features without totals drop out."""
    impact = F.col("impact")
    return features.where(impact.isNotNull()).select(
        *keep,
        display.compact_count(impact["buildings"]).alias("buildings"),
        F.concat(display.compact_count(display.square_km(impact["farmland_m2"])), F.lit(" km²")).alias("farmland"),
        F.concat(display.compact_count(impact["highway_km"]), F.lit(" km")).alias("roads"),
        F.concat(display.compact_count(impact["railway_km"]), F.lit(" km")).alias("railways"),
        display.compact_count(impact["population"]).alias("population"),
    )


def agreement(features: DataFrame, *keep: str) -> DataFrame:
    """Agreement label and the one-line summary of a feature."""
    n = F.col("model_count")
    counted = F.concat(n.cast("string"), F.when(n == 1, F.lit(" forecast")).otherwise(F.lit(" forecasts")))
    models = F.size("models").cast("string")
    return features.select(
        *keep,
        display.agreement_label(F.col("models")).alias("agreement"),
        F.concat(
            F.when(F.col("severity") == "", F.lit("?")).otherwise(F.col("severity")),
            F.lit(" ("), counted, F.lit(")"),
            F.when(F.col("agree"), F.concat(F.lit(" · ✓ "), models, F.lit(" models"))).otherwise(F.lit("")),
        ).alias("summary"),
    )


def lookup_cell(features: DataFrame, cell_id: str, res: int | None = None) -> DataFrame:
    """One feature by id; the predicate reaches the scan of the stored collection.

    With its resolution only that partition is read, and there the ranges of ids that the files and row groups state.
    """
    found = features.where(F.col("cell_id") == cell_id)
    return found if res is None else found.where(F.col("res") == res)
