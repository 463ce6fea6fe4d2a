"""Alerts of both models in one row shape.

A forecast is a row, never a member of a growing list: a region that attracts a third of all alerts
stays spread over the cluster. Lists are only formed at the document sink, in bounded parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.fixed_values import (
    FORECAST_FIELDS, GAUGE_MODEL, RETURN_PERIOD_TIERS, RIVER_MODEL,
)
from floodspark.functions.parsing import is_finite
from floodspark.functions.severity import return_period_severity
from floodspark.operators.dedup import keep_last
from floodspark.operators.joins import by_merge

_NUMBERS = {"returnPeriodYr": "bigint", "peakDischargeCms": "double", "lat": "double", "lon": "double"}


def clean_crosswalk(parsed: DataFrame) -> DataFrame:
    """(basin_id, comid): the last valid row per basin."""
    return keep_last(parsed.where(~F.col("is_hole")), ["basin_id"], ["comid"])


def flagged_reaches(parsed: DataFrame, tiers=RETURN_PERIOD_TIERS) -> DataFrame:
    """(comid, ret_per, mean, lat, lon, severity): the last flagged row per reach.

    Only fixed-width values are aggregated, which keeps this a hash aggregation; the label follows
    from the years afterwards.
    """
    last = keep_last(parsed, ["comid"], ["ret_per", "mean", "lat", "lon"])
    return last.withColumn("severity", return_period_severity(F.col("ret_per"), tiers))


def only_in_crosswalk(reaches: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Reaches that some basin is matched to."""
    return reaches.join(by_merge(crosswalk.select("comid")), "comid", "left_semi")


def _forecast(values: dict[str, Column]) -> list[Column]:
    """The 13 forecast columns; text that a model lacks is empty, a number it lacks is NULL."""
    return [
        values.get(name, F.lit(None) if name in _NUMBERS else F.lit(""))
        .cast(_NUMBERS.get(name, "string"))
        .alias(name)
        for name in FORECAST_FIELDS
    ]


def river_forecasts(reaches: DataFrame, *keep: str, model: str = RIVER_MODEL) -> DataFrame:
    """Forecast rows of flagged reaches; ``keep`` names further columns to carry, ``model`` their model id."""
    forecast = _forecast({
        "model": F.lit(model), "severity": F.col("severity"),
        "riverId": F.col("comid").cast("string"), "returnPeriodYr": F.col("ret_per"),
        "peakDischargeCms": F.col("mean"), "lat": F.col("lat"), "lon": F.col("lon"),
    })
    return reaches.select(*keep, *forecast, F.lit(0).alias("list_rank"))


def gauge_forecasts(gauges: DataFrame, *keep: str, model: str = GAUGE_MODEL) -> DataFrame:
    """Forecast rows of parsed gauge alerts."""
    forecast = _forecast({
        "model": F.lit(model), "severity": F.col("severity"), "riverId": F.col("gauge_id"),
        "country": F.col("country"), "issuedTime": F.col("issued"), "startTime": F.col("starts"),
        "endTime": F.col("ends"), "lat": F.col("lat"), "lon": F.col("lon"),
    })
    return gauges.select(*keep, *forecast, F.lit(1).alias("list_rank"), F.col("seq").alias("list_seq"))


def basin_river_alerts(crosswalk: DataFrame, reaches: DataFrame) -> DataFrame:
    """One river alert per matched basin: (hybas_id, forecast columns).

    Many basins may share one reach. The reach side has one row per key, and the next step
    regroups on another key, so adaptive execution is free to split a hot reach's basins.
    """
    matched = crosswalk.withColumnRenamed("basin_id", "hybas_id").join(by_merge(reaches), "comid")
    return river_forecasts(matched, "hybas_id")


def all_alerts(river: DataFrame, gauge: DataFrame) -> DataFrame:
    """Union of both models; river rows have no place in a gauge order."""
    return river.unionByName(gauge, allowMissingColumns=True)


def flood_points(reaches: DataFrame, gauges: DataFrame) -> DataFrame:
    """Alerts as points for the grids, coordinates as they came; rank and order tell equal rows apart."""
    return all_alerts(river_forecasts(reaches), gauge_forecasts(gauges))


def usable_points(points: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """Points whose coordinates are numbers; ``lat`` and ``lon`` come out as DOUBLE."""
    return points.withColumns({"lat": lat, "lon": lon}).where(has_coordinate("lat", "lon"))


def has_coordinate(lat: str, lon: str) -> Column:
    return is_finite(F.col(lat)) & is_finite(F.col(lon))
