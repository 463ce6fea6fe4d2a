"""GeoJSON features with nested forecast lists, and back.

A list is split into parts of about a bounded number of forecasts, so no task ever holds a region that
attracts a large share of the alerts. Every document says which ``part`` of ``parts`` it is; a region within
the bound has one. Every property but the list describes the whole region in each part. The reader returns
features and forecasts as rows, so parts need no merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from floodspark.functions.fixed_values import FORECAST_FIELDS
from floodspark.functions.parsing import finite
from floodspark.functions.planar import PARTS_TYPE
from floodspark.operators.joins import by_merge

#: Forecasts per document.
LIST_BOUND = 10_000


def large_regions(counts: DataFrame, region: list[str], bound: int = LIST_BOUND) -> DataFrame:
    """(region, parts) of the regions whose list needs more than one part."""
    return counts.where(F.col("model_count") > bound).select(
        *region, F.ceil(F.col("model_count") / bound).cast("int").alias("parts")
    )


def _with_parts(rows: DataFrame, large: DataFrame, region: list[str]) -> DataFrame:
    return rows.join(large, region, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def forecast_lists(
    forecasts: DataFrame, large: DataFrame, region: list[str], order: list[str], fields=FORECAST_FIELDS,
) -> DataFrame:
    """(region, part, parts, forecasts): ordered lists of about as many members as the bound.

    ``large`` comes from :func:`large_regions`. A build stages it, so its true size, most often next
    to nothing, decides whether the join broadcasts it and leaves the forecasts where they are; a
    side too large for that is joined by a shuffle that adaptive execution splits where it is skewed.
    ``order`` should tell rows apart, as a row number does: rows equal in it and in ``fields`` share a part.
    """
    parted = _with_parts(forecasts, large, region)
    part = F.pmod(F.xxhash64(*order, *fields), F.col("parts")).cast("int")
    keys = [*region, "part", "parts"]
    # Without this the join's own partitioning would serve the grouping and keep a region together.
    spread = parted.withColumn("part", part).repartition(*[F.col(k) for k in keys])
    member = F.struct(F.struct(*order).alias("order"), F.struct(*fields).alias("forecast"))
    lists = spread.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members"))
    return lists.select(*keys, F.transform("members", lambda m: m["forecast"]).alias("forecasts"))


def geometry_json(parts: Column, multi: Column) -> Column:
    """GeoJSON geometry text."""
    return F.when(
        multi, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(parts), F.lit("}"))
    ).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(parts[0]), F.lit("}")))


_MODEL_NUMBERS = ("returnPeriodYr", "peakDischargeCms")
_FLOATS = ("peakDischargeCms", "lat", "lon")


def forecast_json(forecast: Column, fields=FORECAST_FIELDS) -> Column:
    """One forecast as JSON text, with the ``fields`` it has.

    Numbers a model does not have are empty text; a coordinate that is absent is null; NaN and infinity, which JSON
    lacks, are null. The members of ``payload``, if that is among the fields, follow as members of the forecast.
    """
    def text(numbers: bool) -> Column:
        def member(name: str) -> Column:
            if name in _MODEL_NUMBERS and not numbers:
                return F.lit("")
            return finite(forecast[name]) if name in _FLOATS else forecast[name]

        names = [n for n in fields if n != "payload"]
        return F.to_json(F.struct(*[member(n).alias(n) for n in names]), {"ignoreNullFields": "false"})

    # A model without a return period has neither number.
    found = F.when(forecast["returnPeriodYr"].isNull(), text(False)).otherwise(text(True)) if "returnPeriodYr" in fields else text(True)
    if "payload" not in fields:
        return found
    more = forecast["payload"]
    return F.when(F.length(more) > 2, F.concat(F.substring(found, F.lit(1), F.length(found) - 1), F.lit(","), F.substring(more, F.lit(2), F.length(more)))).otherwise(found)


def feature_lines(
    features: DataFrame, lists: DataFrame, large: DataFrame, region: list[str], id_columns: list[str], fields=FORECAST_FIELDS,
) -> DataFrame:
    """(res, line): one GeoJSON feature per line and part.

    ``features`` has the region, ``res``, ``id_columns``, severity, model_count, parts (as
    ``geometry``), multi and optionally ``impact``; ``lists`` comes from :func:`forecast_lists`. Features
    are repeated for their parts and go to the lists, which stay where they are.
    """
    repeated = _with_parts(features, large, region).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    joined = by_merge(repeated).join(lists, [*region, "part", "parts"])
    head = F.to_json(F.struct("res", *id_columns, "severity", "model_count"))
    open_head = F.substring(head, F.lit(1), F.length(head) - 1)
    members = F.array_join(F.transform("forecasts", lambda f: forecast_json(f, fields)), ",")
    impact = (
        F.when(F.col("impact").isNotNull(), F.concat(F.lit(',"impact":'), F.to_json("impact"))).otherwise(F.lit(""))
        if "impact" in features.columns
        else F.lit("")
    )
    numbering = F.format_string(',"part":%d,"parts":%d', F.col("part"), F.col("parts"))
    line = F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry_json(F.col("geometry"), F.col("multi")),
        F.lit(',"properties":'), open_head, F.lit(',"forecasts":['), members, F.lit("]"),
        impact, numbering, F.lit("}}"),
    )
    return joined.select("res", line.alias("line"))


# --- reading -----------------------------------------------------------------------------------------

_TEXT_FORECAST = ", ".join(
    f"{name}: {'double' if name in ('lat', 'lon') else 'string'}" for name in FORECAST_FIELDS
)
FEATURE_TYPE = (
    "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: struct<"
    "res: string, cell_id: string, basin_id: string, severity: string, model_count: bigint, "
    f"forecasts: array<struct<{_TEXT_FORECAST}>>, "
    "impact: struct<population: double, buildings: double, farmland_m2: double, highway_km: double, "
    "railway_km: double>, part: int, parts: int>>"
)


#: The same with each forecast whole, whatever members it has.
OPEN_FEATURE_TYPE = FEATURE_TYPE.replace(f"array<struct<{_TEXT_FORECAST}>>", "array<variant>")


def parse_features(features: DataFrame, column: str = "feature") -> DataFrame:
    """Flat rows of parsed features: properties, ``geometry`` parts and ``multi``."""
    feature = F.col(column)
    text = feature["geometry"]["coordinates"]
    multi = feature["geometry"]["type"] == "MultiPolygon"
    geometry = F.when(multi, F.from_json(text, PARTS_TYPE)).otherwise(
        F.array(F.from_json(text, PARTS_TYPE[len("array<"):-1]))
    )
    return features.select(
        # "4", 4 and 4.0 are the same resolution; only an absent one is the first.
        F.when(feature["properties"]["res"].isNull(), 0)
        .otherwise(feature["properties"]["res"].try_cast("double").try_cast("int")).alias("res"),
        *[
            feature["properties"][n].alias(n)
            for n in ("cell_id", "basin_id", "severity", "model_count", "forecasts", "impact")
        ],
        F.coalesce(feature["properties"]["part"], F.lit(0)).alias("part"),
        F.coalesce(feature["properties"]["parts"], F.lit(1)).alias("parts"),
        multi.alias("multi"), geometry.alias("geometry"),
    )


def parse_lines(lines: DataFrame, column: str = "line", payload: bool = False) -> DataFrame:
    """Parsed features of GeoJSON lines; with ``payload`` each forecast is kept whole, as a VARIANT."""
    kind = OPEN_FEATURE_TYPE if payload else FEATURE_TYPE
    return parse_features(lines.select(F.from_json(F.col(column), kind).alias("feature")))


def read_feature_rows(parsed: DataFrame) -> DataFrame:
    """One row per feature, whatever number of parts it was written in, numbered or with gaps."""
    several = parsed.where(F.col("parts") > 1)
    first = several.groupBy("res", "cell_id").agg(F.min("part").alias("part"))
    rows = parsed.where(F.col("parts") <= 1).unionByName(several.join(by_merge(first), ["res", "cell_id", "part"], "left_semi"))
    return rows.drop("forecasts", "part", "parts")


def read_forecast_rows(parsed: DataFrame) -> DataFrame:
    """(res, cell_id, forecast columns): one row per forecast, numbers restored.

    Where the features were parsed with ``payload``, that is a further column: the whole forecast, from which
    ``try_variant_get`` takes any member by name.
    """
    each = parsed.select("res", "cell_id", F.explode("forecasts").alias("f"))
    if isinstance(each.schema["f"].dataType, VariantType):
        members = [
            F.try_variant_get("f", f"$.{n}", "double" if n in ("lat", "lon") else "string").alias(n) for n in FORECAST_FIELDS
        ]
        rows = each.select("res", "cell_id", *members, F.col("f").alias("payload"))
    else:
        rows = each.select("res", "cell_id", "f.*")
    return rows.withColumns({
        "returnPeriodYr": F.col("returnPeriodYr").try_cast("bigint"),
        "peakDischargeCms": F.col("peakDischargeCms").try_cast("double"),
    })
